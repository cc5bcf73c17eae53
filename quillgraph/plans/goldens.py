"""Queries over fixed inputs, with the rows that they must give as VALUES: rules that no table exercises."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import RELATIONSHIP_KINDS, SYMBOL_KINDS
from quillgraph.operators import analytics, resolve
from quillgraph.sources import tree


def kind_match_matrix(spark, d):
    m = resolve.kind_matrix(spark)
    return m.where("rel_kind in ('constructs', 'implements', 'imports', 'exports', 'triggers')").groupBy("domain", "rel_kind").agg(F.array_join(F.array_sort(F.collect_list("kind")), " ").alias("kinds"))


_ALL = " ".join(sorted(SYMBOL_KINDS))
_MATRIX = f"""select * from (values ('web', 'constructs', 'class'), ('web', 'implements', 'class interface'), ('web', 'imports', '{_ALL}'), ('web', 'exports', 'class function interface'), ('web', 'triggers', 'class function method'),
('csharp', 'constructs', 'class struct'), ('csharp', 'implements', 'interface'), ('csharp', 'imports', 'namespace'), ('csharp', 'triggers', 'class function method')) t(domain, rel_kind, kinds)"""


def visibility(spark, d):
    rows = [("public",), ("protected internal",), ("private protected",), ("internal static",), ("private",), ("protected",), ("static",)]
    return spark.createDataFrame(rows, "modifiers string").select("modifiers", X.visibility_of(F.split("modifiers", " ")).alias("visibility"))


_VISIBILITY = "select * from (values ('public', 'public'), ('protected internal', 'protectedinternal'), ('private protected', 'privateprotected'), ('internal static', 'internal'), ('private', 'private'), ('protected', 'protected'), ('static', 'default')) t(modifiers, visibility)"


def tsconfig_aliases(spark, d):
    text = '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/app/*", "src/old/*"], "@env": ["src/env.ts"], "@bad": []}, } }'
    return spark.createDataFrame(tree.tsconfig_aliases(text) + tree.tsconfig_aliases("not json"), "pattern string, replacement string")


_ALIASES = "select * from (values ('@app/*', 'src/app/*'), ('@env', 'src/env.ts')) t(pattern, replacement)"


def framework_marker(spark, d):
    from quillgraph.operators.extract import frameworks

    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.col("text").alias("source"), F.when(F.col("lang") == "de", "csharp").otherwise("typescript").alias("language"))
    marked = t.withColumn("marked", frameworks.has_marker(F.col("language"), F.col("source")))
    return marked.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("marked")).alias("marked"))


_MARKER = "select case when lang = 'de' then 'csharp' else 'typescript' end as language, count(*) as files, count(*) filter (where case when lang = 'de' then text like '%DbSet<%' or text like '%ControllerBase%' or text like '%WebApplication%' or text like '%IServiceCollection%' or text like '%[ApiController%' or text like '%Trigger(%' or text like '%DbContext%' else text like '%@angular/%' or text like '%@Component%' or text like '%@Injectable%' or text like '%@NgModule%' or text like '%@Directive%' or text like '%@Pipe%' or text like '%Routes%' or text like '%inject(%' end) as marked from documents group by 1"


def _imports(spark):
    rows = [("1", "src/a.ts", "./b", "Foo"), ("2", "src/a.ts", "./b", "*"), ("3", "src/a.ts", "./b", "Nope"), ("4", "src/a.ts", "./gone", "Foo"), ("5", "src/a.ts", "rxjs", "of"), ("6", "src/a.ts", "@app/c", "C"), ("7", "src/a.ts", "./b", "default")]
    imports = spark.createDataFrame(rows, "ref_id string, importer string, specifier string, binding string")
    files = spark.createDataFrame([("fa", "src/a.ts"), ("fb", "src/b.ts"), ("fc", "src/app/c/index.ts")], "id string, relative_path string")
    exports = spark.createDataFrame([("fb", "Foo", "s1"), ("fc", "C", "s2")], "file_id string, export_name string, symbol_id string")
    aliases = spark.createDataFrame([("@app/*", "src/app/*"), ("@*", "src/wrong/*")], "pattern string, replacement string")
    return imports, files, exports, aliases


def resolve_import(spark, d):
    return resolve.resolve_import(*_imports(spark))


_IMPORT = """select * from (values ('1', 'imports', 's1', null, 'resolved', 'exact', null), ('2', 'imports', null, null, 'resolved', 'high', null), ('3', 'imports', null, null, null, 'unresolved', 'not exported by target module'), ('4', 'imports', null, null, null, 'unresolved', 'module not found in project'),
('5', 'imports', null, 'rxjs', 'resolved', 'exact', 'of'), ('6', 'imports', 's2', null, 'resolved', 'exact', null), ('7', 'imports', null, null, null, 'unresolved', 'not exported by target module')) t(ref_id, kind, target_id, target_external, provenance, confidence, reason)"""


def resolve_export(spark, d):
    _, files, exports, aliases = _imports(spark)
    rows = [("1", "src/a.ts", None, "Local", "no matching same-file symbol"), ("2", "src/a.ts", "./b", "Foo", None), ("3", "src/a.ts", "./b", "*", None), ("4", "src/a.ts", "lib", "X", None)]
    return resolve.resolve_export(spark.createDataFrame(rows, "ref_id string, importer string, specifier string, binding string, reason string"), files, exports, aliases)


_EXPORT = "select * from (values ('1', 'exports', null, null, null, 'unresolved', 'not declared in this file'), ('2', 'exports', 's1', null, 'resolved', 'exact', null), ('3', 'exports', null, null, 'resolved', 'high', null), ('4', 'exports', null, 'lib', 'resolved', 'exact', 'X')) t(ref_id, kind, target_id, target_external, provenance, confidence, reason)"


def _typed(spark):
    symbols = spark.createDataFrame([("s1", "Base", "class", "csharp"), ("s2", "IThing", "interface", "csharp"), ("s3", "Twice", "class", "csharp"), ("s4", "Twice", "struct", "csharp"), ("s5", "Acme.Core", "namespace", "csharp"), ("s6", "Base", "class", "typescript"), ("s7", "Colour", "enum", "csharp")], "id string, name string, kind string, language string")
    refs = spark.createDataFrame([("1", "usestype", "Base", "csharp", "r"), ("2", "usestype", "IThing", "csharp", "r"), ("3", "usestype", "Twice", "csharp", "r"), ("4", "usestype", "Gone", "csharp", "r"), ("5", "usestype", "Colour", "csharp", "r")], "ref_id string, rel_kind string, text string, domain string, reason string")
    return refs, symbols


def resolve_base_list(spark, d):
    return resolve.resolve_base_list(*_typed(spark))


_MISSING = "base list entry not found in project; class vs interface undeterminable"
_BASE = f"select * from (values ('1', 'inherits', 's1', 'resolved', 'high', null), ('2', 'implements', 's2', 'resolved', 'high', null), ('3', 'inherits', 's3', 'heuristic', 'low', null), ('3', 'inherits', 's4', 'heuristic', 'low', null), ('4', 'usestype', null, null, 'unresolved', '{_MISSING}'), ('5', 'usestype', null, null, 'unresolved', '{_MISSING}')) t(ref_id, kind, target_id, provenance, confidence, reason)"


def resolve_property_type(spark, d):
    return resolve.resolve_property_type(*_typed(spark))


_PROPERTY = "select * from (values ('1', 'usestype', 's1', 'resolved', 'high', 'r'), ('2', 'usestype', 's2', 'resolved', 'high', 'r'), ('3', 'usestype', 's3', 'heuristic', 'low', 'r'), ('3', 'usestype', 's4', 'heuristic', 'low', 'r'), ('4', 'usestype', null, null, 'unresolved', 'declared type not found in project'), ('5', 'usestype', 's7', 'resolved', 'high', 'r')) t(ref_id, kind, target_id, provenance, confidence, reason)"


def resolve_using(spark, d):
    _, symbols = _typed(spark)
    refs = spark.createDataFrame([("1", "Acme.Core", None), ("2", "System.Linq", "static")], "ref_id string, text string, reason string")
    return resolve.resolve_using(refs, symbols)


_USING = "select * from (values ('1', 'imports', 's5', null, 'resolved', 'high', null), ('2', 'imports', null, 'System.Linq', 'resolved', 'exact', 'static')) t(ref_id, kind, target_id, target_external, provenance, confidence, reason)"


def agent_log_parse(spark, d):
    lines = ['{"type":"thread.started"}', '{"type":"item.completed","item":{"type":"command_execution","text":"ls"}}', "noise", '{"type":"item.completed","item":{"type":"agent_message","text":"It is in src/a.ts"}}', '{"type":"turn.completed","usage":{"input_tokens":120,"output_tokens":30}}']
    return analytics.parse_logs(spark.createDataFrame([("r1", i, x) for i, x in enumerate(lines)], "run_id string, line_no int, value string"))


_LOG = "select 'r1' as run_id, 'It is in src/a.ts' as answer, 120::bigint as input_tokens, 30::bigint as output_tokens, 1::bigint as tool_calls"


def agent_benchmark_summary(spark, d):
    rows = [(f"t{i}", arm, float(100 * (i + 1) * (0.6 if arm == "treatment" and i < 5 else 1.0)), True) for i in range(6) for arm in ("baseline", "treatment") for _ in range(3)]
    return analytics.summarize(spark.createDataFrame(rows, "task string, arm string, tokens double, correct boolean"))


_SUMMARY = "select 2100.0::double as baseline, 1500.0::double as treatment, 5::bigint as improved, 1.0::double as rate_baseline, 1.0::double as rate_treatment, 1 - 1500.0::double / 2100 as reduction, 'ahorro_fuerte' as verdict"

GOLDENS = {
    "kind_match_matrix": (kind_match_matrix, _MATRIX),
    "visibility": (visibility, _VISIBILITY),
    "tsconfig_aliases": (tsconfig_aliases, _ALIASES),
    "framework_marker": (framework_marker, _MARKER),
    "resolve_import": (resolve_import, _IMPORT),
    "resolve_export": (resolve_export, _EXPORT),
    "resolve_base_list": (resolve_base_list, _BASE),
    "resolve_property_type": (resolve_property_type, _PROPERTY),
    "resolve_using": (resolve_using, _USING),
    "agent_log_parse": (agent_log_parse, _LOG),
    "agent_benchmark_summary": (agent_benchmark_summary, _SUMMARY),
}
assert RELATIONSHIP_KINDS
