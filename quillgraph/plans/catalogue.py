"""Every registered query of the graph engine over the mapped tables, with its oracle as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import UNIT, hash_id, symbol_key
from quillgraph.operators import analytics, incremental, queries, resolve, search, traverse
from quillgraph.plans import goldens
from quillgraph.sources import mapped, tree
from quillgraph.sources.mapped import read
from quillgraph.sources.mapped import with_views as V
from quillgraph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


_RELS = """select r.source_symbol_id, s.qualified_name as source_qualified_name, r.target_symbol_id, t.qualified_name as target_qualified_name, r.target_external, r.kind, r.provenance, r.confidence, r.start_line, r.start_column, f.relative_path as path, r.reason
from relationships r join symbols s on s.id = r.source_symbol_id join files f on f.id = s.file_id left join symbols t on t.id = r.target_symbol_id where """
_RANK = "case confidence when 'exact' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_SYM = "select s.id, s.name, s.qualified_name, s.kind, s.language, f.relative_path, s.start_byte, s.end_byte, s.start_line, s.end_line, s.visibility from symbols s join files f on f.id = s.file_id"


# flat queries


@query(V(_RELS + "r.kind = 'calls' and r.target_symbol_id = 'p1'"))
def callers(spark, d):
    """Who calls the part p1."""
    return queries.callers(mapped.graph(spark, d), "p1")


@query(V(_RELS + "r.kind = 'calls' and r.source_symbol_id = 'o7'"))
def callees(spark, d):
    return queries.callees(mapped.graph(spark, d), "o7")


@query(V(_RELS + "r.target_symbol_id = 'n1'"))
def references(spark, d):
    return queries.references(mapped.graph(spark, d), "n1")


@query(V(_RELS + "r.target_symbol_id = 'p2' and r.kind in ('injects', 'reads')"))
def references_by_kind(spark, d):
    return queries.references(mapped.graph(spark, d), "p2", kinds=("injects", "reads"))


@query(V(_RELS + "r.target_symbol_id = 'n3' and r.kind in ('implements', 'inherits')"))
def implementations(spark, d):
    return queries.implementations(mapped.graph(spark, d), "n3")


@query(V(_RELS + "r.target_symbol_id = 'p1' and " + _RANK.replace("case confidence", "case r.confidence") + " >= 2"))
def min_confidence(spark, d):
    return queries.references(mapped.graph(spark, d), "p1", min_confidence="medium")


_UNRES = "select u.source_symbol_id, s.qualified_name as source_qualified_name, f.relative_path as path, u.relationship_kind as kind, u.target_text, u.reason, u.confidence, u.candidate_count from unresolved_references u join files f on f.id = u.source_file_id left join symbols s on s.id = u.source_symbol_id"


@query(V(_UNRES))
def unresolved_all(spark, d):
    return queries.unresolved_rows(mapped.graph(spark, d))


@query(V(_UNRES + " where u.target_text = 'BUILDING'"))
def unresolved_by_target(spark, d):
    return queries.unresolved_rows(mapped.graph(spark, d), target_text="BUILDING")


@query(V(_SYM + " where s.id = 'c5'"))
def symbol_by_id(spark, d):
    return queries.symbol_by_id(mapped.graph(spark, d), "c5")


@query(V(_SYM + " where s.name = 'red widget'"))
def symbol_by_name(spark, d):
    return queries.symbol_by_name(mapped.graph(spark, d), "red widget")


@query(V("select s.id, s.qualified_name, s.kind, f.relative_path from symbols s join files f on f.id = s.file_id where s.name = 'small ring'"))
def name_candidates(spark, d):
    return queries.name_candidates(mapped.graph(spark, d), "small ring")


@query(V("select min(id) as symbol_id, 'nation::NATION_4' as subject from symbols where qualified_name = 'nation::NATION_4'"))
def resolve_subject(spark, d):
    got = queries.resolve_subject(mapped.graph(spark, d), "nation::NATION_4")
    return spark.createDataFrame([(got, "nation::NATION_4")], "symbol_id string, subject string")


_ROUTES = "select r.source_symbol_id, s.qualified_name as source_qualified_name, r.target_symbol_id, t.qualified_name as target_qualified_name, r.target_external, r.confidence, r.provenance, r.start_line, f.relative_path as path from relationships r join symbols s on s.id = r.source_symbol_id join files f on f.id = s.file_id left join symbols t on t.id = r.target_symbol_id where r.kind = 'handlesroute'"


@query(V(_ROUTES + " and lower(replace(coalesce(r.target_external, ''), '/', '')) like '%get http:blog%'"))
def routes(spark, d):
    return queries.routes(mapped.graph(spark, d), "GET http://blog")


@query("select page_id, rtrim(split_part(url, '?', 1), '/') || '/' || 'api/' || page_id as route from pages")
def route_templates(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", X.join_route(F.substring_index("url", "?", 1), F.concat(F.lit("/api/"), F.col("page_id").cast("string"))).alias("route"))


@query(V("select coalesce(language, 'unknown') as language, count(*) as files from files group by 1"))
def language_breakdown(spark, d):
    return queries.language_breakdown(mapped.graph(spark, d))


_STATUS = "(select count(*) from files) as files, (select count(*) from symbols) as symbols, (select count(*) from relationships) as relationships, (select count(*) from relationships where confidence = 'unresolved') as relationships_unresolved, 0::bigint as pending_files, null::varchar as last_verified_at"


@query(V(f"select {_STATUS}, 6 as schema_version"))
def index_status(spark, d):
    return queries.index_status(mapped.graph(spark, d), spark.createDataFrame([(v, "0") for v in range(1, 7)], "version int, applied_at string"))


@query(V(f"select 6 as schema_version, {_STATUS}, false as stale, null::varchar as warning"))
def project_status(spark, d):
    return queries.project_status(mapped.graph(spark, d))


@query(
    V("""select 'count' as section, 'files' as name, count(*) as value from files union all select 'count', 'symbols', count(*) from symbols union all select 'count', 'relationships', count(*) from relationships
union all select 'language', coalesce(language, 'unknown'), count(*) from files group by 2
union all select * from (select 'entry_point', r.target_external || ' <- ' || s.qualified_name, r.start_line::bigint from relationships r join symbols s on s.id = r.source_symbol_id where r.kind = 'handlesroute' order by r.target_external, s.qualified_name, r.start_line limit 20)""")
)
def project_overview(spark, d):
    return queries.project_overview(mapped.graph(spark, d))


@query(V("select kind, count(*) as edges from relationships group by 1"))
def relationships_by_kind(spark, d):
    return queries.relationships_by_kind(mapped.graph(spark, d))


@query("select o_orderkey, o_totalprice, count(*) over () as total, count(*) over () > 100 + 50 as truncated from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def paginate(spark, d):
    return queries.paginate(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], offset=100, limit=50)


@query("""select '{"schema_version":1,"project":"demo","result":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"},"warnings":[],"truncated":false}' as json from nation""")
def json_envelope(spark, d):
    return queries.json_envelope(read(spark, d, "nation").select("n_nationkey", "n_name"), "demo")


@query(V(f"select {_RANK} as rank, count(*) as edges from relationships group by 1"))
def confidence_rank(spark, d):
    return mapped.relationships(spark, d).groupBy(X.confidence_rank(F.col("confidence")).alias("rank")).agg(F.count("*").alias("edges"))


def _texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


@query(
    """select doc_id::varchar as path, 3 as start_line, 4 as end_line,
case when len(string_split(text, chr(10))) >= 3 then array_to_string(list_slice(string_split(text, chr(10)), 2, least(5, len(string_split(text, chr(10))))), chr(10)) end as source,
case when len(string_split(text, chr(10))) < 3 then 'span_out_of_range' end as reason from documents"""
)
def source_slice(spark, d):
    t = _texts(spark, d)
    return queries.source_slice(t, t.select("path", F.lit(3).alias("start_line"), F.lit(4).alias("end_line")), context=1)


@query("select item_id::varchar as path, 0::bigint as start_byte, 12::bigint as end_byte, text[1:12] as snippet from benchmark where strlen(text[1:12]) = 12 union all select item_id::varchar, 1000000::bigint, 1000001::bigint, '(stale)' from benchmark where strlen(text[1:12]) = 12")
def snippet(spark, d):
    b = read(spark, d, "benchmark").where(F.octet_length(F.substring("text", 1, 12)) == 12)
    t = b.select(F.col("item_id").cast("string").alias("path"), "text")
    spans = t.select("path", F.lit(0).cast("long").alias("start_byte"), F.lit(12).cast("long").alias("end_byte")).unionByName(t.select("path", F.lit(1_000_000).cast("long").alias("start_byte"), F.lit(1_000_001).cast("long").alias("end_byte")))
    return queries.snippet(t, spans)


# traversal

_WALK = "walk as (select '{0}' as id, 0 as depth union select {1}, w.depth + 1 from walk w join relationships r on {2} = w.id and r.target_symbol_id is not null{4} where w.depth < {3}), best as (select id, min(depth) as depth from walk group by 1)"


def _walk(start: str, depth: int, reverse: bool = False, extra: str = "") -> str:
    a, b = ("r.source_symbol_id", "r.target_symbol_id") if reverse else ("r.target_symbol_id", "r.source_symbol_id")
    return _WALK.format(start, a, b, depth, extra)


@query(V("select source_symbol_id as node, count(*) as edges, count(distinct target_symbol_id) as neighbours from relationships where target_symbol_id is not null group by 1"))
def adjacency(spark, d):
    a = traverse.adjacency(mapped.graph(spark, d))
    return a.groupBy("node").agg(F.count("*").alias("edges"), F.count_distinct("neighbour").alias("neighbours"))


_OPEN = traverse.Caps(depth=3, nodes=50_000, edges=90_000)


@query(V("select id as symbol_id, depth from best", True, _walk("c1", 10)))
def bfs_capped(spark, d):
    got = traverse.bfs(traverse.adjacency(mapped.graph(spark, d)), "c1", caps=traverse.Caps())
    return got.reached.select("symbol_id", "depth")


@query(V("select (select count(*) from best where depth <= 2) as nodes, (select min(depth) from best where id = (select min(r2.target_symbol_id) from relationships r1 join relationships r2 on r2.source_symbol_id = r1.target_symbol_id and r2.kind = 'calls' where r1.source_symbol_id = 'c2')) as hops", True, _walk("c2", 3)))
def trace_path(spark, d):
    """How far the first part is that an order of customer c2 calls: the length of the traced path, beside the number of nodes within two steps."""
    g = mapped.graph(spark, d)
    a = traverse.adjacency(g)
    near = a.where("node = 'c2'").select(F.col("neighbour").alias("node"))
    first = near.join(traverse.leaving(a.where("kind = 'calls'"), near), "node").agg(F.min("neighbour")).first()[0]
    path = traverse.trace(g, "c2", first, traverse.Caps()) if first else spark.range(0).select(F.lit(0).alias("hop"))
    near = traverse.bfs(a, "c2", caps=traverse.Caps(depth=2)).reached
    return near.agg(F.count("*").alias("nodes")).crossJoin(path.agg(F.max("hop").alias("hops")))


@query(V("select depth, count(*) as nodes from best group by 1", True, _walk("p1", 3, True)))
def impact(spark, d):
    """How many symbols depend on the part p1, at each depth."""
    return traverse.impact(mapped.graph(spark, d), "p1", _OPEN).reached.groupBy("depth").agg(F.count("*").alias("nodes"))


@query(V("select b.id as symbol_id, b.depth, f.relative_path as path, s.start_line, s.end_line from best b left join symbols s on s.id = b.id left join files f on f.id = s.file_id", True, _walk("p3", 2, True)))
def impact_rows(spark, d):
    g = mapped.graph(spark, d)
    return traverse.reached_rows(g, traverse.impact(g, "p3", traverse.Caps(depth=2)).reached).select("symbol_id", "depth", "path", "start_line", "end_line")


_BOTH = _walk("c3", 2) + ", " + _walk("c3", 2, True).replace("walk", "back").replace("best", "rear")


@query(V("select id as symbol_id, min(depth) as depth from (select * from best union all select * from rear) group by 1", True, _BOTH))
def neighbourhood(spark, d):
    return traverse.neighbourhood(mapped.graph(spark, d), "c3", 2, traverse.Caps(depth=2))[0]


@query(
    """with nodes as (select n_nationkey as k, n_regionkey as depth, 'n' || n_nationkey as symbol_id from nation), rings as (select depth, count(*) as n from nodes group by 1),
base as (select *, greatest(depth * 210.0, n * 58 / (2 * pi())) - depth * 210.0 as b from rings), r as (select *, case when depth = 0 then 0.0 else max(case when depth > 0 then b end) over (order by depth) + depth * 210.0 end as radius from base),
p as (select nodes.*, n, radius, row_number() over (partition by nodes.depth order by symbol_id) - 1 as i from nodes join r using (depth))
select symbol_id, depth, round(radius * cos(-pi() / 2 + 2 * pi() * i / n), 6) + 0.0 as x, round(radius * sin(-pi() / 2 + 2 * pi() * i / n), 6) + 0.0 as y from p"""
)
def radial_layout(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("symbol_id"), F.col("n_regionkey").alias("depth"))
    return traverse.radial_layout(n)


# search


def _match(q: str) -> str:
    cols = " or ".join(f"contains(' ' || array_to_string(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' {q} ')" for c in ("s.name", "s.qualified_name", "s.kind", "f.relative_path"))
    return f"({cols})"


@query(V(_SYM + " where " + _match("red widget")))
def search_phrase(spark, d):
    return search.search(mapped.graph(spark, d), "Red widget", limit=None)


@query(V(_SYM + " where " + _match("order") + " order by s.name, s.id limit 50"), "search")
def search_top(spark, d):
    return search.search(mapped.graph(spark, d), "order")


@query(V(_SYM + " where contains(lower(s.name), 'nation') and contains(lower(s.name), '_1') = contains(lower(s.name), '_1') order by case when starts_with(lower(s.name), 'nation') then 0 else 1 end, s.name, s.id limit 50"))
def search_partial(spark, d):
    return search.search_partial(mapped.graph(spark, d), "Nation_1")


@query(
    """with t as (select distinct source, list_distinct(list_transform(string_split(trim(regexp_replace(regexp_replace(source || 'FooBarBaz_quux', '(\\p{Lu})', ' \\1', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: lower(x))) as raw,
string_split(trim(regexp_replace(regexp_replace(source || 'FooBarBaz_quux', '(\\p{Lu})', ' \\1', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') as parts from documents)
select source, array_to_string(list_slice(list_filter(list_transform(parts, lambda x: lower(x)), lambda x: strlen(x) >= 3), 1, 3), ' ') as terms from t"""
)
def partial_terms(spark, d):
    s = read(spark, d, "documents").select("source").distinct()
    return s.select("source", F.array_join(X.partial_terms(F.concat("source", F.lit("FooBarBaz_quux"))), " ").alias("terms"))


# identities


@query(V("select s.id, sha256(s.language || chr(31) || f.relative_path || chr(31) || s.kind || chr(31) || s.qualified_name || chr(31) || '') as symbol_key from symbols s join files f on f.id = s.file_id"))
def symbol_keys(spark, d):
    s = queries.with_paths(mapped.graph(spark, d))
    return s.select("id", symbol_key(F.col("language"), F.col("relative_path"), F.col("kind"), F.col("qualified_name"), F.lit("")).alias("symbol_key"))


@query("select c_custkey, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'service', 'component', 'service'])), ',') as roles from customer")
def symbol_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.array(F.lower("c_mktsegment"), F.lit("service"), F.lit("component"), F.lit("service")).alias("roles"))
    return resolve.symbol_rows(c)


_TUPLE = "source_symbol_id, kind, target_symbol_id, target_external, start_line, start_column"


@query(
    V(f"""select o.source_symbol_id, o.target_symbol_id, o.start_line, o.ordinal, 'rel-' || substr(sha256('prj' || chr(31) || source_symbol_id || chr(31) || kind || chr(31) || coalesce(target_symbol_id, target_external, '') || chr(31) || coalesce(start_line::varchar, '') || chr(31) || coalesce(start_column::varchar, '') || chr(31) || ordinal), 1, 32) as id
from (select *, (row_number() over (partition by {_TUPLE} order by id) - 1)::int as ordinal from relationships) o""")
)
def stable_relationship_ids(spark, d):
    r = mapped.relationships(spark, d).withColumnRenamed("id", "edge")
    return resolve.stable_relationship_ids(r, "prj", ["edge"]).select("source_symbol_id", "target_symbol_id", "start_line", "ordinal", "id")


@query(V("""select source_symbol_id, target_text, ordinal, 'unr-' || substr(sha256('prj' || chr(31) || source_file_id || chr(31) || coalesce(source_symbol_id, '') || chr(31) || relationship_kind || chr(31) || target_text || chr(31) || ordinal), 1, 32) as id
from (select *, (row_number() over (partition by source_file_id, source_symbol_id, relationship_kind, target_text order by reason) - 1)::int as ordinal from unresolved_references)"""))
def stable_unresolved_ids(spark, d):
    return resolve.stable_unresolved_ids(mapped.unresolved(spark, d), "prj", ["reason"]).select("source_symbol_id", "target_text", "ordinal", "id")


@query(V("select id, qualified_name, (row_number() over (partition by file_id, qualified_name order by start_byte, id) - 1)::int as partial_ordinal from symbols"))
def partial_ordinals(spark, d):
    return resolve.partial_ordinals(mapped.symbols(spark, d)).select("id", "qualified_name", "partial_ordinal")


# resolution


def _refs(spark, d):
    one = lambda table, key, letter, text, kind, domain: read(spark, d, table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("ref_id"), F.lit(kind).alias("rel_kind"), F.col(text).alias("text"), F.lit(domain).alias("domain"))
    return one("supplier", "s_suppkey", "rs", "s_name", "constructs", "csharp").unionByName(one("customer", "c_custkey", "rc", "c_name", "usestype", "csharp")).unionByName(one("part", "p_partkey", "rb", "p_brand", "references", "csharp")).unionByName(one("nation", "n_nationkey", "rn", "n_name", "injects", "csharp")).unionByName(one("part", "p_partkey", "rp", "p_name", "calls", "web"))


_REFS = """refs as (select 'rs' || s_suppkey as ref_id, 'constructs' as rel_kind, s_name as text, 'csharp' as domain from supplier union all select 'rc' || c_custkey, 'usestype', c_name, 'csharp' from customer union all select 'rb' || p_partkey, 'references', p_brand, 'csharp' from part union all select 'rn' || n_nationkey, 'injects', n_name, 'csharp' from nation union all select 'rp' || p_partkey, 'calls', p_name, 'web' from part),
fit as (select r.ref_id, s.id as target_id, s.kind as target_kind from refs r join symbols s on s.name = r.text and (case when s.language = 'csharp' then 'csharp' else 'web' end) = r.domain
 where case r.rel_kind when 'constructs' then s.kind in ('class', 'struct') when 'usestype' then s.kind in ('class', 'struct', 'interface', 'enum') when 'references' then s.kind in ('class', 'struct', 'interface', 'enum') when 'injects' then s.kind in ('class', 'interface') else s.kind in ('function', 'method', 'constructor') end),
cand as (select r.*, fit.target_id, fit.target_kind, count(fit.target_id) over (partition by r.ref_id) as n from refs r left join fit on fit.ref_id = r.ref_id)"""
_NAMED = "select ref_id, rel_kind as kind, target_id, case when n = 1 then 'resolved' when n > 1 then 'heuristic' end as provenance, case when n = 1 then 'high' when n > 1 then 'low' else 'unresolved' end as confidence, case when n = 0 then 'unresolved' else 'resolved' end as outcome, case when n = 0 then 'no matching symbol in project' end as reason from cand"


@query(V(_NAMED, before=_REFS))
def resolve_by_name(spark, d):
    return resolve.resolve_by_name(_refs(spark, d), mapped.symbols(spark, d))


@query(V(f"select outcome, count(*) as edges from ({_NAMED}) group by 1", before=_REFS))
def resolution_report(spark, d):
    return resolve.resolution_report(_refs(spark, d), mapped.symbols(spark, d))


@query(
    V("""select ref_id, rel_kind as kind, target_id, 'heuristic' as provenance, 'di:inject-fn' as reason,
case when n = 0 then 'unresolved' when n > 1 then 'low' when rel_kind = 'injects' and target_kind = 'interface' then 'medium' when starts_with(ref_id, 'rc') then 'medium' else 'high' end as confidence from cand""", before=_REFS)
)
def provenance_floor(spark, d):
    """Framework edges: the weaker of the ceiling and the outcome."""
    refs = _refs(spark, d).withColumn("ceiling", F.when(F.startswith("ref_id", F.lit("rc")), "medium").otherwise("high")).withColumn("provenance", F.lit("heuristic")).withColumn("reason", F.lit("di:inject-fn"))
    return resolve.resolve_framework(refs, mapped.symbols(spark, d))


@query(V("select case when language in ('typescript', 'javascript') then 'web' when language = 'csharp' then 'csharp' end as domain, count(*) as symbols from symbols group by 1"))
def resolution_domain(spark, d):
    return mapped.symbols(spark, d).groupBy(X.resolution_domain(F.col("language")).alias("domain")).agg(F.count("*").alias("symbols"))


@query(
    V("""select r.ref_id, r.rel_kind as kind, s.id as target_id, 'extracted' as provenance, case when n = 1 then 'exact' when n > 1 then 'low' else 'unresolved' end as confidence, case when n > 1 then 'ambiguous: multiple same-file candidates' when n = 0 then 'no matching same-file symbol' end as reason
from (select 'q' || p_partkey as ref_id, 'calls' as rel_kind, p_name as text, 'fil-part' as file_id from part union all select 'u' || s_suppkey, 'calls', s_name, 'fil-supplier' from supplier) r
left join (select *, count(*) over (partition by file_id, name) as n0 from symbols where kind in ('function', 'method', 'constructor')) s on s.name = r.text and s.file_id = r.file_id cross join lateral (select coalesce(s.n0, 0) as n)""")
)
def resolve_same_file(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("ref_id"), F.lit("calls").alias("rel_kind"), F.col("p_name").alias("text"), F.lit("fil-part").alias("file_id"), F.lit("web").alias("domain"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("ref_id"), F.lit("calls").alias("rel_kind"), F.col("s_name").alias("text"), F.lit("fil-supplier").alias("file_id"), F.lit("csharp").alias("domain"))
    return resolve.resolve_same_file(p.unionByName(s), mapped.symbols(spark, d))


_TREE = "mfiles as (select source || '/' || doc_id || case doc_id % 3 when 0 then '.ts' when 1 then '/index.ts' else '.md' end as relative_path from documents), imps as (select doc_id::varchar as ref_id, source || '/main.ts' as importer, case doc_id % 4 when 3 then 'lib' || doc_id else './sub/.././' || doc_id end as specifier, doc_id, source from documents)"


def _tree(spark, d):
    x = read(spark, d, "documents")
    k = F.col("doc_id").cast("string")
    files = x.select(F.concat("source", F.lit("/"), k, F.when(F.col("doc_id") % 3 == 0, ".ts").when(F.col("doc_id") % 3 == 1, "/index.ts").otherwise(".md")).alias("relative_path"))
    imports = x.select(k.alias("ref_id"), F.concat("source", F.lit("/main.ts")).alias("importer"), F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("lib"), k)).otherwise(F.concat(F.lit("./sub/.././"), k)).alias("specifier"))
    return files, imports


@query(
    f"""with {_TREE} select ref_id, importer, specifier, case when doc_id % 4 = 3 then 'external' when t.relative_path is not null then 'project' else 'unresolved' end as outcome, t.relative_path as target_path
from imps left join mfiles t on doc_id % 4 <> 3 and t.relative_path in (source || '/' || doc_id || '.ts', source || '/' || doc_id || '/index.ts')"""
)
def resolve_module(spark, d):
    """Specifiers of every document's module: files, folders with an index, none, or external."""
    files, imports = _tree(spark, d)
    return resolve.resolve_module(imports, files)


_TOP = "select 'x' || s_suppkey as symbol_id, 'n' || s_nationkey as file_id, s_name as export_name from supplier"


@query(
    """with explicit as (select 'fil-nation' || s_nationkey as file_id, 'Main' as export_name, min('s' || s_suppkey) as symbol_id from supplier group by 1), top as (select 'fil-nation' || s_nationkey as file_id, s_name as export_name, 's' || s_suppkey as symbol_id from supplier union all select 'fil-nation' || n_nationkey, 'Main', 'n' || n_nationkey from nation)
select * from explicit union all select * from top t where not exists (select 1 from explicit e where e.file_id = t.file_id and e.export_name = t.export_name)"""
)
def export_table(spark, d):
    return _exports(spark, d)


def _exports(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    own = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    file = F.concat(F.lit("fil-nation"), F.col("s_nationkey").cast("string"))
    explicit = s.groupBy(file.alias("file_id")).agg(F.min(own).alias("symbol_id")).withColumn("export_name", F.lit("Main"))
    k = F.col("n_nationkey").cast("string")
    symbols = s.select(own.alias("id"), file.alias("file_id"), F.col("s_name").alias("name"), F.lit("class").alias("kind")).unionByName(n.select(F.concat(F.lit("n"), k).alias("id"), F.concat(F.lit("fil-nation"), k).alias("file_id"), F.lit("Main").alias("name"), F.lit("class").alias("kind"))).withColumn("top_level", F.lit(True))
    return resolve.export_table(symbols, explicit)


@query(
    """with explicit as (select 'fil-nation' || s_nationkey as file_id, 'Main' as export_name, min('s' || s_suppkey) as symbol_id from supplier group by 1), e as (select * from explicit union all select 'fil-nation' || s_nationkey, s_name, 's' || s_suppkey from supplier union all select 'fil-nation' || n_nationkey, 'Main', 'n' || n_nationkey from nation where not exists (select 1 from explicit x where x.file_id = 'fil-nation' || n_nationkey)),
b as (select 'b' || c_custkey as ref_id, 'fil-nation' || c_nationkey as file_id, case c_custkey % 3 when 0 then '*' when 1 then 'Main' else c_name end as binding from customer)
select ref_id, file_id, binding, case when binding <> '*' then symbol_id end as target_id, case when binding = '*' or symbol_id is not null then 'resolved' end as provenance, case when binding = '*' then 'high' when symbol_id is not null then 'exact' else 'unresolved' end as confidence, case when binding <> '*' and symbol_id is null then 'not exported by target module' end as reason
from b left join e using (file_id) where false union all
select ref_id, b.file_id, binding, case when binding <> '*' then symbol_id end, case when binding = '*' or symbol_id is not null then 'resolved' end, case when binding = '*' then 'high' when symbol_id is not null then 'exact' else 'unresolved' end, case when binding <> '*' and symbol_id is null then 'not exported by target module' end
from b left join e on e.file_id = b.file_id and e.export_name = b.binding"""
)
def resolve_import_binding(spark, d):
    k = F.col("c_custkey")
    b = read(spark, d, "customer").select(F.concat(F.lit("b"), k.cast("string")).alias("ref_id"), F.concat(F.lit("fil-nation"), F.col("c_nationkey").cast("string")).alias("file_id"), F.when(k % 3 == 0, "*").when(k % 3 == 1, "Main").otherwise(F.col("c_name")).alias("binding"))
    return resolve.resolve_binding(b, _exports(spark, d))


@query(
    V("""select e.edge_no, 'c' || e.o_custkey as source_symbol_id, coalesce(k.id, q.id) as target_symbol_id from (select o_orderkey as edge_no, o_custkey, case when o_orderkey % 2 = 0 then 'p' || o_orderkey else 'none' end as target_key, 'part::red widget' as target_qname from orders where exists (select 1 from customer where c_custkey = o_custkey)) e
left join symbols k on k.file_id = 'fil-part' and k.id = e.target_key left join (select arg_min(id, start_byte) as id, qualified_name from symbols where file_id = 'fil-part' group by 2) q on q.qualified_name = e.target_qname""")
)
def bind_edge_ids(spark, d):
    k = F.col("o_orderkey")
    e = read(spark, d, "orders").select(k.alias("edge_no"), F.lit("fil-customer").alias("file_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_key"), F.lit("fil-part").alias("target_file_id"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).otherwise("none").alias("target_key"), F.lit("part::red widget").alias("target_qname"))
    s = mapped.symbols(spark, d).withColumn("local_key", F.col("id")).withColumn("pos", F.col("start_byte"))
    return resolve.bind_edge_ids(e, s)


@query(V("select f.relative_path, s.qualified_name, arg_min(s.id, s.start_byte) as symbol_id from symbols s join files f on f.id = s.file_id where s.qualified_name in (select 'part::' || p_name from part) group by 1, 2"))
def ids_by_qname(spark, d):
    names = read(spark, d, "part").select(F.lit("src/part.ts").alias("relative_path"), F.concat(F.lit("part::"), "p_name").alias("qualified_name"))
    return queries.ids_by_qname(mapped.graph(spark, d), names)


@query(V("select s.id from symbols s where s.file_id in ('fil-nation', 'fil-supplier')"))
def ids_for_files(spark, d):
    paths = spark.createDataFrame([("src/nation.cs",), ("src/supplier.cs",)], "relative_path string")
    return queries.file_ids_of_symbols(mapped.graph(spark, d), paths)


# sources and incremental maintenance


@query("select case lang when 'en' then 'typescript' when 'fr' then 'javascript' when 'de' then 'csharp' end as language, count(*) as files, sum(n_chars)::bigint as chars from documents where lang in ('en', 'fr', 'de') and strlen(text) <= 65536 group by 1")
def discover_files(spark, d):
    """Sources among all documents, whose language stands for an extension."""
    x = read(spark, d, "documents")
    ext = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "js").when(F.col("lang") == "de", "cs").otherwise("md")
    f = x.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("relative_path"), F.octet_length("text").cast("long").alias("size_bytes"), "n_chars")
    got = tree.discover(f, tree.Config(max_file_size_bytes=65536, max_total_files=0))
    return got.groupBy("language").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("select source || '/' || doc_id as relative_path, lang as language, strlen(text)::bigint as size_bytes, sha256(text) as content_hash from documents")
def file_meta(spark, d):
    x = read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("relative_path"), F.col("lang").alias("language"), F.col("text").alias("source"))
    return tree.file_meta(x)


@query("select source, count(*) as files, sha256(string_agg(sha256(doc_id::varchar || '|' || text), '' order by doc_id::varchar)) as snapshot from documents group by 1")
def tree_snapshot(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "source")
    return tree.tree_snapshot(x, "path", "text", "source")


@query("select 's' || s_suppkey as id, s_name as root_path, coalesce(c_mktsegment, s_name) as name, 1 as created_at from supplier left join customer on c_custkey = s_suppkey union all select 'c' || c_custkey, c_name, c_mktsegment, 2 from customer where not exists (select 1 from supplier where s_suppkey = c_custkey)")
def upsert_project(spark, d):
    """Projects by root path: suppliers are there, all customers come, under the name of the supplier of their number where there is one."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("root_path"), F.col("s_name").alias("name"), F.lit(1).alias("created_at"))
    names = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    c = read(spark, d, "customer").join(names, "c_custkey", "left").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.coalesce("s_name", "c_name").alias("root_path"), F.col("c_mktsegment").alias("name"), F.lit(2).alias("created_at"))
    return incremental.upsert(s, c, "root_path")


@query("select p_partkey, p_name, 'default' as visibility, false as is_partial from part")
def migrate_add_columns(spark, d):
    return incremental.migrate(read(spark, d, "part").select("p_partkey", "p_name"), {"visibility": "default", "is_partial": False})


_FOUND = "found as (select source || '/' || doc_id as p, n_chars + (n_chars > 1000)::int as s, 1::bigint as m, case when n_chars > 1000 then 'new' else 'h' || doc_id end as h from documents), stored as (select case lang when 'de' then source || '/was/' || doc_id else source || '/' || doc_id end as p, n_chars as s, case when n_chars < 200 then 0 else 1 end::bigint as m, 'h' || doc_id as h from documents), changes as (select coalesce(f.p, s.p) as relative_path, case when f.p is null then 'deleted' when s.p is null then 'created' when not ((f.s = s.s and f.m = s.m) or f.h = s.h) then 'modified' end as change from found f full join stored s on f.p = s.p)"


def _states(spark, d):
    """Two states of all documents as a tree: those in German have moved, the longer ones have grown, the short ones were only touched."""
    x = read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("relative_path"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("h"))
    grown = F.col("n_chars") > 1000
    was = F.when(F.col("lang") == "de", F.concat("source", F.lit("/was/"), F.col("doc_id").cast("string"))).otherwise(F.col("relative_path"))
    found = x.select("relative_path", (F.col("n_chars") + grown.cast("int")).alias("size_bytes"), F.lit(1).cast("long").alias("modified_ns"), F.when(grown, "new").otherwise(F.col("h")).alias("content_hash"))
    stored = x.select(was.alias("relative_path"), F.col("n_chars").alias("size_bytes"), F.when(F.col("n_chars") < 200, 0).otherwise(1).cast("long").alias("modified_ns"), F.col("h").alias("content_hash"))
    return found, stored


@query(f"with {_FOUND} select * from changes where change is not null")
def detect_changes(spark, d):
    return incremental.detect_changes(*_states(spark, d))


@query(f"with {_FOUND} select * from changes where change is not null and (relative_path = 'src1' or starts_with(relative_path, 'src1/'))")
def path_prefix_filter(spark, d):
    return incremental.detect_changes(*_states(spark, d), only=spark.createDataFrame([("src1",)], "path string"))


@query("select source, count(*) as tracked, count(*) filter (where lang = 'de') as changed, count(*) filter (where lang = 'de') * 100 > count(*) * 25 as oversized from documents group by 1")
def oversized_batch(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("tracked"), F.count_if(F.col("lang") == "de").alias("changed"))
    return g.select("*", X.is_oversized(F.col("changed"), F.col("tracked"), F.lit(25)).alias("oversized"))


@query(V("select distinct f.relative_path from relationships r join symbols s on s.id = r.target_symbol_id join files f on f.id = r.source_file_id where s.file_id = 'fil-nation' and f.relative_path <> 'src/nation.cs'"))
def dependents_by_target(spark, d):
    g = mapped.graph(spark, d)
    return incremental.dependents_by_target(g.relationships, g.files, g.symbols.where("file_id = 'fil-nation'").select("id"), spark.createDataFrame([("src/nation.cs",)], "relative_path string"))


@query(V("select distinct f.relative_path from unresolved_references u join files f on f.id = u.source_file_id where u.target_text in (select c_mktsegment from customer)"))
def dependents_by_unresolved(spark, d):
    g = mapped.graph(spark, d)
    return incremental.dependents_by_unresolved(g.unresolved, g.files, read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")), spark.createDataFrame([("src/nation.cs",)], "relative_path string"))


_AFF = "affected as (select relative_path, 'batch' as why from (values ('src/nation.cs', 'modified'), ('src/new.ts', 'created')) t(relative_path, change) union all select distinct relative_path, 'dependent' from (select f.relative_path from relationships r join symbols s on s.id = r.target_symbol_id join files f on f.id = r.source_file_id where s.file_id = 'fil-nation' union all select f.relative_path from unresolved_references u join files f on f.id = u.source_file_id where u.target_text in (select c_mktsegment from customer)) where relative_path not in ('src/nation.cs', 'src/new.ts', 'src/part.ts'))"


def _affected(spark, d):
    g = mapped.graph(spark, d)
    changes = spark.createDataFrame([("src/nation.cs", "modified"), ("src/new.ts", "created"), ("src/part.ts", "deleted")], "relative_path string, change string")
    one = incremental.dependents_by_target(g.relationships, g.files, g.symbols.where("file_id = 'fil-nation'").select("id"), changes)
    two = incremental.dependents_by_unresolved(g.unresolved, g.files, read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")), changes)
    return g, changes, incremental.affected_set(changes, one, two)


@query(V("select * from affected", before=_AFF))
def affected_set(spark, d):
    return _affected(spark, d)[2]


_SNAP = "select s.id, f.relative_path, s.name, s.qualified_name, s.kind, s.language, exists (select 1 from relationships r where r.target_symbol_id = s.id and r.kind = 'exports') as exported from symbols s join files f on f.id = s.file_id where s.kind <> 'module'"


@query(V(_SNAP))
def resolution_snapshot(spark, d):
    g = mapped.graph(spark, d)
    return incremental.resolution_snapshot(g.symbols, g.files, g.relationships)


@query(V(f"select * from ({_SNAP}) where relative_path not in (select relative_path from affected) and relative_path <> 'src/part.ts'", before=_AFF))
def resolution_baseline(spark, d):
    g, changes, affected = _affected(spark, d)
    return incremental.resolution_baseline(g.symbols, g.files, g.relationships, affected, changes)


@query(V("select r.source_symbol_id, r.source_file_id, r.kind as relationship_kind, s.name as target_text, 0 as candidate_count, 'target symbol''s file was deleted' as reason, 'unresolved' as confidence from relationships r join symbols s on s.id = r.target_symbol_id where s.file_id = 'fil-nation' and r.source_file_id <> 'fil-nation'"))
def delete_inbound_to_unresolved(spark, d):
    g = mapped.graph(spark, d)
    return incremental.inbound_to_unresolved(g.relationships, g.symbols, spark.createDataFrame([("fil-nation",)], "file_id string"))


@query(
    V("""select 'files' as tbl, (select count(*) from files where id not in ('fil-nation', 'fil-supplier')) + 1 as n union all select 'symbols', (select count(*) from symbols where file_id not in ('fil-nation', 'fil-supplier')) + (select count(*) from supplier)
union all select 'relationships', (select count(*) from relationships r where r.source_file_id not in ('fil-nation', 'fil-supplier') and not exists (select 1 from symbols s where s.id = r.target_symbol_id and s.file_id = 'fil-nation')) + (select count(*) from supplier)
union all select 'unresolved', (select count(*) from unresolved_references) + (select count(*) from relationships r join symbols s on s.id = r.target_symbol_id where s.file_id = 'fil-nation' and r.source_file_id not in ('fil-nation', 'fil-supplier'))""")
)
def incremental_apply(spark, d):
    """A batch that deletes the nations' file and rewrites the suppliers': rows of each table after it."""
    g = mapped.graph(spark, d)
    stored = {"files": g.files, "symbols": g.symbols, "relationships": g.relationships, "unresolved": g.unresolved}
    new_rels = g.relationships.where("source_file_id = 'fil-supplier' and kind = 'inherits'").withColumn("target_symbol_id", F.lit(None).cast("string"))
    new = {"files": g.files.where("id = 'fil-supplier'"), "symbols": g.symbols.where("file_id = 'fil-supplier'"), "relationships": new_rels, "unresolved": g.unresolved.limit(0)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id string")
    after = incremental.apply_incremental(stored, new, ids("fil-nation"), ids("fil-supplier"))
    out = None
    for name, df in after.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# streaming

_EVENTS = "ev as (select user_id, event_type, (epoch_us(ts) // 1000) as ms, event_id from events)"


@query(
    """with recursive ev as (select user_id, (epoch_us(ts) // 1000) as ms, event_id, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_type) as k from events),
w as (select user_id, k, ms as first_ms, ms + 20000000 as flush_ms, 0 as batch, ms from ev where k = 1
union all select e.user_id, e.k, case when e.ms < w.flush_ms then w.first_ms else e.ms end, case when e.ms < w.flush_ms then least(e.ms + 20000000, w.first_ms + 60000000) else e.ms + 20000000 end, case when e.ms < w.flush_ms then w.batch else w.batch + 1 end, e.ms from w join ev e on e.user_id = w.user_id and e.k = w.k + 1)
select user_id, batch, min(first_ms)::bigint as first_ms, max(flush_ms)::bigint as flush_ms, count(*)::int as events from w group by 1, 2"""
)
def debounce_sessions(spark, d):
    """All events in batches per user, with a pause of 20 000 s and a limit of 60 000 s."""
    e = read(spark, d, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return watch.debounce_batches(e, "user_id", "event_type", "ms", 20_000_000, 60_000_000).drop("paths")


@query("select user_id, count(distinct event_type)::int as paths, count(*)::int as events from events group by 1")
def watch_batches(spark, d):
    """One batch for each user, over a pause that never ends: the distinct paths that it would hand on."""
    e = read(spark, d, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    b = watch.debounce_batches(e, "user_id", "event_type", "ms", 10**15, 10**15)
    return b.select("user_id", F.size("paths").alias("paths"), "events")


# analytics


@query(
    """with g as (select event_type, list_sort(list(value)) as v from events group by 1)
select event_type, len(v)::bigint as n, list_aggregate(v, 'median') as median, v[(round_even(0.95 * (len(v) - 1), 0) + 1)::int] as p95 from g"""
)
def latency_percentiles(spark, d):
    return analytics.latency_percentiles(read(spark, d, "events"), "event_type", "value")


_C = "concat"
for _name, (_f, _sql) in goldens.GOLDENS.items():
    QUERIES[_name] = _f
    ORACLES[_name] = _sql
assert UNIT and hash_id
