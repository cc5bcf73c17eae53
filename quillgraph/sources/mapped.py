"""A graph over tabular data: every row of the star schema becomes a symbol, every foreign key a relationship.

The same definitions as SQL text, for DuckDB, are in SQL_VIEWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.model import Graph, hash_id

#: table, letter of ids, key, name, kind, language
TABLES = (
    ("region", "r", "r_regionkey", "r_name", "namespace", "csharp"),
    ("nation", "n", "n_nationkey", "n_name", "interface", "csharp"),
    ("customer", "c", "c_custkey", "c_name", "class", "csharp"),
    ("supplier", "s", "s_suppkey", "s_name", "class", "csharp"),
    ("orders", "o", "o_orderkey", "concat('Order#', cast(o_orderkey as string))", "method", "typescript"),
    ("part", "p", "p_partkey", "p_name", "function", "typescript"),
)


_READ: dict[tuple[str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder that doesn't change while the application lives; its footers are read once."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}.parquet")
    if key not in _READ:
        _READ[key] = spark.read.parquet(key[1])
    return _READ[key]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    docs = d.select(hash_id("fil", F.col("doc_id").cast("string")).alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("relative_path"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), F.lit(0).cast("long").alias("modified_ns"))
    rows = [(f"fil-{t}", f"src/{t}.{'cs' if lang == 'csharp' else 'ts'}", lang, 0, None, 0) for t, _, _, _, _, lang in TABLES]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, letter, key, name, kind, language in TABLES:
        k = F.col(key).cast("long")
        one = read(spark, sf_dir, table).select(
            F.concat(F.lit(letter), k.cast("string")).alias("id"), F.lit(f"fil-{table}").alias("file_id"), F.expr(name).alias("name"), F.concat(F.lit(f"{table}::"), F.expr(name)).alias("qualified_name"), F.lit(kind).alias("kind"), F.lit(language).alias("language"),
            (k * 100).alias("start_byte"), (k * 100 + 80).alias("end_byte"), (k + 1).alias("start_line"), (k + 3).alias("end_line"), F.lit("public" if letter in "crn" else "default").alias("visibility"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def _edge(df: DataFrame, source: Column, target: Column, kind: str, provenance, confidence, table: str, line: Column, key: Column | None = None) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.concat_ws(":", F.lit(kind), source, target, *([key] if key is not None else [])).alias("id"), source.alias("source_symbol_id"), target.alias("target_symbol_id"), F.lit(None).cast("string").alias("target_external"), F.lit(kind).alias("kind"), as_column(provenance).alias("provenance"), as_column(confidence).alias("confidence"),
        F.lit(f"fil-{table}").alias("source_file_id"), line.cast("int").alias("start_line"), F.lit(0).alias("start_column"), F.lit(None).cast("string").alias("reason"),
    )


def relationships(spark: SparkSession, sf_dir: str, routes: bool = True) -> DataFrame:
    ref = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    t = lambda name: read(spark, sf_dir, name)
    nation, customer, supplier, orders, lineitem = map(t, ("nation", "customer", "supplier", "orders", "lineitem"))
    flag = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    status = F.when(F.col("l_linestatus") == "F", "resolved").otherwise("heuristic")
    one = F.lit(1)
    out = _edge(nation, ref("r", "n_regionkey"), ref("n", "n_nationkey"), "contains", "extracted", "exact", "region", one)
    out = out.unionByName(_edge(customer, ref("c", "c_custkey"), ref("n", "c_nationkey"), "implements", "resolved", "high", "customer", one))
    out = out.unionByName(_edge(supplier, ref("s", "s_suppkey"), ref("n", "s_nationkey"), "inherits", "resolved", "high", "supplier", one))
    out = out.unionByName(_edge(orders, ref("c", "o_custkey"), ref("o", "o_orderkey"), "contains", "extracted", "exact", "customer", one))
    out = out.unionByName(_edge(lineitem, ref("o", "l_orderkey"), ref("p", "l_partkey"), "calls", status, flag, "orders", F.col("l_linenumber"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))))
    pairs = lineitem.select("l_suppkey", "l_partkey").distinct()
    out = out.unionByName(_edge(pairs, ref("s", "l_suppkey"), ref("p", "l_partkey"), "injects", "heuristic", "medium", "supplier", one))
    if routes:
        pages = t("pages")
        handled = pages.select(
            F.concat(F.lit("handlesroute:"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("source_symbol_id"), F.lit(None).cast("string").alias("target_symbol_id"), F.concat(F.lit("GET "), "url").alias("target_external"), F.lit("handlesroute").alias("kind"), F.lit("heuristic").alias("provenance"), F.lit("high").alias("confidence"),
            F.lit("fil-customer").alias("source_file_id"), F.col("page_id").cast("int").alias("start_line"), F.lit(0).alias("start_column"), F.lit(None).cast("string").alias("reason"),
        )
        out = out.unionByName(handled)
    return out


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    fixed = [F.lit("no matching symbol in project").alias("reason"), F.lit("unresolved").alias("confidence"), F.lit(0).alias("candidate_count")]
    a = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_symbol_id"), F.lit("fil-customer").alias("source_file_id"), F.lit("usestype").alias("relationship_kind"), F.col("c_mktsegment").alias("target_text"), *fixed)
    b = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_symbol_id"), F.lit("fil-part").alias("source_file_id"), F.lit("references").alias("relationship_kind"), F.col("p_brand").alias("target_text"), *fixed)
    return a.unionByName(b)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    state = spark.createDataFrame([("prj", 0, None)], "project_id string, pending_files long, last_verified_at string")
    return Graph(files(spark, sf_dir), symbols(spark, sf_dir), relationships(spark, sf_dir), unresolved(spark, sf_dir), state)


def _sql_symbols() -> str:
    parts = []
    for table, letter, key, name, kind, language in TABLES:
        parts.append(f"select '{letter}' || {key} as id, 'fil-{table}' as file_id, {name.replace('as string', 'as varchar')} as name, '{table}::' || {name.replace('as string', 'as varchar')} as qualified_name, '{kind}' as kind, '{language}' as language, {key}::bigint * 100 as start_byte, {key}::bigint * 100 + 80 as end_byte, {key}::bigint + 1 as start_line, {key}::bigint + 3 as end_line, '{'public' if letter in 'crn' else 'default'}' as visibility from {table}")
    return " union all ".join(parts)


def _sql_files() -> str:
    rows = ", ".join(f"('fil-{t}', 'src/{t}.{'cs' if lang == 'csharp' else 'ts'}', '{lang}', 0::bigint, null::varchar, 0::bigint)" for t, _, _, _, _, lang in TABLES)
    return f"select 'fil-' || substr(sha256(doc_id::varchar), 1, 32) as id, source || '/' || doc_id || '.' || lang as relative_path, lang as language, n_chars as size_bytes, sha256(text) as content_hash, 0::bigint as modified_ns from documents union all select * from (values {rows})"


SQL_VIEWS = f"""
files as ({_sql_files()}),
symbols as ({_sql_symbols()}),
relationships as (
  select 'contains:r' || n_regionkey || ':n' || n_nationkey as id, 'r' || n_regionkey as source_symbol_id, 'n' || n_nationkey as target_symbol_id, null::varchar as target_external, 'contains' as kind, 'extracted' as provenance, 'exact' as confidence, 'fil-region' as source_file_id, 1 as start_line, 0 as start_column, null::varchar as reason from nation
  union all select 'implements:c' || c_custkey || ':n' || c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, null, 'implements', 'resolved', 'high', 'fil-customer', 1, 0, null from customer
  union all select 'inherits:s' || s_suppkey || ':n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, null, 'inherits', 'resolved', 'high', 'fil-supplier', 1, 0, null from supplier
  union all select 'contains:c' || o_custkey || ':o' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, null, 'contains', 'extracted', 'exact', 'fil-customer', 1, 0, null from orders
  union all select 'calls:o' || l_orderkey || ':p' || l_partkey || ':' || l_linenumber || ':' || l_suppkey, 'o' || l_orderkey, 'p' || l_partkey, null, 'calls', case l_linestatus when 'F' then 'resolved' else 'heuristic' end, case l_returnflag when 'A' then 'exact' when 'N' then 'medium' else 'low' end, 'fil-orders', l_linenumber, 0, null from lineitem
  union all select 'injects:s' || l_suppkey || ':p' || l_partkey, 's' || l_suppkey, 'p' || l_partkey, null, 'injects', 'heuristic', 'medium', 'fil-supplier', 1, 0, null from (select distinct l_suppkey, l_partkey from lineitem)
  union all select 'handlesroute:' || page_id, 'c' || page_id, null, 'GET ' || url, 'handlesroute', 'heuristic', 'high', 'fil-customer', page_id::int, 0, null from pages
),
unresolved_references as (
  select 'c' || c_custkey as source_symbol_id, 'fil-customer' as source_file_id, 'usestype' as relationship_kind, c_mktsegment as target_text, 'no matching symbol in project' as reason, 'unresolved' as confidence, 0 as candidate_count from customer
  union all select 'p' || p_partkey, 'fil-part', 'references', p_brand, 'no matching symbol in project', 'unresolved', 0 from part
)
"""


def with_views(select: str, recursive: bool = False, before: str = "") -> str:
    """DuckDB SQL over the mapped tables; before: further common table expressions."""
    return f"with {'recursive ' if recursive else ''}{SQL_VIEWS}{', ' + before if before else ''} {select}"
