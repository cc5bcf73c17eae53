"""Flat queries: symbols by name, relationships around a symbol, unresolved references, routes, status and overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import CONFIDENCES, SCHEMA_VERSION, Graph
from quillgraph.operators.joins import join_crowded


class NotFound(LookupError):
    """No symbol of that name."""

    code = 1


class Ambiguous(LookupError):
    """More than one symbol of that name; candidates lists them."""

    code = 6

    def __init__(self, name: str, candidates: list):
        super().__init__(f"{name} is ambiguous: " + ", ".join(c["qualified_name"] for c in candidates))
        self.candidates = candidates


SYMBOL_COLUMNS = ("id", "name", "qualified_name", "kind", "language", "relative_path", "start_byte", "end_byte", "start_line", "end_line", "visibility")


def with_paths(g: Graph, symbols: DataFrame | None = None) -> DataFrame:
    """Symbols with the path of their file; those of no known file are left out."""
    f = g.files.select(F.col("id").alias("file_id"), "relative_path")
    s = join_crowded(g.symbols, f, "file_id") if symbols is None else symbols.join(f, "file_id")
    return s.select(*SYMBOL_COLUMNS)


def symbol_by_id(g: Graph, symbol_id: str) -> DataFrame:
    return with_paths(g, g.symbols.where(F.col("id") == symbol_id))


def symbol_by_name(g: Graph, name: str) -> DataFrame:
    return with_paths(g, g.symbols.where(F.col("name") == name)).orderBy("relative_path", "start_byte")


def name_candidates(g: Graph, name: str) -> DataFrame:
    return with_paths(g, g.symbols.where(F.col("name") == name)).select("id", "qualified_name", "kind", "relative_path").orderBy("qualified_name", "id")


def resolve_subject(g: Graph, subject: str | None = None, symbol_id: str | None = None) -> str:
    """The id of the one symbol that is meant: an id as it is, a qualified name's first match, or a bare name that is unique."""
    if symbol_id is not None:
        return symbol_id
    if subject is None:
        raise ValueError("a name or an id is needed")
    if "::" in subject:
        first = g.symbols.where(F.col("qualified_name") == subject).orderBy("id").limit(1).collect()
        if not first:
            raise NotFound(subject)
        return first[0]["id"]
    found = name_candidates(g, subject)
    two = found.limit(2).collect()
    if not two:
        raise NotFound(subject)
    if len(two) > 1:
        raise Ambiguous(subject, found.collect())
    return two[0]["id"]


def at_least(df: DataFrame, min_confidence: str | None, column: str = "confidence") -> DataFrame:
    """Rows whose confidence reaches the floor; no floor, or "unresolved", keeps all."""
    if min_confidence is None or min_confidence == CONFIDENCES[0]:
        return df
    if min_confidence not in CONFIDENCES:
        raise ValueError(f"not a confidence: {min_confidence}")
    return df.where(X.confidence_rank(F.col(column)) >= CONFIDENCES.index(min_confidence))


def relationship_rows(g: Graph, source: str | None = None, target: str | None = None, kinds: tuple[str, ...] | None = None, min_confidence: str | None = None) -> DataFrame:
    """Relationships with the names at either end and the path they stand in, by line. kinds: None or empty means all."""
    r = g.relationships
    if source is not None:
        r = r.where(F.col("source_symbol_id") == source)
    if target is not None:
        r = r.where(F.col("target_symbol_id") == target)
    if kinds:
        r = r.where(F.col("kind").isin(*kinds))
    r = at_least(r, min_confidence).withColumnRenamed("id", "edge_id")
    s = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("source_qualified_name"), "file_id")
    f = g.files.select(F.col("id").alias("file_id"), F.col("relative_path").alias("path"))
    t = g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("qualified_name").alias("target_qualified_name"))
    out = r.join(s, "source_symbol_id").join(f, "file_id").join(t, "target_symbol_id", "left")
    out = out.select("source_symbol_id", "source_qualified_name", "target_symbol_id", "target_qualified_name", "target_external", "kind", "provenance", "confidence", "start_line", "start_column", "path", "reason", "edge_id")
    return out.orderBy(F.asc_nulls_first("start_line"), "source_qualified_name", "start_column", "edge_id").drop("edge_id")


def references(g: Graph, target: str, **k) -> DataFrame:
    return relationship_rows(g, target=target, **k)


def callers(g: Graph, target: str, **k) -> DataFrame:
    return relationship_rows(g, target=target, kinds=("calls",), **k)


def callees(g: Graph, source: str, **k) -> DataFrame:
    return relationship_rows(g, source=source, kinds=("calls",), **k)


def implementations(g: Graph, target: str, **k) -> DataFrame:
    return relationship_rows(g, target=target, kinds=("implements", "inherits"), **k)


def compact_rows(rows: DataFrame, anchor: str) -> DataFrame:
    """Rows without the end that they share ("source" or "target"), which the caller states once."""
    return rows.drop(f"{anchor}_symbol_id", f"{anchor}_qualified_name")


def unresolved_rows(g: Graph, target_text: str | None = None, source: str | None = None) -> DataFrame:
    u = g.unresolved
    if target_text is not None:
        u = u.where(F.col("target_text") == target_text)
    if source is not None:
        u = u.where(F.col("source_symbol_id") == source)
    f = g.files.select(F.col("id").alias("source_file_id"), F.col("relative_path").alias("path"))
    s = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("source_qualified_name"))
    out = join_crowded(u, f, "source_file_id").join(s, "source_symbol_id", "left")
    return out.select("source_symbol_id", "source_qualified_name", "path", F.col("relationship_kind").alias("kind"), "target_text", "reason", "confidence", "candidate_count").orderBy("path", "target_text", "source_symbol_id")


def routes(g: Graph, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Route handlers; query matches anywhere in verb and path, with case and slashes aside and % and _ as wildcards."""
    r = g.relationships.where(F.col("kind") == "handlesroute")
    if query is not None:
        r = r.where(F.like(X.route_key(F.col("target_external")), F.lit("%" + query.lower().replace("/", "") + "%")))
    s = g.symbols.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("source_qualified_name"), "file_id")
    f = g.files.select(F.col("id").alias("file_id"), F.col("relative_path").alias("path"))
    t = g.symbols.select(F.col("id").alias("target_symbol_id"), F.col("qualified_name").alias("target_qualified_name"))
    out = r.join(s, "source_symbol_id").join(f, "file_id").join(t, "target_symbol_id", "left")
    out = out.select("source_symbol_id", "source_qualified_name", "target_symbol_id", "target_qualified_name", "target_external", "confidence", "provenance", "start_line", "path").orderBy(F.asc_nulls_first("target_external"), "source_qualified_name")
    return out if limit is None else out.limit(limit)


def language_breakdown(g: Graph) -> DataFrame:
    return g.files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def index_status(g: Graph, migrations: DataFrame | None = None) -> DataFrame:
    """One row of counts."""
    files = g.files.agg(F.count("*").alias("files"))
    symbols = g.symbols.agg(F.count("*").alias("symbols"))
    rels = g.relationships.agg(F.count("*").alias("relationships"), F.count_if(F.col("confidence") == "unresolved").alias("relationships_unresolved"))
    state = g.state.agg(F.coalesce(F.max("pending_files"), F.lit(0)).alias("pending_files"), F.max("last_verified_at").alias("last_verified_at"))
    out = files.crossJoin(symbols).crossJoin(rels).crossJoin(state)
    if migrations is not None:
        out = out.crossJoin(migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("schema_version")))
    return out


def project_status(g: Graph) -> DataFrame:
    s = index_status(g)
    return s.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "files", "symbols", "relationships", "relationships_unresolved", "pending_files", "last_verified_at", (F.col("pending_files") > 0).alias("stale"), X.pending_warning(F.col("pending_files")).alias("warning"))


def project_overview(g: Graph, entry_points: int = 20) -> DataFrame:
    """(section, name, value): counts, languages and the first routes."""
    s = index_status(g)
    counts = s.select(F.expr("stack(3, 'files', files, 'symbols', symbols, 'relationships', relationships) as (name, value)")).select(F.lit("count").alias("section"), "name", "value")
    langs = language_breakdown(g).select(F.lit("language").alias("section"), F.col("language").alias("name"), F.col("files").alias("value"))
    first = routes(g).select("target_external", "source_qualified_name", "start_line").orderBy("target_external", "source_qualified_name", "start_line").limit(entry_points).select(F.lit("entry_point").alias("section"), F.concat_ws(" <- ", "target_external", "source_qualified_name").alias("name"), F.col("start_line").cast("long").alias("value"))
    return counts.unionByName(langs).unionByName(first)


def relationships_by_kind(g: Graph) -> DataFrame:
    return g.relationships.groupBy("kind").agg(F.count("*").alias("edges"))


def paginate(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of df in a total order, with the total number of rows, and whether more follow. One row pass for the count, one top-k for the page."""
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order)
    page = page.offset(offset) if offset else page
    page = page.limit(limit) if limit is not None else page
    end = F.lit(2**62 if limit is None else offset + limit)
    return page.crossJoin(total).withColumn("truncated", F.col("total") > end)


def clamp_limit(limit: int | None, default: int = 50, most: int = 500) -> int:
    return min(default if limit is None else max(0, limit), most)


def json_envelope(df: DataFrame, project: str) -> DataFrame:
    """Each row as a JSON answer of its own."""
    return df.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(project).alias("project"), F.struct(*df.columns).alias("result"), F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("truncated"))).alias("json"))


def source_slice(texts: DataFrame, spans: DataFrame, context: int = 2) -> DataFrame:
    """Lines start_line - context .. end_line + context of texts(path, text) for each of spans(path, start_line, end_line), with the reason where there are none."""
    j = spans.join(texts, "path", "left")
    lines = F.split("text", "\n")
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    n = F.least(F.size(lines), F.col("end_line") + context) - first + 1
    reason = F.when(F.col("text").isNull(), "file_missing").when((F.col("start_line") < 1) | (F.col("start_line") > F.size(lines)) | (F.col("end_line") < F.col("start_line")), "span_out_of_range")
    return j.select("path", "start_line", "end_line", F.when(reason.isNull(), F.array_join(F.slice(lines, first.cast("int"), n.cast("int")), "\n")).alias("source"), reason.alias("reason"))


def snippet(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The bytes start_byte .. end_byte of texts(path, text) as text, or the marker (stale) where they are not there."""
    j = spans.join(texts, "path", "left")
    raw = F.encode("text", "UTF-8")
    ok = F.col("text").isNotNull() & (F.col("start_byte") >= 0) & (F.col("end_byte") <= F.length(raw)) & (F.col("start_byte") <= F.col("end_byte"))
    part = F.substring(raw, F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return j.select("path", "start_byte", "end_byte", F.when(ok, F.decode(part, "UTF-8")).otherwise(F.lit("(stale)")).alias("snippet"))


def text_lines(rows: DataFrame) -> DataFrame:
    """Relationship rows as lines for people."""
    return rows.select(F.format_string("%s --%s--> %s  [%s, %s] %s:%s", "source_qualified_name", "kind", F.coalesce("target_qualified_name", "target_external", F.lit("?")), "provenance", "confidence", "path", F.coalesce(F.col("start_line").cast("string"), F.lit("-"))).alias("line"))


def file_ids_of_symbols(g: Graph, paths: DataFrame) -> DataFrame:
    """Ids of the symbols of files whose path is in paths(relative_path)."""
    f = g.files.join(paths.select("relative_path").distinct(), "relative_path", "left_semi").select(F.col("id").alias("file_id"))
    return g.symbols.join(f, "file_id", "left_semi").select("id")


def ids_by_qname(g: Graph, names: DataFrame) -> DataFrame:
    """The first id for each of names(relative_path, qualified_name) that exists."""
    s = with_paths(g).join(names.select("relative_path", "qualified_name").distinct(), ["relative_path", "qualified_name"], "left_semi")
    return s.groupBy("relative_path", "qualified_name").agg(F.min_by("id", F.struct("start_byte", "id")).alias("symbol_id"))


def doctor(spark, g: Graph | None) -> DataFrame:
    """(check, ok, detail): the session, the schema version and each table."""
    rows = [("session", True, spark.version), ("schema_version", True, str(SCHEMA_VERSION))]
    for name in ("files", "symbols", "relationships", "unresolved", "state"):
        df = getattr(g, name, None) if g else None
        rows.append((name, df is not None, ", ".join(df.columns) if df is not None else "not indexed"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def latest_windows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
