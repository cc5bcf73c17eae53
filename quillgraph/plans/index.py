"""From sources to the stored graph: extract, resolve, bind identities and publish, in full or for a batch of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import FRAMEWORK_KINDS, hash_id, symbol_key
from quillgraph.operators import incremental, resolve
from quillgraph.operators.extract import run as extraction
from quillgraph.operators.traverse import cut
from quillgraph.sources import tree
from quillgraph.sources.store import Store

PROJECT = "prj"
_BASE, _DECLARED = "c# base list entry", "c# property/field declared type"


def build(sources: DataFrame, aliases: list[tuple[str, str]] | None = None, baseline: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables files, symbols, relationships and unresolved of sources(relative_path, language, size_bytes, modified_ns, content_hash, source).

    baseline are symbols of files that stay as they are (id, file_id, name, qualified_name, kind, language, top_level, local_key, pos), which references
    may resolve to; known are the files(id, relative_path) they are in. Extraction runs once; what is read more than once is checkpointed.
    """
    spark = sources.sparkSession
    file_id = hash_id("fil", F.concat(F.lit(PROJECT + "/"), F.col("relative_path")))
    found = cut(extraction.extract(sources).withColumn("file_id", file_id))
    status = found.where("kind = 'module'").select("relative_path", F.col("status").alias("parse_status"))
    files = sources.join(status, "relative_path", "left").select(file_id.alias("id"), "relative_path", "language", "size_bytes", "content_hash", "modified_ns", "parse_status")
    key = symbol_key(F.col("language"), F.col("relative_path"), F.col("kind"), F.col("qualified_name"), F.col("local_key"))
    symbols = extraction.symbol_rows(found).withColumn("symbol_key", key).withColumn("id", hash_id("sym", F.concat_ws("/", "file_id", "symbol_key")))
    symbols = symbols.select("id", "file_id", "symbol_key", "local_key", "name", "qualified_name", "kind", "language", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "visibility", "is_partial", "is_record", F.array_join(F.array_sort(F.array_distinct("roles")), ",").alias("roles"), "is_exported", "top_level", "pos")
    named = symbols.where("kind <> 'module'")
    brief = named.select("id", "file_id", "name", "qualified_name", "kind", "language", "top_level", "local_key", "pos")
    every = brief if baseline is None else brief.unionByName(baseline.select(*brief.columns))
    every = every.withColumn("name", F.when((F.col("kind") == "namespace"), F.regexp_replace("qualified_name", "^.*::", "")).otherwise(F.col("name")))
    places = files.select("id", "relative_path") if known is None else files.select("id", "relative_path").unionByName(known.select("id", "relative_path"))

    edges = extraction.edge_rows(found).select(F.concat_ws("|", "relative_path", F.col("pos").cast("string")).alias("ref_id"), "file_id", "relative_path", "source_key", F.col("kind").alias("rel_kind"), "tag", F.col("target").alias("text"), "specifier", "provenance", "confidence", "reason", F.col("start_line").cast("int").alias("start_line"), F.col("start_column").cast("int").alias("start_column"), X.resolution_domain(F.col("language")).alias("domain"), "language")
    own = symbols.select("file_id", F.col("local_key").alias("source_key"), F.col("id").alias("source_symbol_id"))
    edges = cut(edges.join(own, ["file_id", "source_key"]))
    cols = ["ref_id", "kind", "target_id", "target_external", "provenance", "confidence", "reason"]

    def shaped(df: DataFrame) -> DataFrame:
        for c in cols:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df.select(*cols)

    local = edges.where("tag = 'local'").join(own.select("file_id", F.col("source_key").alias("text"), F.col("source_symbol_id").alias("target_id")), ["file_id", "text"], "left")
    local = shaped(local.withColumnRenamed("rel_kind", "kind"))
    external = shaped(edges.where("tag = 'external'").withColumn("target_external", F.col("text")).withColumnRenamed("rel_kind", "kind"))
    nothing = shaped(edges.where("tag = 'none'").withColumnRenamed("rel_kind", "kind"))
    open_ = edges.where("tag = 'unresolved'")
    web_module = F.col("rel_kind").isin("imports", "exports") & F.col("specifier").isNotNull()
    alias_df = spark.createDataFrame(aliases, "pattern string, replacement string") if aliases else None
    modules = open_.where(web_module).select("ref_id", F.col("relative_path").alias("importer"), "specifier", F.col("text").alias("binding"), "rel_kind")
    tops = every.where("kind <> 'namespace'").select("id", "file_id", "name", "kind", "top_level")
    own_exports = open_.where((F.col("rel_kind") == "exports") & F.col("specifier").isNull()).join(tops.select("file_id", F.col("name").alias("text"), F.col("id").alias("symbol_id"), F.col("top_level").alias("top")).where("top"), ["file_id", "text"], "left")
    explicit = own_exports.where("symbol_id is not null").select("file_id", F.col("text").alias("export_name"), "symbol_id")
    exports = resolve.export_table(tops, explicit)
    imported = shaped(resolve.resolve_import(modules.where("rel_kind = 'imports'").drop("rel_kind"), places, exports, alias_df))
    reexported = shaped(resolve.resolve_import(modules.where("rel_kind = 'exports'").drop("rel_kind"), places, exports, alias_df, "exports"))
    exported = own_exports.groupBy("ref_id").agg(F.min("symbol_id").alias("target_id")).select("ref_id", F.lit("exports").alias("kind"), "target_id", F.when(F.col("target_id").isNotNull(), "extracted").alias("provenance"), F.when(F.col("target_id").isNotNull(), "exact").otherwise("unresolved").alias("confidence"), F.when(F.col("target_id").isNull(), "not declared in this file").alias("reason"))
    usings = shaped(resolve.resolve_using(open_.where((F.col("rel_kind") == "imports") & (F.col("language") == "csharp")).select("ref_id", "text", "reason"), every.where("kind = 'namespace'")))
    bases = shaped(resolve.resolve_base_list(open_.where(F.col("reason") == _BASE), every))
    declared = shaped(resolve.resolve_property_type(open_.where(F.col("reason") == _DECLARED), every))
    framework = open_.where(F.col("rel_kind").isin(*FRAMEWORK_KINDS))
    framework = shaped(resolve.resolve_framework(framework.withColumn("ceiling", F.col("confidence")).drop("confidence"), every))
    plain = open_.where(~F.col("rel_kind").isin("imports", "exports", *FRAMEWORK_KINDS) & ~F.coalesce(F.col("reason").isin(_BASE, _DECLARED), F.lit(False)))
    same = resolve.resolve_same_file(plain.select("ref_id", "rel_kind", "text", "domain", "file_id"), every)
    inside = shaped(same.where("target_id is not null"))
    rest = plain.join(same.where("target_id is null").select("ref_id"), "ref_id", "left_semi").select("ref_id", "rel_kind", "text", "domain")
    outside = shaped(resolve.resolve_by_name(rest, every))
    done = local
    for df in (external, nothing, imported, reexported, shaped(exported), usings, bases, declared, framework, inside, outside):
        done = done.unionByName(df)

    at = edges.select("ref_id", "source_symbol_id", F.col("file_id").alias("source_file_id"), F.col("text").alias("target_text"), "specifier", "start_line", "start_column", "tag")
    full = cut(done.join(at, "ref_id"))
    gone = (F.col("confidence") == "unresolved") & (F.col("tag") != "external")
    rels = full.where(~gone).select("source_symbol_id", F.col("target_id").alias("target_symbol_id"), "target_external", "kind", "provenance", "confidence", "source_file_id", "start_line", "start_column", "reason", "ref_id")
    rels = resolve.stable_relationship_ids(rels, PROJECT, ["ref_id"]).drop("ref_id", "ordinal")
    unres = full.where(gone).select("source_symbol_id", "source_file_id", F.col("kind").alias("relationship_kind"), F.when(F.col("reason") == "module not found in project", F.col("specifier")).otherwise(F.col("target_text")).alias("target_text"), F.lit(0).alias("candidate_count"), "reason", F.lit("unresolved").alias("confidence"), F.col("reason").alias("context_json"), "ref_id")
    unres = resolve.stable_unresolved_ids(unres, PROJECT, ["ref_id"]).drop("ref_id", "ordinal")
    return {"files": files, "symbols": symbols, "relationships": rels, "unresolved": unres}


def index(spark: SparkSession, root: str, store: Store, config: tree.Config = tree.Config()) -> int:
    """A full index of the tree at root; the version that it was published as."""
    paths = tree.list_tree(root, config)
    store.set_pending(len(paths))
    return store.publish(build(tree.read_sources(spark, root, paths, config), _aliases(root)))


def _aliases(root: str) -> list[tuple[str, str]]:
    from pathlib import Path

    p = Path(root) / "tsconfig.json"
    return tree.tsconfig_aliases(p.read_text(errors="replace")) if p.is_file() else []


def update(spark: SparkSession, root: str, store: Store, config: tree.Config = tree.Config(), only: list[str] | None = None) -> tuple[int, list[tuple[str, str]]]:
    """Brings the store up to date with the tree: (version, changes). Nothing changed leaves the version as it is; a batch over the threshold, or a new analyzer, indexes in full."""
    from quillgraph.model import ANALYZER_VERSION

    tables = store.tables()
    if tables is None or incremental.needs_full_reindex(store.manifest()["analyzer_version"], ANALYZER_VERSION):
        return index(spark, root, store, config), []
    found = tree.read_sources(spark, root, None, config)
    wanted = spark.createDataFrame([(p,) for p in only], "path string") if only else None
    changes = cut(incremental.detect_changes(found, tables["files"], wanted))
    listed = [(r["relative_path"], r["change"]) for r in changes.collect()]  # one batch of paths
    if not listed:
        return store.manifest()["version"], []
    store.set_pending(len(listed))
    tracked = tables["files"].count()
    if not tracked or len(listed) * 100 > tracked * config.full_reindex_threshold_percent:
        return index(spark, root, store, config), listed
    files, symbols = tables["files"], tables["symbols"]
    batch = changes.select("relative_path")
    ids = files.join(batch, "relative_path", "left_semi").select(F.col("id").alias("file_id"))
    touched = symbols.join(ids, "file_id", "left_semi")
    touched = cut(touched)
    fresh = cut(extraction.symbol_rows(extraction.extract(found.join(changes.where("change <> 'deleted'"), "relative_path", "left_semi"))).select("name").distinct())
    bases = symbols.join(touched.select("name").distinct().unionByName(fresh.distinct()).distinct(), "name", "left_semi").select("id")
    one = incremental.dependents_by_target(tables["relationships"], files, touched.select("id").unionByName(bases).distinct(), changes)
    two = incremental.dependents_by_unresolved(tables["unresolved"], files, fresh.unionByName(touched.select("name")), changes)
    three = incremental.dependents_by_import(tables["relationships"], tables["unresolved"], files, changes)
    affected = cut(incremental.affected_set(changes, one, two.unionByName(three)))
    redo = found.join(affected.select("relative_path"), "relative_path", "left_semi")
    gone = changes.where("change = 'deleted'").join(files, "relative_path").select(F.col("id").alias("file_id"))
    gone = cut(gone)
    rewritten = files.join(affected.select("relative_path"), "relative_path", "left_semi").select(F.col("id").alias("file_id"))
    rewritten = cut(rewritten)
    stale = gone.unionByName(rewritten).distinct()
    baseline = symbols.where("kind <> 'module'").join(stale, "file_id", "left_anti")
    known = files.join(stale.select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "relative_path")
    new = build(cut(redo), _aliases(root), baseline, known)
    new = {k: cut(v) for k, v in new.items()}
    after = incremental.apply_incremental(tables, new, gone, rewritten)
    return store.publish(after), listed
