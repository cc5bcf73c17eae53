"""What changed, whom it touches, and how the stored graph follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.operators.joins import join_crowded


def detect_changes(found: DataFrame, stored: DataFrame, only: DataFrame | None = None, force_full: bool = False) -> DataFrame:
    """(relative_path, change) of found(relative_path, size_bytes, modified_ns, content_hash) against stored: created, modified or deleted.

    Equal size and time, or else an equal hash, is no change. only(path) restricts both sides to those paths and what lies
    below them; force_full treats the store as empty, save that what is gone is deleted.
    """
    if only is not None:
        wanted = F.broadcast(only.select(F.col("path").alias("wanted")).distinct())  # the paths of one batch of events
        found = found.join(wanted, X.matches_filter(F.col("relative_path"), F.col("wanted")), "left_semi")
        stored = stored.join(wanted, X.matches_filter(F.col("relative_path"), F.col("wanted")), "left_semi")
    a = found.select("relative_path", F.col("size_bytes").alias("s1"), F.col("modified_ns").alias("m1"), F.col("content_hash").alias("h1"), F.lit(True).alias("here"))
    b = stored.select("relative_path", F.col("size_bytes").alias("s2"), F.col("modified_ns").alias("m2"), F.col("content_hash").alias("h2"), F.lit(True).alias("there"))
    same = (F.col("s1").eqNullSafe(F.col("s2")) & F.col("m1").eqNullSafe(F.col("m2"))) | F.coalesce(F.col("h1") == F.col("h2"), F.lit(False))
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | F.lit(force_full), "created").when(~same, "modified")
    return a.join(b, "relative_path", "full").select("relative_path", change.alias("change")).where("change is not null")


def touched_only(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths whose time changed but whose text did not; their stored time is to be brought up to date, so that they are not hashed again."""
    b = stored.select("relative_path", F.col("modified_ns").alias("old_ns"), F.col("content_hash").alias("old_hash"))
    return found.join(b, "relative_path").where((F.col("content_hash") == F.col("old_hash")) & (F.col("modified_ns") != F.col("old_ns"))).select("relative_path", "modified_ns")


def dependents_by_target(relationships: DataFrame, files: DataFrame, symbol_ids: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths of files, other than the changed ones, with a relationship to one of symbol_ids(id)."""
    r = relationships.join(symbol_ids.select(F.col("id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi").select(F.col("source_file_id").alias("id")).distinct()
    return files.join(r, "id", "left_semi").select("relative_path").join(changed.select("relative_path"), "relative_path", "left_anti").distinct()


def dependents_by_unresolved(unresolved: DataFrame, files: DataFrame, names: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths of files, other than the changed ones, with an unresolved reference to one of names(name)."""
    u = unresolved.join(names.select(F.col("name").alias("target_text")).distinct(), "target_text", "left_semi").select(F.col("source_file_id").alias("id")).distinct()
    return files.join(u, "id", "left_semi").select("relative_path").join(changed.select("relative_path"), "relative_path", "left_anti").distinct()


def dependents_by_import(relationships: DataFrame, unresolved: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths of files whose imports name a module that a changed path may be: a specifier's last part is the stem of the path."""
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    stems = changed.select(stem(F.col("relative_path")).alias("stem")).unionByName(changed.where(F.col("relative_path").rlike(r"/index\.[^/]*$")).select(F.substring_index(F.regexp_replace("relative_path", r"/index\.[^/]*$", ""), "/", -1).alias("stem"))).distinct()
    a = relationships.where((F.col("kind").isin("imports", "exports")) & F.col("target_external").isNotNull()).select(F.col("source_file_id").alias("id"), stem(F.col("target_external")).alias("stem"))
    b = unresolved.where(F.col("relationship_kind").isin("imports", "exports")).select(F.col("source_file_id").alias("id"), stem(F.col("target_text")).alias("stem"))
    hit = a.unionByName(b).join(stems, "stem", "left_semi").select("id").distinct()
    return files.join(hit, "id", "left_semi").select("relative_path").join(changed.select("relative_path"), "relative_path", "left_anti").distinct()


def affected_set(changes: DataFrame, by_target: DataFrame, by_unresolved: DataFrame) -> DataFrame:
    """(relative_path, why): the files of a batch and those that depend on them, without the deleted."""
    batch = changes.where("change <> 'deleted'").select("relative_path", F.lit("batch").alias("why"))
    dependent = by_target.select("relative_path").unionByName(by_unresolved.select("relative_path")).distinct().join(changes.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.lit("dependent").alias("why"))
    return batch.unionByName(dependent)


def resolution_snapshot(symbols: DataFrame, files: DataFrame, relationships: DataFrame) -> DataFrame:
    """Symbols, without the stand-ins of files, as resolution needs them, with whether an exports relationship ends there."""
    exported = relationships.where((F.col("kind") == "exports") & F.col("target_symbol_id").isNotNull()).select(F.col("target_symbol_id").alias("id")).distinct().withColumn("exported", F.lit(True))
    s = join_crowded(symbols.where("kind <> 'module'"), files.select(F.col("id").alias("file_id"), "relative_path"), "file_id").join(exported, "id", "left")
    return s.select("id", "relative_path", "name", "qualified_name", "kind", "language", F.coalesce("exported", F.lit(False)).alias("exported"))


def resolution_baseline(symbols: DataFrame, files: DataFrame, relationships: DataFrame, affected: DataFrame, changes: DataFrame) -> DataFrame:
    """What of a snapshot stays as it is: its rows of files that are neither affected nor deleted."""
    gone = affected.select("relative_path").unionByName(changes.where("change = 'deleted'").select("relative_path")).distinct()
    return resolution_snapshot(symbols, files.join(gone, "relative_path", "left_anti"), relationships)


def inbound_to_unresolved(relationships: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """Relationships from elsewhere to symbols of deleted files(file_id), as unresolved references of the same kind."""
    gone = symbols.join(deleted.select("file_id").distinct(), "file_id", "left_semi").select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target_text"))
    r = relationships.join(gone, "target_symbol_id").join(deleted.select(F.col("file_id").alias("source_file_id")).distinct(), "source_file_id", "left_anti")
    return r.select("source_symbol_id", "source_file_id", F.col("kind").alias("relationship_kind"), "target_text", F.lit(0).alias("candidate_count"), F.lit("target symbol's file was deleted").alias("reason"), F.lit("unresolved").alias("confidence"))


def replace_owned(stored: DataFrame, new: DataFrame, gone: DataFrame, owner: str) -> DataFrame:
    """stored without the rows that files of gone(file_id) own, and the new ones."""
    return stored.join(gone.select(F.col("file_id").alias(owner)).distinct(), owner, "left_anti").unionByName(new, allowMissingColumns=True)


def apply_incremental(tables: dict[str, DataFrame], new: dict[str, DataFrame], deleted: DataFrame, rewritten: DataFrame) -> dict[str, DataFrame]:
    """The tables files, symbols, relationships and unresolved after a batch: rows of deleted and rewritten files go, inbound relationships of deleted ones become unresolved, the new rows come."""
    gone = deleted.select("file_id").unionByName(rewritten.select("file_id")).distinct()
    lost = inbound_to_unresolved(tables["relationships"].join(gone.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_anti"), tables["symbols"], deleted)
    dead = tables["symbols"].join(deleted, "file_id", "left_semi").select(F.col("id").alias("target_symbol_id"))
    kept = tables["relationships"].join(dead, "target_symbol_id", "left_anti")
    return {
        "files": replace_owned(tables["files"].withColumn("file_id", F.col("id")), new["files"].withColumn("file_id", F.col("id")), gone, "file_id").drop("file_id"),
        "symbols": replace_owned(tables["symbols"], new["symbols"], gone, "file_id"),
        "relationships": replace_owned(kept, new["relationships"], gone, "source_file_id"),
        "unresolved": replace_owned(tables["unresolved"], new["unresolved"], gone, "source_file_id").unionByName(lost, allowMissingColumns=True),
    }


def upsert(stored: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """stored with the rows of new: a row of the same key takes its values, save those of keep."""
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    merged = new.join(old, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in stored.columns])
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(merged)


def migrate(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with the columns of defaults that it lacks, and their values where they are null."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def needs_full_reindex(stored_version: str | None, current: str) -> bool:
    return stored_version != current
