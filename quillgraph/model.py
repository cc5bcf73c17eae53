"""Domains, table schemas and content-derived identities of the code graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 6
ANALYZER_VERSION = "quillgraph-1"

SYMBOL_KINDS = tuple("module namespace class interface struct enum function method constructor property field variable parameter typealias import export".split())
RELATIONSHIP_KINDS = tuple("defines contains imports exports references calls constructs inherits implements overrides usestype reads writes decorates injects registeredas handlesroute triggers persiststo".split())
FRAMEWORK_KINDS = ("injects", "registeredas", "handlesroute", "triggers", "persiststo")
ROLES = tuple("controller route service repository component decorator".split())
VISIBILITIES = tuple("public protected internal private protectedinternal privateprotected default".split())
PROVENANCES = ("extracted", "resolved", "heuristic")
#: From the weakest to the strongest; the place is the rank.
CONFIDENCES = ("unresolved", "low", "medium", "high", "exact")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "cs": "csharp"}
UNIT = "\x1f"


def _schema(ddl: str) -> str:
    return ddl


#: DDL of every stored table.
SCHEMAS = {
    "projects": _schema("id string, name string, root_path string, config_hash string, created_at string, updated_at string, analyzer_version string"),
    "files": _schema("id string, project_id string, relative_path string, language string, size_bytes long, parse_status string, parse_error string, generation int, created_at string, updated_at string, content_hash string, modified_ns long"),
    "symbols": _schema(
        "id string, project_id string, file_id string, symbol_key string, name string, qualified_name string, kind string, language string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, provenance string, confidence string, is_exported boolean, visibility string, is_partial boolean, is_record boolean, roles array<string>, generation int, created_at string, updated_at string"
    ),
    "relationships": _schema(
        "id string, project_id string, source_symbol_id string, target_symbol_id string, target_external string, kind string, provenance string, confidence string, source_file_id string, start_line int, start_column int, reason string, generation int, created_at string, updated_at string"
    ),
    "unresolved_references": _schema(
        "id string, project_id string, source_symbol_id string, source_file_id string, relationship_kind string, target_text string, context_json string, candidate_count int, reason string, confidence string, generation int, created_at string, updated_at string"
    ),
    "index_state": _schema("project_id string, pending_files long, last_verified_at string, updated_at string"),
    "schema_migrations": _schema("version int, applied_at string"),
}


@dataclass
class Graph:
    """The tables that queries read. Columns beyond those that a query names are never looked at."""

    files: DataFrame
    symbols: DataFrame
    relationships: DataFrame
    unresolved: DataFrame
    state: DataFrame


def hash_id(prefix: str, text: Column) -> Column:
    """prefix-, and the first 32 digits of the SHA-256 of text."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 32))


def symbol_key(language: Column, path: Column, kind: Column, qualified_name: Column, fingerprint: Column, ordinal: Column | None = None) -> Column:
    """Identity of a declaration, free of its position: language, path, kind, name, fingerprint and, for partial declarations, the ordinal."""
    base = F.concat_ws(UNIT, language, path, kind, qualified_name, fingerprint)
    return F.sha2(base if ordinal is None else F.when(ordinal.isNull(), base).otherwise(F.concat_ws(UNIT, base, ordinal.cast("string"))), 256)


def validate_enums(df: DataFrame, **domains: tuple[str, ...]) -> DataFrame:
    """Rows of df with a value that its domain doesn't know (null is no value of any)."""
    bad = F.lit(False)
    for column, domain in domains.items():
        bad = bad | ~F.coalesce(F.col(column).isin(*domain), F.lit(False))
    return df.where(bad)
