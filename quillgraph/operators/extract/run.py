"""The extractor over a table of sources: one row for every symbol and every relationship, file by file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.extract import csharp, web
from quillgraph.operators.extract.ir import Analysis

COLUMNS = "relative_path string, row string, local_key string, name string, qualified_name string, kind string, language string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, visibility string, is_partial boolean, is_record boolean, roles array<string>, is_exported boolean, top_level boolean, pos int, source_key string, tag string, target string, specifier string, provenance string, confidence string, reason string, status string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def analyze(path: str, language: str, source: str) -> Analysis:
    return csharp.analyze(path, source) if language == "csharp" else web.analyze(path, language, source)


def rows(path: str, language: str, source: str) -> list[dict]:
    """Rows of one file, the stand-in symbol of the file itself first. A file that can't be analyzed has only that one, and the error as its status."""
    module = {"row": "symbol", "local_key": path, "name": path, "qualified_name": path, "kind": "module", "start_byte": 0, "end_byte": 0, "start_line": 1, "start_column": 0, "end_line": 1, "end_column": 0, "visibility": "default", "is_partial": False, "is_record": False, "roles": [], "is_exported": False, "top_level": False, "pos": -1, "status": "ok"}
    try:
        a = analyze(path, language, source)
    except Exception as e:  # one file must not end the job; its status says what went wrong
        return [module | {"relative_path": path, "language": language, "status": f"{type(e).__name__}: {e}"}]
    out = [module]
    seen = set()
    for i, s in enumerate(a.symbols):
        if s.local_key in seen:
            continue
        seen.add(s.local_key)
        b, line, column = a.place(s.start)
        b2, line2, column2 = a.place(max(s.end, s.start))
        out.append({"row": "symbol", "local_key": s.local_key, "name": s.name, "qualified_name": s.qualified_name, "kind": s.kind, "start_byte": b, "start_line": line, "start_column": column, "end_byte": b2, "end_line": line2, "end_column": column2, "visibility": s.visibility, "is_partial": s.is_partial, "is_record": s.is_record, "roles": sorted(s.roles), "is_exported": s.exported, "top_level": s.top_level, "pos": i})
    for i, e in enumerate(a.edges):
        b, line, column = a.place(e.at)
        out.append({"row": "edge", "roles": [], "kind": e.kind, "source_key": e.source, "tag": e.tag, "target": e.target, "specifier": e.specifier, "provenance": e.provenance, "confidence": e.confidence, "reason": e.reason, "start_byte": b, "start_line": line, "start_column": column, "pos": i})
    return [r | {"relative_path": path, "language": language} for r in out]


def extract(sources: DataFrame) -> DataFrame:
    """Rows of COLUMNS for sources(relative_path, language, source); null sources are passed over."""

    def run(it):
        for pdf in it:
            got = [r for p, lang, s in zip(pdf["relative_path"], pdf["language"], pdf["source"]) if s is not None for r in rows(p, lang, s)]
            df = pd.DataFrame({c: pd.Series([r.get(c) for r in got], dtype=object) for c in NAMES})
            for c in ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"):
                df[c] = df[c].astype("Int64")
            df["pos"] = df["pos"].astype("Int32")
            for c in ("is_partial", "is_record", "is_exported", "top_level"):
                df[c] = df[c].astype("boolean")
            yield df

    return sources.select("relative_path", "language", "source").mapInPandas(run, COLUMNS)


def symbol_rows(found: DataFrame) -> DataFrame:
    return found.where(F.col("row") == "symbol")


def edge_rows(found: DataFrame) -> DataFrame:
    return found.where(F.col("row") == "edge")
