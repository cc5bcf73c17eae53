"""Full-text search over symbols: a phrase within one column, and a search by parts of names where that finds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import Graph
from quillgraph.operators.queries import with_paths

COLUMNS = ("name", "qualified_name", "kind", "relative_path")


def search(g: Graph, query: str, limit: int | None = 50) -> DataFrame:
    """Symbols with the words of query in a row in their name, qualified name, kind or path, by name."""
    s = with_paths(g)
    found = s.where(X.phrase_match(query, *map(F.col, COLUMNS))).orderBy("name", "id")
    return found if limit is None else found.limit(limit)


def search_partial(g: Graph, query: str, limit: int | None = 50) -> DataFrame:
    """Symbols whose name has every term of query in it, those that begin with the first term before the others."""
    spark = g.symbols.sparkSession
    terms = spark.range(1).select(X.partial_terms(F.lit(query)).alias("t")).first()["t"]
    s = with_paths(g)
    if not terms:
        return s.limit(0)
    low = F.lower("name")
    for t in terms:
        s = s.where(F.contains(low, F.lit(t)))
    found = s.orderBy(F.when(F.startswith(low, F.lit(terms[0])), 0).otherwise(1), "name", "id")
    return found if limit is None else found.limit(limit)


def find(g: Graph, query: str, limit: int | None = 50) -> DataFrame:
    """search(), or search_partial() where that has no hit."""
    hits = search(g, query, limit)
    return hits if not hits.isEmpty() else search_partial(g, query, limit)
