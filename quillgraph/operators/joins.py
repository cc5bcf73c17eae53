"""Joins on columns of which few values have very many rows, as the files of a mapped table have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one value from which they stay where they are and the other side is broadcast: of n rows, at most n / MANY values.
MANY = 100_000


def join_crowded(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left.join(right, key), where right has one row, or few, for each value: no task gets all of a value that left has very often."""
    crowds = F.broadcast(left.groupBy(key).count().where((F.col("count") >= MANY) & F.col(key).isNotNull()).select(key))
    near = left.join(F.broadcast(right.join(crowds, key, "left_semi")), key)
    return near.unionByName(left.join(crowds, key, "left_anti").join(right, key))
