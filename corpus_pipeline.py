"""A corpus pipeline: quality filter, near-dedup, decontamination, mixing and binary output, each stage over all that the one before kept.

Every stage takes any table with the columns of documents. Rows with a null, empty or blank text go in the first stage
(and add nothing to mixing); rows with a null id are judged by their text alone and never count as copies; equal rows are
judged alike; a null source is the source '', very long texts are taken whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.chosen import drop_near_duplicates
from quillgraph.llm.coder import write_blocks
from quillgraph.llm.common import table, written
from quillgraph.llm.fmindex import decontaminate
from quillgraph.llm.mixing import mix_documents
from quillgraph.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of all sources in target weights, as documents of their own."""
    return mix_documents(docs)


def binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in range-coded, checksummed blocks."""
    return write_blocks(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("binary", binary)]
#: No stage but the identity of rows can be told in SQL: all are models, sketches or codes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
