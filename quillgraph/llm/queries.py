"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import chat
from quillgraph.llm.chosen import near_duplicates
from quillgraph.llm.coder import write_blocks
from quillgraph.llm.common import table
from quillgraph.llm.fmindex import leaked_spans
from quillgraph.llm.lines import repeated_lines
from quillgraph.llm.minhash import linked_documents
from quillgraph.llm.mixing import mixed_blocks
from quillgraph.llm.quality import score_quality
from quillgraph.llm.templates import main_text
from quillgraph.llm.toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic once their words are restored."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("toxic = 1")


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without its site's templates."""
    return main_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many blocks as there are, drawn by the sources' target weights."""
    return mixed_blocks(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats another one, with the occurrence that is kept."""
    return repeated_lines(table(spark, sf_dir, "documents"), sketches=True)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that repeat benchmark passages."""
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return score_quality(table(spark, sf_dir, "documents")).where("keep = 1")


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies, each with the document that stands for its group."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal sets and the number of classes that it is linked to."""
    return linked_documents(table(spark, sf_dir, "documents"))


def op9_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents in coded blocks."""
    return write_blocks(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best paths of every reply tree as conversations."""
    return chat.branch_conversations(chat.reply_tree(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_templates": op2_templates,
    "op3_mixing": op3_mixing,
    "op4_lines": op4_lines,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_near": op7_near,
    "op8_fingerprints": op8_fingerprints,
    "op9_binary": op9_binary,
    "op10_chat": op10_chat,
}
ORACLES: dict[str, str] = {"op10_chat": chat.SQL}
