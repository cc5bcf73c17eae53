"""Document fingerprints: MinHash signatures, banded in Spark, with the similarity of every linked pair verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, mapped, shingles, written
from quillgraph.llm.near import bucket_edges, classes, permutations, set_key, signature, verified


def fingerprints(docs: DataFrame, k: int = 3, bands: int = 20, rows: int = 5, seed: int = 8) -> DataFrame:
    """(doc_id, set_key, n, sig, bands) for every row of docs(doc_id, text).

    n is the number of distinct k-word shingles (0 for a null text or one without words: no signature, no bands),
    set_key a hash of all of them, sig the low 16 bits of bands * rows minima, bands a hash for each band.
    """
    a, b = permutations(bands * rows, seed)

    def run(it):
        for pdf in it:
            out: dict[str, list] = {"set_key": [], "n": [], "sig": [], "bands": []}
            for t in pdf["text"]:
                x = shingles(t, k)
                out["n"].append(len(x))
                out["set_key"].append(set_key(x))
                if len(x):
                    s = signature(x, a, b)
                    out["sig"].append(s.astype(np.uint16).tobytes())
                    out["bands"].append([xxhash.xxh3_64_intdigest(s[i : i + rows].tobytes(), seed=i) - 2**63 for i in range(0, len(s), rows)])
                else:
                    out["sig"].append(b"")
                    out["bands"].append([])
            yield pd.DataFrame({"doc_id": pdf["doc_id"]} | out)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, set_key long, n int, sig binary, bands array<long>")


def _linked(docs: DataFrame, threshold: float, k: int, bands: int, rows: int, margin: float, seed: int, give: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows (doc_id, set_key, n), and what verified() gives of their classes."""
    sk = written(fingerprints(docs, k, bands, rows, seed), "fingerprints")
    nodes = classes(sk)
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = spread.join(shared, "bucket").join(nodes.select("node", "sig"), "node")
    edges = checkpoint(bucket_edges(buckets, threshold - margin, bands * rows))
    return sk.select("doc_id", "set_key", "n"), verified(docs, classes(sk.select("doc_id", "set_key", "n", F.lit(0).alias("x"))), edges, k, threshold, give)


def linked_documents(docs: DataFrame, threshold: float = 0.6, k: int = 3, bands: int = 20, rows: int = 5, margin: float = 0.12, seed: int = 8) -> DataFrame:
    """(doc_id, class_id, links) for every document of docs(doc_id, text): its class, and to how many other classes it is linked.

    Documents with the same set of k-word shingles are one class, named by the least id among them. Two classes are linked
    if their sets are `threshold` alike or more. A pair of similarity s shares a band with probability
    1 - (1 - s^rows)^bands (0.80 at 0.6, 0.97 at 0.7, 0.9995 at 0.8); all pairs of one component are verified, which finds
    most of the rest. A document without a word (a null or empty text) is its own class, without links. Rows with a null id
    are left out; rows repeated under one id count once, or once for each set if their texts differ. A very long text is
    one set like any other. Other columns are ignored; an empty table gives no rows.
    """
    sk, links = _linked(docs, threshold, k, bands, rows, margin, seed, "links")
    one = sk.where("doc_id is not null").distinct()
    named = one.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id")).join(links.withColumnRenamed("node", "set_key"), "set_key", "left")
    full = one.join(named, "set_key", "left")
    return full.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(docs: DataFrame, threshold: float = 0.6, k: int = 3, bands: int = 20, rows: int = 5, margin: float = 0.12, seed: int = 8) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: the links of linked_documents() as pairs of class names, and a pair (jaccard 1) of each class name with every other document of its class.

    So a group of n equal copies gives n - 1 rows and not n^2; n unlike near copies give all their pairs.
    """
    sk, pairs = _linked(docs, threshold, k, bands, rows, margin, seed, "pairs")
    known = sk.where("doc_id is not null and n > 0")
    named = known.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    a, b = (named.select(F.col("set_key").alias(c), F.col("class_id").alias(f"doc_{c}")) for c in "ab")
    links = pairs.join(a, "a").join(b, "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    copies = known.join(named, "set_key").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    return links.unionByName(copies).where("doc_a < doc_b")
