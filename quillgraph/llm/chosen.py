"""Near-duplicates by a chosen-path set similarity join: every tree branches documents by minwise tokens that its nodes
select, small nodes are compared exhaustively, and independent trees are repeated until the target recall is met."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, connected_groups, mapped, mix64, shingles, sifted, written
from quillgraph.llm.near import bucket_edges, classes, permutations, set_key, signature, verified

#: Nodes up to this size are compared; larger ones branch again, for DEPTH levels at most: what is still together then is compared too, whatever its size.
NODE = 256
DEPTH = 4


def trees_for(recall: float, threshold: float, branches: int) -> int:
    """Trees that find a pair of similarity `threshold` with probability `recall`, if each of the DEPTH levels of nodes had to branch."""
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - (1 - threshold * p) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _children(node: np.ndarray, minima: np.ndarray, branches: int) -> np.ndarray:
    """Hashes (rows, branches) of the children that rows enter: each node selects `branches` of the minwise tokens, the same for all its rows."""
    out = np.empty((len(node), branches), dtype=np.uint64)
    width = np.uint64(minima.shape[1] // branches)
    for b in range(branches):
        c = mix64(node + np.uint64(b + 1)) % width + width * np.uint64(b)
        token = minima[np.arange(len(node)), c.astype(np.int64)].astype(np.uint64)
        out[:, b] = mix64(mix64(node ^ mix64(c + np.uint64(1))) + token)
    return out


def sketches(docs: DataFrame, k: int, width: int, seed: int) -> DataFrame:
    """(doc_id, set_key, n, minima, sig): the minwise tokens (uint32) of the k-word shingles of each text and their low halves."""
    a, b = permutations(width, seed)

    def run(it):
        for pdf in it:
            out: dict[str, list] = {"set_key": [], "n": [], "minima": [], "sig": []}
            for t in pdf["text"]:
                x = shingles(t, k)
                s = signature(x, a, b) if len(x) else np.empty(0, np.uint32)
                out["n"].append(len(x))
                out["set_key"].append(set_key(x))
                out["minima"].append(s.tobytes())
                out["sig"].append(s.astype(np.uint16).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"]} | out)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, set_key long, n int, minima binary, sig binary")


def near_sets(docs: DataFrame, threshold: float = 0.6, k: int = 3, width: int = 96, branches: int = 2, recall: float = 0.98, margin: float = 0.12, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The sketches (doc_id, set_key) of all rows with a word, and edges (a, b) that span the components of their verified sets."""
    sk = written(sketches(docs, k, width, seed), "chosen")
    reps = written(classes(sk), "reps")
    count = trees_for(recall, threshold, branches)
    roots = mix64(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1000003))

    def plant(it):
        for pdf in it:
            if len(pdf):
                m = np.frombuffer(b"".join(pdf["minima"]), np.uint32).reshape(len(pdf), width)
                kids = np.concatenate([_children(np.full(len(pdf), r), m, branches) for r in roots], axis=1)
                yield pd.DataFrame({"bucket": kids.astype(np.int64).ravel(), "node": np.repeat(pdf["node"].to_numpy(), kids.shape[1])})

    def branch(it):
        for pdf in it:
            if len(pdf):
                m = np.frombuffer(b"".join(pdf["minima"]), np.uint32).reshape(len(pdf), width)
                kids = _children(pdf["bucket"].to_numpy().astype(np.uint64), m, branches)
                yield pd.DataFrame({"bucket": kids.astype(np.int64).ravel(), "node": np.repeat(pdf["node"].to_numpy(), branches)})

    rows = mapped(reps.select("node", "minima"), plant, "bucket long, node long")
    small = None
    for depth in range(1, DEPTH + 1):
        sized = checkpoint(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
        done = sized if depth == DEPTH else sized.where(F.col("size") <= NODE)
        done = done.select("bucket", "size", "node")
        small = done if small is None else small.unionByName(done)
        large = sized.where(F.col("size") > NODE)
        if depth == DEPTH or large.isEmpty():
            break
        rows = mapped(large.select("bucket", "node").join(reps.select("node", "minima"), "node").select("bucket", "node", "minima"), branch, "bucket long, node long")
    edges = checkpoint(bucket_edges(small.join(reps.select("node", "sig"), "node"), threshold - margin, width))
    return sk.where("doc_id is not null and n > 0").select("doc_id", "set_key"), verified(docs, reps.select("node", "doc_id"), edges, k, threshold, "forest")


def near_duplicates(docs: DataFrame, threshold: float = 0.6, k: int = 3, recall: float = 0.98, seed: int = 7) -> DataFrame:
    """(doc_id, kept_id): every document that is a copy or near copy, with the document that stands for its group.

    Two documents are near if the sets of their k-word shingles are `threshold` alike or more (verified, not estimated);
    groups are the connected components of such pairs, and the least id of a group stays. Rows with a null id, a null text
    or without a word belong to no group. Rows repeated under one id count once; an id whose rows have different sets
    belongs to no group either, though one of its texts may link others. A very long text is one set like any other. Other
    columns are ignored; an empty table gives no rows. The trees find a pair at the threshold with probability `recall` or more.
    """
    sk, edges = near_sets(docs, threshold, k, recall=recall, seed=seed)
    least = sk.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    groups = connected_groups(edges).withColumnRenamed("node", "set_key")
    named = least.join(groups, "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), "doc_id")
    kept = named.groupBy("root").agg(F.min("doc_id").alias("kept_id"))
    single = sk.groupBy("doc_id").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("top")).where("set_key = top").drop("top")
    # few rows a class: a class of very many copies is split by AQE's skew join, for nothing but two numbers a row moves
    return single.join(named.select("set_key", "root").join(kept, "root").drop("root"), "set_key").where("doc_id <> kept_id").select("doc_id", "kept_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they were, without those that near_duplicates() lists. Rows with a null id, and all rows of an id with different texts, stay."""
    gone = checkpoint(near_duplicates(docs, **options).select(F.col("doc_id").alias("_gone")))
    # only rows that may go take part in a shuffle
    marked = sifted(docs, "doc_id", gone.select(F.col("_gone").alias("doc_id")), "_may")
    doubtful = marked.where("_may")
    return marked.where("not _may").unionByName(doubtful.join(gone, doubtful["doc_id"] == gone["_gone"], "left_anti")).drop("_may")
