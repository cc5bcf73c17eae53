"""What the near-duplicate operators share: equal sets of shingles are one class, buckets of classes are joined by their
signatures, and the components that come of it are verified by exact Jaccard similarity.

Only hashes and signatures move while candidates are sought. Texts move once, and only those of classes that a signature
comparison has linked to another. Nothing is capped and no order matters: whatever its size, a bucket or a component is
compared whole, in tiles, each pair of tiles in a task of its own. Within a bucket a row that is already joined to the
component of another is not compared with the rest of it again, so a crowd of near copies costs about one comparison a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import connected_groups, mapped, shingles, sifted

#: Rows of a component that are verified at once, and rows of a bucket that are compared at once; a larger one is cut into tiles, and its tiles meet in pairs.
TILE, BUCKET = 1024, 8192


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k functions x -> (a x + b mod 2^64) >> 32 of 32-bit keys: a strongly universal family."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima (uint32) of every permutation over the keys x, in slices that stay in cache."""
    keys = (x >> np.uint64(32)) ^ (x & np.uint64(0xFFFFFFFF))
    out = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(keys), 512):
        np.minimum(out, (keys[i : i + 512, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def set_key(x: np.ndarray) -> int:
    """The name of a set of shingles; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 if len(x) else 0


def classes(sketches: DataFrame) -> DataFrame:
    """Of sketches(doc_id, set_key, n, ...): (node, doc_id, ...), a row for each set of shingles, under the least id that has it."""
    rest = [c for c in sketches.columns if c not in ("doc_id", "set_key", "n")]
    known = sketches.where("doc_id is not null and n > 0")
    return known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct(*rest)).alias("r")).select(F.col("set_key").alias("node"), "doc_id", "r.*")


def sorted_runs(it: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from sorted batches, several runs to a frame."""
    held: list[pd.DataFrame] = []
    for pdf in it:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if (k != k[-1]).any() else 0
        if cut == 0:
            if held and held[-1][key].iloc[-1] != k[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def bounds(k: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(k):
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        yield from zip(at[:-1].tolist(), at[1:].tolist())


def forest(ids: np.ndarray, sig: np.ndarray, need: float) -> list[tuple[int, int]]:
    """Edges that span the components of rows of which two are joined if their signatures agree in `need` places or more."""
    if len(ids) == 2:
        return [(ids[0], ids[1])] if (sig[0] == sig[1]).sum() >= need else []
    out, left, rest = [], np.arange(len(ids)), sig
    while len(left) > 1:
        queue = [int(left[0])]
        left, rest = left[1:], rest[1:]
        while queue and len(left):
            i = queue.pop()
            near = (rest == sig[i]).sum(axis=1) >= need
            if near.any():
                found = left[near]
                out += [(ids[i], ids[j]) for j in found.tolist()]
                queue += found.tolist()
                left, rest = left[~near], rest[~near]
    return out


def tiled(rows: DataFrame, group: str, size: str, node: str, most: int) -> DataFrame:
    """rows with a column `tile`: groups of up to `most` rows are a tile, of a larger one every row goes to each pair of parts that its own belongs to; part says which that is."""
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    mine = F.pmod(F.xxhash64(node, F.lit(5)), parts.cast("long")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", mine).withColumn("other", F.explode(F.expr("if(parts = 1, array(0), filter(sequence(0, parts - 1), x -> x <> part))")))
    return rows.withColumn("tile", F.xxhash64(F.col(group), F.least("part", "other"), F.greatest("part", "other")))


def bucket_edges(buckets: DataFrame, least: float, width: int) -> DataFrame:
    """(a, b): edges that span, in each of the buckets(bucket, size, node, sig), the components of nodes whose signatures agree in `least` of the places; sig holds `width` 16-bit values."""

    def run(it):
        for pdf in sorted_runs(it, "tile"):
            k, ids = pdf["tile"].to_numpy(), pdf["node"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(-1, width)
            out: dict[tuple[int, int], None] = {}
            for lo, hi in bounds(k):
                if hi - lo > 1:
                    out |= dict.fromkeys(forest(ids[lo:hi], sig[lo:hi], least * width))
            if out:
                yield pd.DataFrame(list(out), columns=["a", "b"], dtype=np.int64)

    rows = tiled(buckets, "bucket", "size", "node", BUCKET).select("tile", "node", "sig")
    edges = mapped(rows.repartition("tile").sortWithinPartitions("tile", "node"), run, "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(sets: list[np.ndarray], least: float, part: np.ndarray | None = None) -> np.ndarray:
    """Whether each two of sets (sorted, distinct) are `least` alike or more, as a matrix; never a set and itself, and with part, only those of unlike parts."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    both = np.zeros((n, n), dtype=np.float32)
    if n <= 3:
        for i in range(n):
            for j in range(i + 1, n):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        row = np.repeat(np.arange(n), size)
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[col] > 1
        row, col = row[common], (np.cumsum(times > 1) - 1)[col[common]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        step = 2048
        cuts = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + step + 1, step))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo < hi:
                used, local = np.unique(row[lo:hi], return_inverse=True)
                m = np.zeros((len(used), step), dtype=np.float32)
                m[local, col[lo:hi] - k * step] = 1
                both[np.ix_(used, used)] += m @ m.T
    ok = both / (size[:, None] + size[None, :] - both) >= least
    np.fill_diagonal(ok, False)
    if part is not None:
        ok &= part[:, None] != part[None, :]
    return ok


def spanning(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric matrix."""
    out, left = [], np.ones(len(ok), dtype=bool)
    for s in range(len(ok)):
        queue = [s] if left[s] else []
        left[s] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(ok[i] & left).tolist()
            left[found] = False
            out += [(i, j) for j in found]
            queue += found
    return out


def verified(docs: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, least: float, give: str) -> DataFrame:
    """What exact similarity makes of the components of edges(a, b): every two of their sets are compared.

    nodes(node, doc_id) says where the text of a class stands. give: "pairs" (a, b, jaccard), a < b, of those `least` alike
    or more, "links" (node, links), how many others each is linked to, or "forest" (a, b) that spans the linked.
    """
    groups = connected_groups(edges)
    sized = groups.join(groups.groupBy("root").agg(F.count("*").alias("size")), "root")
    members = sized.join(nodes.select("node", "doc_id"), "node")

    def cut(it):
        for pdf in it:
            x = [shingles(t, k) for t in pdf["text"]]
            pdf["set"] = [s.tobytes() for s in x]
            yield pdf.loc[np.array([set_key(s) for s in x], dtype=np.int64) == pdf["node"].to_numpy(), ["doc_id", "node", "root", "size", "set"]]

    texts = sifted(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id", members.select("doc_id"), "may").where("may").drop("may")
    sets = mapped(texts.join(members, "doc_id"), cut, "doc_id long, node long, root long, size long, set binary").dropDuplicates(["doc_id", "node"])
    spread = tiled(sets, "root", "size", "node", TILE).select("tile", "node", "set", "part", "parts", "other")

    def run(it):
        for pdf in sorted_runs(it, "tile"):
            t, ids, part, parts, other, raw = (pdf[c].to_numpy() for c in ("tile", "node", "part", "parts", "other", "set"))
            out: list[pd.DataFrame] = []
            for lo, hi in bounds(t):
                # of a component in parts, a part's own pairs are counted where it meets the next part
                own = other[lo:hi] == (part[lo:hi] + 1) % parts[lo:hi] if parts[lo] > 1 else np.ones(hi - lo, dtype=bool)
                sets_ = [np.frombuffer(x, dtype=np.uint64) for x in raw[lo:hi]]
                ok = alike(sets_, least)
                if not own.all():
                    p = part[lo:hi]
                    ok &= (p[:, None] != p[None, :]) | (own[:, None] & own[None, :])
                node = ids[lo:hi]
                if give == "links":
                    out.append(pd.DataFrame({"node": node, "links": ok.sum(axis=1)}))
                    continue
                i, j = np.array(spanning(ok), dtype=np.int64).reshape(-1, 2).T if give == "forest" else np.nonzero(np.triu(ok))
                found = pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})
                if give == "pairs":
                    n = np.array([len(np.intersect1d(sets_[x], sets_[y], assume_unique=True)) for x, y in zip(i, j)], dtype=float)
                    size = np.array([len(s) for s in sets_], dtype=float)
                    found["jaccard"] = n / (size[i] + size[j] - n)
                out.append(found)
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = {"pairs": "a long, b long, jaccard double", "links": "node long, links long", "forest": "a long, b long"}[give]
    got = mapped(spread.repartition("tile").sortWithinPartitions("tile", "node"), run, schema)
    return got.groupBy("node").agg(F.sum("links").alias("links")) if give == "links" else got
