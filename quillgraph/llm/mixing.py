"""Mixing sources to target weights: token blocks of one length, multinomial draws for every output shard, and
pseudorandom permutations that turn slots into block indices without moving or sorting anything."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import TOKENIZERS, encode_bytes, encoder, mapped, mix64, running, written

BLOCK = 2048
SHARD = 256
_ROUNDS = np.array([0x9E3779B97F4A7C15 * (r + 1) % 2**64 for r in range(4)], dtype=np.uint64)


def token_blocks(docs: DataFrame, block: int = BLOCK, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(source, part, seq, n_docs, ids): the texts of each source as blocks of `block` ids.

    Texts of one input partition and source follow each other, each with an end mark. A block ends where a character does:
    where its last ids are the first bytes of a character that the next id ends, they go to the next block, and end marks
    take their place. What doesn't fill the last block of a partition is padded with end marks too, so no token is lost.
    ids are little-endian 16-bit numbers. A null source is the source ''. A null or empty text adds nothing.
    """
    if block < 8:
        raise ValueError("a block must have room for a character")

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        mark = np.array([encoder(tokenizers, vocabulary).n_vocab], dtype=np.uint16).tobytes()
        inner = _inner(tokenizers, vocabulary)
        held: dict[str, bytearray] = {}
        begun: dict[str, int] = {}
        seq: dict[str, int] = {}
        width = 2 * block
        for pdf in it:
            rows = []
            for s, t in zip(pdf["source"].fillna(""), pdf["text"]):
                if not t:
                    continue
                buf = held.setdefault(s, bytearray())
                buf += encode_bytes(t, tokenizers, vocabulary) + mark
                begun[s] = begun.get(s, 0) + 1
                at = 0
                while len(buf) - at > width:  # with the id that follows the block
                    end = at + width
                    while inner[buf[end] | buf[end + 1] << 8]:
                        end -= 2
                    k = seq[s] = seq.get(s, -1) + 1
                    rows.append((s, part, k, begun[s], bytes(buf[at:end]) + mark * ((at + width - end) // 2)))
                    begun[s] = 0
                    at = end
                if at:
                    del buf[:at]
            if rows:
                yield pd.DataFrame(rows, columns=["source", "part", "seq", "n_docs", "ids"])
        rows = [(s, part, seq.get(s, -1) + 1, begun[s], bytes(b) + mark * (block - len(b) // 2)) for s, b in held.items() if b]
        if rows:
            yield pd.DataFrame(rows, columns=["source", "part", "seq", "n_docs", "ids"])

    return mapped(docs.select("source", "text"), run, "source string, part int, seq long, n_docs int, ids binary")


@lru_cache(maxsize=4)
def _inner(tokenizers: str, vocabulary: str) -> np.ndarray:
    """For each id, whether its first byte goes on with a character that began before."""
    enc = encoder(tokenizers, vocabulary)
    out = np.zeros(1 << 16, dtype=bool)
    for i in range(enc.n_vocab):
        out[i] = enc.decode_single_token_bytes(i)[0] & 0xC0 == 0x80
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. n - 1 at the places i, for each key: a Feistel network of four rounds, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n.astype(float)))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    on = np.arange(len(x))
    while len(on):
        left, right = x[on] >> half[on], x[on] & mask[on]
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[on] * np.uint64(2654435761) + _ROUNDS[r]) & mask[on])
        x[on] = (left << half[on]) | right
        on = on[x[on] >= n[on]]
    return x.astype(np.int64)


def source_key(source: str, epoch: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{epoch}|{source}", seed=seed)


def shares(sizes: dict[str, int], weights: dict[str, float] | None, power: float) -> dict[str, float]:
    """Probability of each source that has blocks: as in weights (what they don't name gets none), or else sizes to a power."""
    w = {s: (float(weights.get(s, 0.0)) if weights is not None else float(n) ** power) for s, n in sizes.items() if n > 0}
    if any(not x >= 0 or x == float("inf") for x in w.values()):
        raise ValueError("weights must be finite and not negative")
    total = sum(w.values())
    return {s: x / total for s, x in w.items() if x > 0} if total > 0 else {}


def draws(spark, share: dict[str, float], shards: int, per_shard: int, total: int, seed: int) -> DataFrame:
    """(shard, source, n, first): multinomial counts of every output shard, and how many slots of the source came in earlier shards."""
    names = sorted(share)
    p = np.array([share[s] for s in names])

    def run(it):
        for pdf in it:
            rows = []
            for j in pdf["id"].tolist():
                size = min(per_shard, total - j * per_shard)
                c = np.random.default_rng([seed, j]).multinomial(size, p / p.sum())
                rows += [(j, s, int(k)) for s, k in zip(names, c) if k]
            yield pd.DataFrame(rows, columns=["shard", "source", "n"])

    counted = mapped(spark.range(shards), run, "shard long, source string, n long")
    return running(counted, ["source"], "shard", "n", "first")


#: Sources that a mixture may have: their sizes and names go to the driver and to every task.
MOST_SOURCES = 100_000


def mixed_blocks(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, n_blocks: int | None = None, block: int = BLOCK, per_shard: int = SHARD, seed: int = 3, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(shard, slot, source, epoch, index, n_docs, ids): `per_shard` blocks for each output shard (the last may be shorter), n_blocks in all (None: as many as there are).

    How many slots of a shard a source gets is drawn from a multinomial of its weights. The q-th slot of a source of N
    blocks takes the block whose index a permutation of its own, for each epoch q div N, gives for q mod N: no block comes
    again before all have come. Within a shard, the slots of the sources are permuted too. A source without blocks, or
    with weight 0, is not drawn; if none is left, or the table is empty, there are no rows. Null sources count as '', null
    and empty texts add nothing, a very long text goes over many blocks, repeated rows count each time; doc_id and other
    columns are not used. Beyond MOST_SOURCES sources it raises ValueError.
    """
    return _joined(docs, weights, power, n_blocks, block, per_shard, seed, tokenizers, vocabulary, None)


def _joined(docs, weights, power, n_blocks, block, per_shard, seed, tokenizers, vocabulary, langs: DataFrame | None) -> DataFrame:
    """The rows of mixed_blocks(), with the lang of their source if langs(source, lang) is given."""
    spark = docs.sparkSession
    blocks = written(token_blocks(docs, block, tokenizers, vocabulary), "blocks")
    parts = running(blocks.groupBy("source", "part").agg(F.count("*").alias("n")), ["source"], "part", "n", "base")
    counted = blocks.groupBy("source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give texts a coarser source before mixing them")
    sizes = {r["source"]: r["n"] for r in counted}
    share = shares(sizes, weights, power)
    total = (sum(sizes.values()) if n_blocks is None else n_blocks) if share else 0
    shards = -(-total // per_shard)

    def slots(it):
        for pdf in it:
            out: dict[str, list] = {k: [] for k in ("shard", "slot", "source", "epoch", "index")}
            for j, s, n, first, at in zip(pdf["shard"].tolist(), pdf["source"], pdf["n"].tolist(), pdf["first"].tolist(), pdf["at"].tolist()):
                size = sizes[s]
                epoch, place = np.divmod(np.arange(first, first + n), size)
                known, which = np.unique(epoch, return_inverse=True)
                key = np.array([source_key(s, e, seed) for e in known.tolist()], dtype=np.uint64)[which]
                m = min(per_shard, total - j * per_shard)
                out["index"].append(permuted(place, np.full(n, size), key))
                out["slot"].append(permuted(np.arange(at, at + n), np.full(n, m), np.full(n, source_key("", j, seed + 1), dtype=np.uint64)))
                out["epoch"].append(epoch)
                out["shard"].append(np.full(n, j))
                out["source"].append(np.full(n, s, dtype=object))
            if len(pdf):
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    drawn = draws(spark, share, shards, per_shard, total, seed)
    drawn = drawn.withColumn("at", F.sum("n").over(W.partitionBy("shard").orderBy("source").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["at"])
    # few rows become many: spread them first, and never broadcast what they become
    wanted = mapped(drawn.repartition(max(1, -(-shards // 64)), "shard"), slots, "shard long, slot long, source string, epoch long, index long")
    if langs is not None:
        wanted = wanted.join(langs, "source", "left")
    # where each index stands is told by narrow rows, so the blocks themselves move once
    places = blocks.select("source", "part", "seq").join(parts.select("source", "part", "base"), ["source", "part"]).select("source", (F.col("base") + F.col("seq")).alias("index"), "part", "seq")
    placed = wanted.hint("merge").join(places, ["source", "index"])
    return placed.hint("merge").join(blocks, ["source", "part", "seq"]).select("shard", "slot", "source", "epoch", "index", "n_docs", "ids", *(["lang"] if langs is not None else []))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed blocks as documents (doc_id, text, lang, source, n_chars): doc_id numbers the slots of all shards, text is what the ids of a block decode to.

    End marks become blank lines (those that pad, nothing); blocks end where characters do, so no byte is lost. lang is the
    source's most frequent one in the input, as a block may join several documents. The rest is as in mixed_blocks().
    """
    per = options.get("per_shard", SHARD)
    tokenizers, vocabulary = options.get("tokenizers", TOKENIZERS), options.get("vocabulary", "byte_bpe_50k.tiktoken")
    langs = docs.groupBy(F.coalesce("source", F.lit("")).alias("source"), "lang").agg(F.count("*").alias("c")).groupBy("source").agg(F.min_by("lang", F.struct(-F.col("c"), "lang")).alias("lang"))

    def run(it):
        enc = encoder(tokenizers, vocabulary)
        for pdf in it:
            texts = []
            for raw in pdf["ids"]:
                x = np.frombuffer(raw, dtype=np.uint16)
                cuts = np.flatnonzero(x == enc.n_vocab)
                texts.append("\n\n".join(t for t in (enc.decode_bytes(p[p < enc.n_vocab].tolist()).decode("utf-8") for p in np.split(x, cuts)) if t))
            yield pd.DataFrame({"doc_id": pdf["shard"] * per + pdf["slot"], "text": texts, "lang": pdf["lang"], "source": pdf["source"], "n_chars": [len(t) for t in texts]})

    full = {"weights": None, "power": 0.7, "n_blocks": None, "block": BLOCK, "per_shard": SHARD, "seed": 3, "tokenizers": TOKENIZERS, "vocabulary": "byte_bpe_50k.tiktoken"} | options
    rows = _joined(docs, **full, langs=langs)
    return mapped(rows.select("shard", "slot", "source", "lang", "ids"), run, "doc_id long, text string, lang string, source string, n_chars long")
