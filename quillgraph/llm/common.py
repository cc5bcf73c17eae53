"""What the training-data operators share: table access, the shared folder, words, tokenizers and connected groups."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Folder of the public vocabulary files; every operator that tokenises takes another as a parameter.
TOKENIZERS = "/opt/tokenizers"

#: A word: a run of letters and digits of any script. The SQL oracles use the same class.
WORD = re.compile(r"[^\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else one of our own (tests, local mode)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quill_dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quill-")
        sc._quill_dir = base
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """df.mapInPandas(run, schema), but integers stay exact beside nulls: a column with a null comes as Int64, not as floats."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def go(batches):
        frames = (_frame(b) for batch in batches for b in _cut(batch))
        try:
            for pdf in run(frames):
                if len(pdf):
                    yield from pa.Table.from_pandas(pdf[arrow.names], schema=arrow, preserve_index=False).to_batches()
        finally:
            _release()

    return df.mapInArrow(go, kind)


_NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}


#: Bytes of a batch that are turned into Python objects at a time.
_AT_ONCE = 8 << 20


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about _AT_ONCE bytes, or of one row."""
    n = batch.num_rows
    step = max(1, n // max(1, batch.nbytes // _AT_ONCE)) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)


def _release() -> None:
    """Gives what a task held back to the system: workers live on from stage to stage, two or more beside one JVM."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        out[name] = col.to_pandas(types_mapper=_NULLABLE.get if col.null_count else None)
    return pd.DataFrame(out)


#: Words of a sieve: 2^18 rows of 64 bits are the most that is ever broadcast.
_SIEVE = 18


def sifted(df: DataFrame, key: str, ids: DataFrame, mark: str) -> DataFrame:
    """df with a column `mark`: false only where df[key] is surely not in ids[key].

    A Bloom filter of at most 2^18 words, whatever the size of `ids`, is broadcast, so a join that few rows of a large table
    take part in moves those few; where `ids` is so large that the filter fills up, it lets more through and nothing is lost.
    """
    h = F.xxhash64(F.col(key), F.lit(99))
    slot, bit = F.shiftrightunsigned(h, 64 - _SIEVE), F.pmod(h, F.lit(64)).cast("int")
    words_ = ids.select(slot.alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    joined = df.withColumn("_slot", slot).join(F.broadcast(words_), "_slot", "left")
    return joined.withColumn(mark, F.coalesce(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))).drop("_slot", "_bits")


def running(df: DataFrame, group: list[str], order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """df with a column `out`: the sum of `value` over the rows of the same group whose `order` (a non-negative integer, distinct within the group) is less.

    Sums of runs of `width` places first, then sums within each run, so that no task holds a whole group.
    """
    run = F.floor(F.col(order) / F.lit(width)).cast("long")
    df = df.withColumn("_run", run)
    sums = df.groupBy(*group, "_run").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("_run").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*group, "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy(*group, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.join(sums, [*group, "_run"]).withColumn(out, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_run", "_before")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept while a Python worker lives; emptied when it grows past `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """uint64 hashes of the words of a text, in order."""
    ws = words(text)
    return np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct uint64 hashes of the k-word shingles of a text. Fewer than k words make one shingle of all; no word makes none."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    acc = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        acc = mix64(acc + h[j : n - k + 1 + j] + np.uint64(j + 1))
    return np.unique(acc)


_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def _ranks(path: str, name: str) -> dict[bytes, int]:
    import base64

    with open(os.path.join(path, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level BPE of a public vocabulary file; ids fit in 16 bits and len(ranks) itself is a free id (end of text)."""
    import tiktoken

    return tiktoken.Encoding("quill-" + name, pat_str=_PIECES + r"|\s+(?!\S)|\s+", mergeable_ranks=_ranks(path, name), special_tokens={})


@lru_cache(maxsize=4)
def _plain(path: str, name: str):
    """The same vocabulary with a pattern that doesn't look ahead, which is matched several times as fast and never recurses."""
    import tiktoken

    return tiktoken.Encoding("quill-plain-" + name, pat_str=_PIECES + r"|\s+", mergeable_ranks=_ranks(path, name), special_tokens={})._core_bpe


#: Unicode's white space, and the place before the last of several that something else follows: the vocabulary's pattern looks ahead there.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOOK = re.compile(f"[{_SPACE}](?=[{_SPACE}][^{_SPACE}])")


def encode_bytes(text: str | None, path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The ids of a text as little-endian 16-bit numbers, those that encoder() gives; decoding gives the text back.

    The text is cut where the vocabulary's pattern would look ahead, so that a pattern without that does.
    """
    if not text:
        return b""
    ids, parts, at = _plain(path, name).encode_ordinary, [], 0
    for m in _LOOK.finditer(text):
        parts.append(array("H", ids(text[at : m.end()])).tobytes())
        at = m.end()
    parts.append(array("H", ids(text[at:] if at else text)).tobytes())
    return b"".join(parts)


def encode(text: str | None, path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """encode_bytes() as an array of uint16."""
    return np.frombuffer(encode_bytes(text, path, name), dtype=np.uint16)


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the undirected graph of `edges`; root is the smallest node of the component.

    Alternates large-star and small-star steps, which need about log n rounds on any shape of component and keep
    each round's rows within the number of edges; every round is cut off by a checkpoint. No edge, no row.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    seen = None
    while True:
        # large star: every neighbour larger than u points to the least neighbour of u (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m2.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.expr("coalesce(sum(pmod(xxhash64(u, v), 1000000007)), 0)").alias("s"), F.expr("coalesce(sum(pmod(u, 1000000007)), 0)").alias("t")).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
