"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents of one input partition, taken as a sequence of words. Its suffixes are sorted by prefix
doubling; the Burrows-Wheeler transform goes into a wavelet matrix whose ranks drive the backward search of all test
phrases at once; occurrences are located through sampled suffix positions. Nothing is shuffled: the phrases, which do not
grow with the corpus, are broadcast in parts of bounded size, and every document is judged in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, mapped, word_hashes, words

BITS = 16
#: Words of a shard; bounds the memory of a task, whatever the partition holds.
SHARD = 1 << 18
#: A suffix position in so many is kept.
SAMPLE = 16


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of x (16-bit symbols) in order; a shorter suffix sorts before a longer one that it begins."""
    n = len(x)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    pad = np.concatenate([x.astype(np.uint64) + np.uint64(0), np.zeros(4, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(4):
        key = (key << np.uint64(16)) | pad[j : n + j]
    # symbols are at least 1, so the zero padding sorts first
    sa = np.argsort(key, kind="stable")
    sk = key[sa]
    start = np.r_[True, sk[1:] != sk[:-1]]
    rank = np.empty(n, dtype=np.int64)
    head = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[sa] = head
    size = 4
    while True:
        tied = ~(start & np.r_[start[1:], True])
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        suf = sa[at]
        nxt = suf + size
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, head[at]))
        suf, second, group = suf[order], second[order], head[at][order]
        sa[at] = suf
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        start[at] = new
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[suf] = head[at]
        size *= 2


class FMIndex:
    """Counts and locates patterns in a sequence of 16-bit symbols, all of them 1 or more."""

    def __init__(self, x: np.ndarray):
        sa = suffix_array(x)
        n = self.n = len(x)
        # row 0 is the empty suffix; its predecessor is the last symbol
        bwt = np.empty(n + 1, dtype=np.uint16)
        bwt[0] = x[-1] if n else 0
        bwt[1:] = np.where(sa > 0, x[sa - 1] if n else 0, 0)
        full = np.r_[n, sa]
        self.marked = full % SAMPLE == 0
        self.marks = np.r_[0, np.cumsum(self.marked)]
        self.samples = full[self.marked]
        counts = np.bincount(bwt, minlength=(1 << BITS) + 1)
        self.before = np.r_[0, np.cumsum(counts)]
        self.bwt = bwt
        self.ranks, self.zeros = [], []
        y = bwt
        for level in range(BITS - 1, -1, -1):
            bit = (y >> level) & 1
            ones = np.zeros(n + 2, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n + 1 - int(ones[-1]))
            b = bit.astype(bool)
            y = np.concatenate([y[~b], y[b]])

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbols c before the rows `at` of the transform."""
        p, z = at, np.zeros_like(at)
        for level, ones, zeros in zip(range(BITS - 1, -1, -1), self.ranks, self.zeros):
            bit = ((c >> level) & 1).astype(bool)
            p = np.where(bit, zeros + ones[p], p - ones[p])
            z = np.where(bit, zeros + ones[z], z - ones[z])
        return p - z

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the patterns, which are the rows of a matrix, flush with its right edge."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n + 1, dtype=np.int64)
        for j in range(width):
            on = np.flatnonzero((lengths > j) & (hi > lo))
            if not len(on):
                break
            c = patterns[on, width - 1 - j].astype(np.int64)
            base = self.before[c]
            lo[on], hi[on] = base + self.rank(c, lo[on]), base + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix, and adds the steps."""
        out, rows, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        on = np.arange(len(rows))
        while len(on):
            r = rows[on]
            hit = self.marked[r]
            out[on[hit]] = self.samples[self.marks[r[hit]]] + steps[on[hit]]
            on = on[~hit]
            if len(on):
                c = self.bwt[rows[on]].astype(np.int64)
                rows[on] = self.before[c] + self.rank(c, rows[on])
                steps[on] += 1
        return out


def _symbols(h: np.ndarray) -> np.ndarray:
    """16-bit symbols 2.. of word hashes; 1 separates documents and 0 ends the text."""
    return (h % np.uint64((1 << BITS) - 2) + np.uint64(2)).astype(np.uint16)


def phrases(texts: list[str | None], n: int = 13, least: int = 5) -> list[np.ndarray]:
    """Distinct word-hash sequences to look for: every n words of a text in a row, or a whole text of `least` to n - 1 words."""
    found: dict[bytes, np.ndarray] = {}
    for t in texts:
        h = word_hashes(t)
        if least <= len(h) < n:
            found.setdefault(h.tobytes(), h)
        for i in range(len(h) - n + 1):
            found.setdefault(h[i : i + n].tobytes(), h[i : i + n])
    return list(found.values())


def _matrix(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max((len(p) for p in found), default=1)
    full = np.zeros((len(found), width), dtype=np.uint64)
    for i, p in enumerate(found):
        full[i, width - len(p) :] = p
    return full, np.array([_symbols(p) if len(p) == width else np.r_[np.zeros(width - len(p), np.uint16), _symbols(p)] for p in found], dtype=np.uint16).reshape(len(found), width), np.array([len(p) for p in found], dtype=np.int64)


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shard_spans(texts: list[str | None], *parts) -> dict[int, list[tuple[int, int]]]:
    """Index of a text -> character spans to remove, over one shard. parts: results of _matrix(), or functions that load one."""
    hashes = [word_hashes(t) for t in texts]
    if not sum(map(len, hashes)):
        return {}
    one = np.ones(1, dtype=np.uint16)
    index = FMIndex(np.concatenate([y for h in hashes for y in (_symbols(h), one)]))
    begins = np.cumsum([0] + [len(h) + 1 for h in hashes])
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for part in parts:
        full, symbols, lengths = part() if callable(part) else part
        lo, hi = index.search(symbols, lengths)
        hit = np.flatnonzero(hi > lo)
        times = hi[hit] - lo[hit]
        which = np.repeat(hit, times)
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[hit], times)
        at = index.locate(rows)
        doc = np.searchsorted(begins, at, side="right") - 1
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0, True]) if len(doc) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = order[a:b]
            d = int(doc[some[0]])
            h, first = hashes[d], at[some] - begins[d]
            # symbols are hashes of hashes: the words themselves must agree too
            keep = [i for i, (p, w) in enumerate(zip(first, which[some])) if (h[p : p + lengths[w]] == full[w, full.shape[1] - lengths[w] :]).all()]
            if keep:
                found.setdefault(d, []).append((first[keep], first[keep] + lengths[which[some]][keep]))
    out: dict[int, list[tuple[int, int]]] = {}
    for d, runs in sorted(found.items()):
        low = texts[d].lower()
        chars = [m.span() for m in WORD.finditer(low)]
        spans = merged(np.concatenate([x for x, _ in runs]), np.concatenate([y for _, y in runs]))
        out[d] = [(chars[i][0], chars[j - 1][1]) for i, j in spans]
        if len(low) != len(texts[d]):
            out[d] = _remapped(texts[d], out[d])
    return out


def _remapped(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of text.lower() as spans of text, where lower() has changed the length."""
    at, lengths = 0, []
    for c in text:
        lengths.append(at)
        at += len(c.lower())
    starts = np.array(lengths)
    return [(int(np.searchsorted(starts, a, side="right") - 1), int(np.searchsorted(starts, b - 1, side="right"))) for a, b in spans]


def _shards(it: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of a partition in runs of about `size` words (a word is taken to be six characters); a longer text is a run of its own."""
    held, weight = [], 0
    for pdf in it:
        if not len(pdf):
            continue
        w = pdf["text"].str.len().fillna(0).to_numpy(dtype=float) / 6
        start = 0
        for i in range(len(pdf)):
            if weight and weight + w[i] > size:
                if i > start:
                    held.append(pdf.iloc[start:i])
                yield pd.concat(held, ignore_index=True)
                held, weight, start = [], 0, i
            weight += w[i]
        held.append(pdf.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


#: Phrases of a benchmark that are broadcast, and sought, at once; a larger benchmark is sought in several parts.
PHRASES = 250_000


def _shared(docs: DataFrame, benchmark: DataFrame, n: int, least: int) -> list:
    """The phrases of the benchmark as broadcasts of PHRASES each, so that neither the driver nor a task ever holds more of them at once."""
    sc, out = docs.sparkSession.sparkContext, []
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    for (t,) in benchmark.select("text").where("text is not null").distinct().toLocalIterator():
        for p in phrases([t], n, least):
            if p.tobytes() not in seen:
                seen.add(p.tobytes())
                held.append(p)
        if len(held) >= PHRASES:
            out.append(sc.broadcast(_matrix(held)))
            held, seen = [], set()
    if held:
        out.append(sc.broadcast(_matrix(held)))
    return out


def _spans(texts: list[str | None], shared: list) -> dict[int, list[tuple[int, int]]]:
    """shard_spans() over all parts of the benchmark."""
    if not shared:
        return {}
    if len(shared) == 1:
        return shard_spans(texts, shared[0].value)
    # load_from_path() keeps nothing, so one part is in memory at a time
    return shard_spans(texts, *(lambda b=b: b.load_from_path(b._path) if getattr(b, "_path", None) else b.value for b in shared))


def leaked_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, least: int = 5, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, end): the character spans of docs(doc_id, text) that repeat benchmark(text), merged.

    A span is made of runs of n words that stand in a benchmark text in the same order (case and what is not a letter or
    digit aside); a benchmark text of `least` to n - 1 words counts as a whole, a shorter one is not sought. Null and
    empty texts have no spans; rows with a null id or repeated rows are judged like any other; a very long text is a shard of its
    own. Other columns, of either table, are ignored. An empty table on either side gives no rows.
    """
    shared = _shared(docs, benchmark, n, least)

    def run(it):
        for pdf in _shards(it, shard):
            spans = _spans(pdf["text"].tolist(), shared)
            rows = [(i, a, b) for i, s in spans.items() for a, b in s]
            if rows:
                i, a, b = zip(*rows)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[list(i)].array, "start": np.array(a, np.int64), "end": np.array(b, np.int64)})

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, start long, end long")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, least: int = 5, shard: int = SHARD) -> DataFrame:
    """docs with the spans of leaked_spans() cut out of text (n_chars follows where it exists); a document of which no word remains goes, any other row stays, null texts included."""
    shared = _shared(docs, benchmark, n, least)

    def run(it):
        for pdf in _shards(it, shard):
            spans = _spans(pdf["text"].tolist(), shared)
            if spans:
                pdf = pdf.copy()
                t = pdf["text"].tolist()
                for i, s in spans.items():
                    t[i] = cut(t[i], s)
                pdf["text"] = t
                if "n_chars" in pdf:
                    lengths = pdf["n_chars"].tolist()
                    for i in spans:
                        lengths[i] = len(t[i])
                    pdf["n_chars"] = lengths
                pdf = pdf[[i not in spans or bool(words(t[i])) for i in range(len(pdf))]]
            yield pdf

    return mapped(docs, run, docs.schema)
