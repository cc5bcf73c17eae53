"""Quality classifier without labels: overlapping heuristics vote, expectation-maximisation weighs them, and the
posterior labels train a hashed linear scorer.

Three passes over whole texts. The first turns every document into a vector of votes and counts the vectors over all
documents (at most 3^9 rows reach the driver, whatever the corpus). The second fits the scorer on a bounded sample,
chosen by a hash of the row. The third scores every document, row by row, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import mapped

#: Names of the labellers, in the order of their votes.
LABELLERS = ("symbols", "capitals", "marks", "bars", "repeats", "function_words", "word_length", "vowels", "stutter")
#: Least log-odds that a vote of "bad" is worth; a vote of "good" never counts against. Without such a floor, EM can turn a labeller of a rare kind of junk upside down.
WORTH = 1.1
#: Frequent short words of the four languages; a text of sentences has some of them.
FUNCTION_WORDS = frozenset("the of and to in is it that was for as with be by on are this a an or from at la el los las de del que y en un una se por con su para al es le les des et du qui dans est pour sur au une pas ne par il elle der die das und den von zu mit sich ist im dem nicht ein eine als auch auf".split())
_SPLIT = re.compile(r"[^\W_]+")
_SHAPE = re.compile(r"([^\W\d_]+)|(\d+)|(.)", re.S)
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûëïœæ")


def votes(text: str | None) -> list[int]:
    """One vote for each labeller: 1 good, -1 bad, 0 none. Labellers that know one kind of junk never vote good. No vote at all for a null or blank text."""
    out = [0] * len(LABELLERS)
    if text is None or not (tokens := text.split()):
        return out
    n = len(tokens)
    chars = Counter(text)
    letters = upper = marks = other = bars = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            if c.isupper():
                upper += k
        elif c in "|\\<>{}[]~^":
            bars += k
            other += k
        elif c in "!?":
            marks += k
        elif not (c.isspace() or c.isdigit() or c in ".,;:'\"-()’“”«»¿¡"):
            other += k
    total = len(text)
    r = other / total
    out[0] = -1 if r > 0.06 else 0
    if letters >= 5:
        r = upper / letters
        out[1] = -1 if r > 0.5 else 0
    r = marks / n
    out[2] = -1 if r > 0.5 else 0
    r = bars / n
    out[3] = -1 if r > 0.25 else 0
    if n >= 40:
        grams = Counter(zip(tokens, tokens[1:], tokens[2:], tokens[3:]))
        r = 1 - len(grams) / (n - 3)
        out[4] = -1 if r > 0.3 else 1 if r < 0.05 else 0
    if n >= 4:
        r = sum(map(str.__eq__, tokens, tokens[1:])) / (n - 1)
        out[8] = -1 if r > 0.25 else 1 if r < 0.08 else 0
    if n >= 8:
        low = text.lower().split()
        r = sum(map(FUNCTION_WORDS.__contains__, low)) / n
        out[5] = -1 if r < 0.02 and n >= 30 else 1 if r > 0.08 else 0
        r = total / n
        out[6] = -1 if r > 16 or r < 2.5 else 1 if 4 <= r <= 12 else 0
        v = sum(k for c, k in chars.items() if c.lower() in _VOWELS)
        r = v / max(1, letters)
        out[7] = -1 if r < 0.15 or r > 0.85 else 1
    return out


class _Shapes(dict):
    """token -> hashed buckets of the token and of its shape, kept while the worker lives."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 250_000:
            self.clear()
        shape = _SHAPE.sub(lambda m: ("U" if m[1].isupper() and len(m[1]) > 1 else "L" if m[1][0].isupper() else "l") if m[1] else "0" if m[2] else m[3], token)
        shape = re.sub(r"(.)\1+", r"\1", shape)
        v = self[token] = (xxhash.xxh32_intdigest(token.lower()) & self.mask, xxhash.xxh32_intdigest("\0" + shape) & self.mask)
        return v


_CACHE: dict[int, _Shapes] = {}


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets and values (square roots of relative frequencies, so their squares add to about 1); none for a null or blank text."""
    tokens = text.split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.int64), np.empty(0)
    cache = _CACHE.setdefault(bits, _Shapes(bits))
    x = np.array([cache[t] for t in tokens], dtype=np.int64).ravel()
    x = np.concatenate([x, np.full(2 * sum(map(str.__eq__, tokens, tokens[1:])), xxhash.xxh32_intdigest("\0again") & ((1 << bits) - 1))])
    at, n = np.unique(x, return_counts=True)
    return at, np.sqrt(n / len(x))


@dataclass
class LabelModel:
    """Class balance and, for each labeller, P(vote | class) for the votes -1, 0, 1: table[labeller, class, vote + 1]."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes. The absence of a vote tells nothing."""
        v = np.atleast_2d(v)
        s = np.full(len(v), np.log(self.prior) - np.log1p(-self.prior))
        for j in range(v.shape[1]):
            ratio = np.log(self.table[j, 1]) - np.log(self.table[j, 0])
            ratio = np.array([min(ratio[0], -WORTH), 0.0, max(ratio[2], 0.0)])
            s += np.where(v[:, j] == 0, 0.0, ratio[v[:, j] + 1])
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM over distinct vote vectors and their counts, begun at the majority vote. With no rows, an even prior."""
    m = patterns.shape[1] if patterns.size else len(LABELLERS)
    model = LabelModel(0.5, np.full((m, 2, 3), 1 / 3))
    if not patterns.size or not (patterns != 0).any():
        return model
    voted = (patterns != 0).any(1)
    v, n = patterns[voted], counts[voted].astype(float)
    q = np.clip(0.5 + 0.5 * v.sum(1) / np.maximum(1, (v != 0).sum(1)), 0.02, 0.98)
    for _ in range(rounds):
        prior = float(np.clip((n * q).sum() / n.sum(), 0.01, 0.99))
        t = np.empty((m, 2, 3))
        for c, w in ((0, n * (1 - q)), (1, n * q)):
            for j in range(m):
                t[j, c] = [w[v[:, j] == x].sum() for x in (-1, 0, 1)]
                t[j, c] += 1
                t[j, c] /= t[j, c].sum()
        model = LabelModel(prior, t)
        new = model.posterior(v)
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return model


def accuracies(model: LabelModel) -> dict[str, float]:
    """Estimated accuracy of each labeller where it votes."""
    t, p = model.table, model.prior
    right = p * t[:, 1, 2] + (1 - p) * t[:, 0, 0]
    wrong = p * t[:, 1, 0] + (1 - p) * t[:, 0, 2]
    return {k: float(a / (a + b)) for k, a, b in zip(LABELLERS, right, wrong)}


def vote_counts(docs: DataFrame) -> DataFrame:
    """(votes, n): how many documents cast each vector of votes."""

    def run(it):
        for pdf in it:
            c = Counter("".join("-0+"[x + 1] for x in votes(t)) for t in pdf["text"])
            yield pd.DataFrame({"votes": list(c), "n": list(c.values())})

    return mapped(docs.select("text"), run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def _as_votes(keys: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in k] for k in keys], dtype=np.int64).reshape(-1, len(LABELLERS))


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float
    bits: int


def _solve(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, l2: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam on the full sample, both classes weighing the same."""
    w, b = np.zeros(1 << bits), 0.0
    if not len(rows):
        return w, b
    at = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).mean()), 0.5 / max(1e-9, (y < 0.5).mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[at], len(rows)) + b, -30, 30)))
        g = (p - y) * balance / len(rows)
        gw = np.bincount(at, val * g[row], len(w)) + l2 * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = 0.2 * (0.02 ** (k / steps))
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def fit(docs: DataFrame, fit_rows: int = 6000, bits: int = 14) -> Scorer:
    """Fits both models. fit_rows bounds the sample the linear scorer learns from (all documents vote in the label model)."""
    counted = vote_counts(docs).collect()
    n = sum(r["n"] for r in counted)
    labels = fit_labels(_as_votes([r["votes"] for r in counted]), np.array([r["n"] for r in counted]))
    picked = docs.select("text", F.xxhash64("doc_id", "text", F.lit("fit")).alias("h"))
    if n > fit_rows:  # a few more than needed by their hash, then exactly the least ones
        picked = picked.where(F.col("h") < min((1 << 63) - 1, int(1.1 * fit_rows / n * (1 << 64)) - (1 << 63) + (1 << 64) // n))
    picked = picked.dropDuplicates(["h"])  # rows that are the same throughout count once

    def run(it):
        for pdf in it:
            f = [features(t, bits) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "votes": ["".join("-0+"[x + 1] for x in votes(t)) for t in pdf["text"]], "at": [a.astype(np.int32).tobytes() for a, _ in f], "val": [v.astype(np.float32).tobytes() for _, v in f]})

    got = [r for r in mapped(picked, run, "h long, votes string, at binary, val binary").orderBy("h").limit(fit_rows).collect() if r["at"] and set(r["votes"]) != {"0"}]
    y = labels.posterior(_as_votes([r["votes"] for r in got])) if got else np.empty(0)
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(float)) for r in got]
    w, b = _solve(rows, y, bits)
    return Scorer(labels, w, b, bits)


def _scored(docs: DataFrame, model: Scorer, schema: T.StructType, add) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.labels, model.bits))  # 64 KB, of fixed size

    def run(it):
        w, b, labels, bits = shared.value
        for pdf in it:
            score = np.zeros(len(pdf))
            for i, t in enumerate(pdf["text"]):
                at, val = features(t, bits)
                if len(at):
                    score[i] = 1 / (1 + np.exp(-np.clip(val @ w[at] + b, -30, 30)))
            yield add(pdf, score, labels)

    return mapped(docs, run, schema)


def score_quality(docs: DataFrame, fit_rows: int = 6000, bits: int = 14, threshold: float = 0.4) -> DataFrame:
    """(doc_id, label_score, score, keep) for every row of docs(doc_id, text); other columns are ignored.

    label_score is the posterior of the heuristics' votes, score that of the linear scorer, keep is 1 where
    score >= threshold. A null or blank text has no features: score 0, keep 0. Null ids and repeated rows are scored
    like any other row (equal rows count once in the sample that the scorer learns from), very long texts whole; an empty
    table gives no rows.
    """
    d = docs.select("doc_id", "text")
    model = fit(d, fit_rows, bits)

    def add(pdf, score, labels):
        p = labels.posterior(np.array([votes(t) for t in pdf["text"]], dtype=np.int64).reshape(-1, len(LABELLERS)))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "label_score": p, "score": score, "keep": (score >= threshold).astype(np.int32)})

    schema = T.StructType([d.schema["doc_id"], T.StructField("label_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.IntegerType())])
    return _scored(d, model, schema, add)


def filter_quality(docs: DataFrame, fit_rows: int = 6000, bits: int = 14, threshold: float = 0.4) -> DataFrame:
    """The rows of docs, all columns as they were, whose score reaches the threshold. Null and blank texts go."""
    model = fit(docs.select("doc_id", "text"), fit_rows, bits)
    return _scored(docs, model, docs.schema, lambda pdf, score, labels: pdf[score >= threshold])
