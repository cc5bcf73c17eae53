"""Toxicity behind a noisy channel: letters written as digits or signs, spread out, or repeated.

A character language model is counted over all documents. Every token that the channel may have touched becomes a lattice
of the letters that each of its characters may stand for; Viterbi finds the likeliest reading under the model, and the
restored words are scored by weights learned from labelled documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, mapped, sifted, written

_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáçèéêëíîïñóôúùûœæ"
#: Symbols of the model: 0 is every break, the last is any other letter.
SYMBOL = {c: i + 1 for i, c in enumerate(_LETTERS)}
OTHER = len(_LETTERS) + 1
SIZE = OTHER + 1
_TABLE = np.full(0x10000, OTHER, dtype=np.int64)
for _i in range(0x10000):
    _c = chr(_i)
    if not _c.isalpha():
        _TABLE[_i] = 0
    elif _c.lower() in SYMBOL:
        _TABLE[_i] = SYMBOL[_c.lower()]

#: What a sign may stand for, besides itself, and what that costs in nats.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "§": "s", "µ": "u"}
LEET_COST, DROP_COST, REPEAT_COST, KEEP_SIGN_COST, BREAK_COST = 1.0, 0.7, 0.9, 6.0, 1.5
_SIGNS = re.escape("".join(k for k in LEET if not k.isdigit()))
_SEP = r"[ .\-_*~]"
#: Single characters spread out: four or more, with one or two separators between.
SPREAD = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:{_SEP}{{1,2}}(?:[^\W_]|[{_SIGNS}])){{3,}}(?![^\W_])")
#: A run, within a token, of letters, digits, signs and separators. It is read if it has a letter and a hint: a sign or digit that may be a letter, a separator between, or a letter twice in a row.
RUN = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:[^\W_]|[{_SIGNS}.\-_*~])*")
_LETTER = re.compile(r"[^\W\d_]")
_HINT = re.compile(rf"[\d{_SIGNS}]|[^\W\d_][.\-_*~]+[^\W_]|(?i:([^\W\d_])\1)")
#: Log-odds that the words of a text must reach together: 19 to 1 or so.
BAR = 3.0
#: Characters that are counted at once.
PIECE = 1 << 18


def _counted(x: np.ndarray) -> np.ndarray:
    """How often each three symbols stand in a row in x, breaks in a row aside."""
    n = np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
    n.reshape(SIZE, SIZE, SIZE)[:, 0, 0] = 0
    return n


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each three symbols stand in a row in texts, each of which begins with two breaks and ends with one; further breaks in a row are not counted."""
    raw = np.frombuffer("".join(x for t in texts for x in ("\ue000", t)).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    x = _TABLE[raw]
    x[raw == 0xE000] = -1
    x = x[(x != 0) | (np.append(-1, x[:-1]) > 0)]
    x = np.append(np.repeat(x, np.where(x < 0, 2, 1)), 0)
    x[x < 0] = 0
    return _counted(x)


def long_counts(text: str, piece: int = PIECE) -> np.ndarray:
    """gram_counts([text]), piece by piece: the last two symbols go over to the next."""
    total = np.zeros(SIZE**3, dtype=np.int64)
    held = np.zeros(2, dtype=np.int64)
    for i in range(0, len(text), piece):
        y = _TABLE[np.frombuffer(text[i : i + piece].encode("utf-16-le", "surrogatepass"), dtype=np.uint16)]
        y = y[(y != 0) | (np.append(held[-1], y[:-1]) > 0)]
        x = np.append(held, y)
        total += _counted(x)
        held = x[-2:]
    return total + _counted(np.append(held, 0))


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each three symbols stand in a row, over whole texts of all rows; gram is a number in base SIZE."""

    def run(it):
        total = np.zeros(SIZE**3, dtype=np.int64)
        held: list[str] = []
        size = 0
        for pdf in it:
            for t in pdf["text"]:
                if not t:
                    continue
                if len(t) > PIECE:
                    total += long_counts(t)
                    continue
                held.append(t)
                size += len(t)
                if size >= PIECE:
                    total += gram_counts(held)
                    held, size = [], 0
        if held:
            total += gram_counts(held)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    return mapped(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(counts: list[tuple[int, int]], words: list[str] | tuple = (), share: float = 0.002) -> np.ndarray:
    """-log P(third | first two), smoothed with the bigrams and single symbols; even odds where nothing was counted.

    words are known beforehand: each counts as if it made up `share` of the corpus (all of them a fifth at most), for a writer who hides a word hides one of these.
    """
    tri = np.zeros(SIZE**3)
    for g, n in counts:
        tri[g] = n
    share = min(share, 0.2 / max(1, len(words)))
    extra = max(1.0, share * tri[np.arange(SIZE**3) % SIZE == 0].sum())  # a gram that ends in a break ends a word
    for w in words:
        x = [0, 0, *(SYMBOL.get(c, OTHER) for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            tri[(a * SIZE + b) * SIZE + c] += extra
    tri = tri.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


def decode(token: str, cost: np.ndarray) -> str:
    """The likeliest reading of a token (lower case letters, with a space where it was cut into words), in time linear in its length."""
    # state: last two symbols, and the last letter; value: cost, and the text as (text before, last part), so that it is never copied
    beams: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    before = ""
    low = token.lower()
    for c in low:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        elif c in LEET:
            options += [(x, LEET_COST) for x in LEET[c]]
            options.append((" ", KEEP_SIGN_COST) if not c.isdigit() else (" ", KEEP_SIGN_COST - 2))
        else:
            options += [("", DROP_COST if c != " " else 0.1), (" ", BREAK_COST)]
        new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (w, text) in beams.items():
            tries = options
            if c == before and text:
                tries = [*options, ("", REPEAT_COST)]
            for x, extra in tries:
                if x == "":
                    key, v = (a, b, last), (w + extra, text)
                elif x == " ":
                    if b == 0:
                        key, v = (a, b, last), (w + extra, text)
                    else:
                        key, v = (b, 0, last), (w + extra + cost[a, b, 0], (text, " "))
                else:
                    s = SYMBOL.get(x, OTHER)
                    key, v = (b, s, x), (w + extra + cost[a, b, s], (text, x))
                if key not in new or v[0] < new[key][0]:
                    new[key] = v
        beams = new
        before = c
    text = min(((w + cost[a, b, 0], text) for (a, b, _), (w, text) in beams.items()), key=lambda v: v[0])[1]
    parts = []
    while text is not None:
        text, x = text
        parts.append(x)
    return "".join(reversed(parts)).strip()


#: The letters, besides itself, that a character may be read as.
_READ = {sign: frozenset(x) for sign, x in LEET.items()}


class Restorer(dict):
    """token -> (words of the lexicon in it as it stands, those in its readings) or None, kept while a worker lives; emptied when it grows past `most` tokens.

    The lattice of a run is decoded only if some path through it could spell a word of the lexicon. All words are followed
    at once, a bit for each of their letters: a character moves on to the letters that it may be read as, may repeat the
    one before, and may be passed over if it is no letter.
    """

    def __init__(self, cost: np.ndarray, lexicon: dict[str, float] | None = None, most: int = 250_000):
        super().__init__()
        self.cost, self.lexicon, self.most = cost, lexicon or {}, most
        self.firsts = self.ends = at = 0
        self.bits: dict[str, int] = {}
        for w in self.lexicon:
            self.firsts |= 1 << at
            for c in w:
                self.bits[c] = self.bits.get(c, 0) | 1 << at
                at += 1
            self.ends |= 1 << (at - 1)
        self.reads = {c: self.bits.get(c, 0) for c in self.bits} | {c: sum(self.bits.get(x, 0) for x in xs) for c, xs in _READ.items()}

    def possible(self, token: str) -> bool:
        """Whether a reading of the token could have a word of the lexicon in it; never False where one has."""
        on, reads, firsts, ends = 0, self.reads, self.firsts, self.ends
        for c in token.lower():
            can = reads.get(c, 0)
            if c.isalpha():
                # a word's first letter follows no other word's last, so a step from there is undone
                on = ((on & ~ends) << 1 | firsts | on) & can
            else:
                on |= ((on & ~ends) << 1 | firsts) & can
            if on & ends:
                return True
        return False

    def reading(self, token: str) -> list[str]:
        """Words of a run's likeliest reading, and all of it as one word."""
        if len(token) < 3 or _HINT.search(token) is None or _LETTER.search(token) is None or not self.possible(token):
            return []
        got = decode(token, self.cost)
        return [*got.split(), got.replace(" ", "")]

    def spread(self, text: str) -> list[str]:
        """Words of the readings of what is spread out in a text."""
        out = []
        for m in SPREAD.finditer(text):
            if self.possible(m.group()):
                got = decode(m.group(), self.cost)
                whole = got.replace(" ", "")
                out += [*got.split(), *(w for w in self.lexicon if len(w) >= 4 and w in whole)]
        return out

    def readings(self, text: str) -> list[str]:
        """Words of all readings that could have one of the lexicon in them."""
        return self.spread(text) + [w for t in text.split() for m in RUN.finditer(t) for w in self.reading(m.group())]

    def __missing__(self, token: str) -> tuple[set[str], set[str]] | None:
        if len(self) >= self.most:
            self.clear()
        plain = self.lexicon.keys() & WORD.findall(token.lower())
        hidden = self.lexicon.keys() & {w for m in RUN.finditer(token) for w in self.reading(m.group())} if _HINT.search(token) else set()
        v = self[token] = (plain, hidden) if plain or hidden else None
        return v

    def found(self, text: str) -> tuple[set[str], set[str]]:
        """Words of the lexicon that stand in a text, and those that only stand behind the channel."""
        plain: set[str] = set()
        hidden = self.lexicon.keys() & self.spread(text)
        for v in filter(None, map(self.__getitem__, set(text.split()))):
            plain |= v[0]
            hidden |= v[1]
        return plain, hidden - plain


def lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 10000, least: int = 5, words: int = 5000) -> list[tuple[str, float]]:
    """Words that tell toxic documents apart, with the log-odds that a context of theirs is toxic: at most `words` of those that stand in `least` contexts of
    toxic labelled documents or more, are at least nine times as frequent there, and are so beyond chance.

    A word counts once for each pair of its neighbours, so that copies of one document, however many, count as one.
    fit_rows bounds the labelled ids that are learned from, chosen by a hash; of an id with several rows, all count.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    h = F.xxhash64("doc_id", F.lit("tox"))
    picked = known.withColumn("h", h)
    if n > fit_rows:  # a few more than needed, then exactly those of the least hash
        picked = picked.where(F.col("h") < min((1 << 63) - 1, int(1.1 * fit_rows / n * (1 << 64)) - (1 << 63) + (1 << 64) // n))
    picked = written(picked.orderBy("h", "doc_id").limit(fit_rows).select("doc_id", "toxic"), "picked")
    d = sifted(docs.select("doc_id", "text"), "doc_id", picked, "may").where("may").select("doc_id", "text").join(picked, "doc_id")

    def run(it):
        for pdf in it:
            rows: set[tuple[str, int, int]] = set()
            for t, x in zip(pdf["text"], pdf["toxic"]):
                ws = WORD.findall(t.lower()) if t else []
                for a, w, z in zip(["", *ws], ws, [*ws[1:], ""]):
                    if len(w) > 2 and not w.isdigit():
                        rows.add((w, xxhash.xxh3_64_intdigest(f"{a} {z}") - 2**63, int(x > 0)))
            yield pd.DataFrame(list(rows), columns=["w", "context", "toxic"])

    contexts = mapped(d.select("text", "toxic"), run, "w string, context long, toxic int").groupBy("w", "context").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("low"))
    counted = written(contexts.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("low")).alias("clean")), "words")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")).first()
    if not total["bad"] or not total["clean"]:
        return []
    ratio = (F.col("bad") + 0.5) / (total["bad"] + 1.0) / ((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    p = total["bad"] / (total["bad"] + total["clean"])
    n_ = F.col("bad") + F.col("clean")
    # the likelihood ratio against chance, which among a million words stays below 30
    chance = 2 * (F.col("bad") * F.log(F.col("bad") / (n_ * p)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n_ * (1 - p)))).otherwise(0.0))
    got = counted.where(F.col("bad") >= least).withColumn("odds", F.log(ratio)).where((F.col("odds") >= math.log(9)) & (chance >= 30)).orderBy(F.desc("odds"), "w").limit(words).collect()
    return [(r["w"], math.log((r["bad"] + 0.5) / (r["clean"] + 0.5))) for r in got if r["bad"] > r["clean"]]


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 10000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, toxic, terms, restored) for every row of docs(doc_id, text); other columns are ignored.

    terms are the words of the lexicon that stand in the text, openly or behind the channel (restored: how many of them only
    behind it), score is the logistic function of the sum of their log-odds less BAR, toxic is 1 from threshold on: one sure word or several weaker ones. A null or empty text
    has score 0, a very long one is read whole, in time linear in its length. Null ids and repeated rows are scored like any
    other row; an empty table gives no rows, and without labels of both classes nothing is toxic.
    """
    weights = dict(lexicon(docs, labels, fit_rows))
    cost = char_model([(r["gram"], r["n"]) for r in char_counts(docs).collect()], sorted(weights))  # at most SIZE^3 rows, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((cost.astype(np.float32), weights))

    def run(it):
        c, lex = shared.value
        reader = Restorer(c.astype(float), lex)
        for pdf in it:
            out: dict[str, list] = {"score": [], "terms": [], "restored": []}
            for t in pdf["text"]:
                found, hidden = reader.found(t) if t and lex else (set(), set())
                out["terms"].append(sorted(found | hidden))
                out["restored"].append(len(hidden))
                out["score"].append(1 / (1 + math.exp(BAR - sum(lex[w] for w in found | hidden))) if found or hidden else 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"]} | out | {"toxic": [int(s >= threshold) for s in out["score"]]})[["doc_id", "score", "toxic", "terms", "restored"]]

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, toxic int, terms array<string>, restored int")
