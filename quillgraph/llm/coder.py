"""Token ids as binary blocks: adaptive context mixing drives a range coder.

Every block starts from an empty model. Before each id, order 2 and order 1 each name the id that followed the same two
(one) ids last time, and order 0 spreads its mass over all 65,536 ids by how often they came so far. The three are mixed
with weights that adapt within the block, for every state of confidence of order 2 and order 1. The encoder knows a whole
block, so it finds all predictions and weights of the block at once, by sorts and running sums; blocks are independent, so
the range coder then takes one step of many blocks at a time. The decoder goes id by id, with many blocks in lockstep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.llm.common import TOKENIZERS, encode_bytes, encoder, mapped

#: Ids of a block, and blocks coded in lockstep; together they bound a task's memory.
BLOCK = 8192
LANES = 256
ALPHABET = 1 << 16
_SLOT, _ID = 15, 20
#: The order-0 intervals are renewed after so many ids.
RENEW = (128, 512, 2048, 4096)
_TOP, _SHIFT = 62, 32
_LOW = (1 << (_TOP - _SHIFT)) - 1
#: Weights of order 2, order 1 and order 0 before anything was seen, and what each time adds.
_FIRST, _MORE = (4, 4, 8), 16


def _context2(p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return ((p2.astype(np.int64) * 40503 + p1.astype(np.int64) * 60493) >> 5) & (ALPHABET - 1)


def _renewals(n: int) -> list[int]:
    return [t for t in (*RENEW, *range(2 * RENEW[-1], n, 2 * RENEW[-1])) if t < n]


def _below(seen: np.ndarray) -> np.ndarray:
    """Lower ends of the order-0 intervals of all ids and of the end, after `seen` ids."""
    extra = ((1 << _ID) - ALPHABET) // len(seen)
    out = np.zeros(ALPHABET + 1, dtype=np.int64)
    np.cumsum(np.bincount(seen, minlength=ALPHABET) * extra + 1, out=out[1:])
    out[-1] = 1 << _ID
    return out


def _split(w2: np.ndarray, w1: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares, of 2^_SLOT, of order 2 and order 1; the rest, never empty, is order 0's."""
    f2 = np.minimum((w2 << _SLOT) // (total + 1) + 1, (1 << _SLOT) - 2)
    f1 = (w1 << _SLOT) // (total + 1) + 1
    return f2, np.where(f2 + f1 >= (1 << _SLOT), 1, f1)


def _history(x: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: what followed its context last time (0 if nothing did), whether that is right, and whether it was right the last two times (2 + 1)."""
    n = len(x)
    order = np.argsort(context.astype(np.uint16), kind="stable")
    k = context[order]
    again = np.flatnonzero(k[1:] == k[:-1])
    before = np.full(n + 1, n)  # place n stands for no place
    before[order[again + 1]] = order[again]
    before = before[:n]
    padded = np.append(x, np.uint16(0))
    guess = padded[before]
    hit = np.append(guess == x, False)
    twice = np.append(before, n)[before]
    return guess, hit[:n], 2 * hit[before] + hit[twice]


def _earlier(flag: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags were set before each place among the places of its state; order sorts by state, first is where each state begins."""
    run = np.cumsum(flag[order])
    run = np.append(0, run[:-1])
    out = np.empty(len(flag), dtype=np.int64)
    out[order] = run - run[first]
    return out


def _plan(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coder's steps for a block: start and size of an interval of 2^bits, one step for each id and one more where order 0 has to tell it."""
    n = len(x)
    p1 = np.append(np.uint16(0), x[:-1])
    p2 = np.append(np.uint16(0), p1[:-1])
    g1, hit1, c1 = _history(x, p1)
    g2, hit2, c2 = _history(x, _context2(p2, p1))
    state = (c2 * 8 + c1 * 2 + (g1 == g2)).astype(np.uint8)
    slot = np.where(hit2, 0, np.where(hit1, 1, 2))
    order = np.argsort(state, kind="stable")
    begins = np.searchsorted(state[order], np.arange(32))
    first = begins[state[order]]
    n2, n1 = _earlier(slot == 0, order, first), _earlier(slot == 1, order, first)
    seen = np.empty(n, dtype=np.int64)
    seen[order] = np.arange(n) - first
    f2, f1 = _split(_FIRST[0] + _MORE * n2, _FIRST[1] + _MORE * n1, sum(_FIRST) + _MORE * seen)
    miss = np.flatnonzero(slot == 2)
    at = np.arange(n) + np.cumsum(slot == 2) - (slot == 2)
    m = n + len(miss)
    start, size, bits = np.empty(m, dtype=np.int32), np.empty(m, dtype=np.int32), np.full(m, _SLOT, dtype=np.int8)
    start[at] = np.where(slot == 0, 0, np.where(slot == 1, f2, f2 + f1))
    size[at] = np.where(slot == 0, f2, np.where(slot == 1, f1, (1 << _SLOT) - f2 - f1))
    to = at[miss] + 1
    bits[to] = _ID
    y = x[miss].astype(np.int64)
    lo, width = y << (_ID - 16), np.full(len(y), 1 << (_ID - 16))
    cuts = [*_renewals(n), n]
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.append(0, np.cumsum(np.diff(x[order]) != 0))
    kinds = int(rank[order[-1]]) + 1
    ends = np.searchsorted(miss, cuts).tolist()
    for a, i, j in zip(cuts[:-1], ends[:-1], ends[1:]):
        if i < j:
            # the same intervals as _below(), for the ids of this block alone
            less = np.append(0, np.cumsum(np.bincount(rank[:a], minlength=kinds)))
            extra, z = ((1 << _ID) - ALPHABET) // a, rank[miss[i:j]]
            lo[i:j] = y[i:j] + extra * less[z]
            end = y[i:j] + 1 + extra * less[z + 1]
            width[i:j] = np.where(y[i:j] == ALPHABET - 1, 1 << _ID, end) - lo[i:j]
    start[to], size[to] = lo, width
    return start, size, bits


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes of blocks, one lane each; the steps of all are taken together. What a lane's plan doesn't fill are steps that change nothing."""
    lanes, most = len(blocks), 2 * max(map(len, blocks), default=0)
    start, bits = np.zeros((most, lanes), dtype=np.int32), np.zeros((most, lanes), dtype=np.int8)
    size = np.ones((most, lanes), dtype=np.int32)
    steps = room = 0
    for lane, b in enumerate(blocks):
        if len(b):
            plan = _plan(b)
            n = len(plan[0])
            start[:n, lane], size[:n, lane], bits[:n, lane] = plan
            steps, room = max(steps, n), max(room, int(plan[2].sum(dtype=np.int64)) // _SHIFT + 8)
    if not steps:
        return [b""] * lanes
    digits = np.zeros(lanes * room, dtype=np.int64)
    put = np.arange(lanes) * room
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << _TOP, dtype=np.int64)
    full = 1 << (_TOP - _SHIFT)
    for first, width, by in zip(start[:steps], size[:steps], bits[:steps]):
        span >>= by
        low += span * first
        span *= width
        out = (span < full).nonzero()[0]
        if len(out):
            v = low[out]
            where = put[out]
            digits[where] = v >> (_TOP - _SHIFT)
            put[out] = where + 1
            low[out] = (v & _LOW) << _SHIFT
            span[out] <<= _SHIFT
    digits[put] = low >> (_TOP - _SHIFT)
    digits[put + 1] = (low & _LOW) << (2 * _SHIFT - _TOP)
    used = put + 2 - np.arange(lanes) * room
    digits = digits.reshape(lanes, room)
    for j in range(int(used.max()) - 1, 0, -1):  # carries that were put off
        digits[:, j - 1] += digits[:, j] >> _SHIFT
        digits[:, j] &= 0xFFFFFFFF
    return [digits[lane, : used[lane]].astype(">u4").tobytes().rstrip(b"\0") if len(b) else b"" for lane, b in enumerate(blocks)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """A code for each block of ids (uint16); decode_blocks() gives the ids back, given their number."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for i in range(0, len(order), LANES):
        for j, c in zip(order[i : i + LANES], _encode([blocks[j] for j in order[i : i + LANES]])):
            out[j] = c
    return out


def decode_blocks(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks, from their codes and numbers of ids."""
    order = sorted(range(len(codes)), key=lambda i: -lengths[i])
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint16)] * len(codes)
    for i in range(0, len(order), LANES):
        some = order[i : i + LANES]
        for j, x in zip(some, _decode([codes[j] for j in some], np.array([lengths[j] for j in some]))):
            out[j] = x
    return out


def _decode(codes: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    lanes, steps = len(codes), int(lengths[0]) if len(codes) else 0
    if not steps:
        return [np.empty(0, dtype=np.uint16)] * lanes
    width = max(map(len, codes)) // 4 + 2 * steps + 4
    digits = np.zeros((lanes, width), dtype=np.int64)
    for i, c in enumerate(codes):
        d = np.frombuffer(c + b"\0" * (-len(c) % 4), dtype=">u4")
        digits[i, : len(d)] = d
    rows = np.arange(lanes)
    # the point less the lower end of the interval
    keep = 2 * _SHIFT - _TOP
    point = (digits[:, 0] << (_TOP - _SHIFT)) | (digits[:, 1] >> keep)
    rest = digits[:, 1] & ((1 << keep) - 1)
    used = np.full(lanes, 2)
    span = np.full(lanes, 1 << _TOP, dtype=np.int64)
    ids = np.zeros((steps, lanes), dtype=np.uint16)
    follow1, follow2 = (np.zeros((lanes, ALPHABET), dtype=np.uint16) for _ in range(2))
    sure1, sure2 = (np.zeros((lanes, ALPHABET), dtype=np.uint8) for _ in range(2))
    weights = np.tile(np.array(_FIRST, dtype=np.int64), (lanes, 32, 1))
    prev, prev2 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    renew, below = set(_renewals(steps)), None

    def narrow(start: np.ndarray, size: np.ndarray, bits: int, on: np.ndarray) -> None:
        r = span[on] >> bits
        p = point[on] - r * start
        r *= size
        out = np.flatnonzero(r < (1 << (_TOP - _SHIFT)))
        if len(out):
            where = on[out]
            d = digits[where, used[where]]
            p[out] = (p[out] << _SHIFT) | (rest[where] << (_SHIFT - keep)) | (d >> keep)
            rest[where] = d & ((1 << keep) - 1)
            used[where] += 1
            r[out] <<= _SHIFT
        point[on], span[on] = p, r

    for t in range(steps):
        on = rows[: int(np.searchsorted(-lengths, -t, side="left"))]
        n = len(on)
        if t in renew:
            below = [_below(ids[:t, i]) for i in range(n)]
        p1, p2 = prev[:n], _context2(prev2[:n], prev[:n])
        g1, g2, c1, c2 = follow1[on, p1], follow2[on, p2], sure1[on, p1], sure2[on, p2]
        state = c2.astype(np.int64) * 8 + c1 * 2 + (g1 == g2)
        w = weights[on, state]
        f2, f1 = _split(w[:, 0], w[:, 1], w.sum(axis=1))
        v = np.minimum(point[:n] // (span[:n] >> _SLOT), (1 << _SLOT) - 1)
        slot = np.where(v < f2, 0, np.where(v < f2 + f1, 1, 2))
        narrow(np.where(slot == 0, 0, np.where(slot == 1, f2, f2 + f1)), np.where(slot == 0, f2, np.where(slot == 1, f1, (1 << _SLOT) - f2 - f1)), _SLOT, on)
        x = np.where(slot == 0, g2, g1)
        miss = np.flatnonzero(slot == 2)
        if len(miss):
            v = np.minimum(point[miss] // (span[miss] >> _ID), (1 << _ID) - 1)
            if below is None:
                y = v >> (_ID - 16)
                lo, width = y << (_ID - 16), np.full(len(y), 1 << (_ID - 16))
            else:
                y = np.array([np.searchsorted(below[i], p, side="right") - 1 for i, p in zip(miss.tolist(), v.tolist())], dtype=np.int64)
                lo = np.array([below[i][k] for i, k in zip(miss.tolist(), y.tolist())], dtype=np.int64)
                width = np.array([below[i][k + 1] for i, k in zip(miss.tolist(), y.tolist())], dtype=np.int64) - lo
            narrow(lo, width, _ID, miss)
            x[miss] = y
        ids[t, :n] = x
        weights[on, state, slot] += _MORE
        sure1[on, p1] = (2 * (g1 == x) + (c1 >> 1)).astype(np.uint8)
        sure2[on, p2] = (2 * (g2 == x) + (c2 >> 1)).astype(np.uint8)
        follow1[on, p1] = x
        follow2[on, p2] = x
        prev2[:n], prev[:n] = prev[:n].copy(), x
    return [ids[:n, i].copy() for i, n in enumerate(lengths)]


SCHEMA = "doc_ids array<long>, lengths array<int>, n_ids int, payload binary, crc long"


def write_blocks(docs: DataFrame, block: int = BLOCK, lanes: int = LANES, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Blocks (doc_ids, lengths, n_ids, payload, crc) that hold the token ids of all rows of docs(doc_id, text) in turn.

    The ids of a text are followed by an end mark (the id after the last of the vocabulary), so every row has at least
    one, a null or empty text just that; a text may go over several blocks. doc_ids and lengths say whose ids a block
    holds, n_ids is their sum, crc is the CRC-32 of the ids as little-endian 16-bit numbers. A null id stays null; other
    columns are ignored; an empty table gives no blocks. Only the last block of a partition is shorter than `block`.
    """

    def run(it):
        mark = np.array([encoder(tokenizers, vocabulary).n_vocab], dtype=np.uint16).tobytes()
        held, heads, size = [], [], 0

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, heads, size
            ids = np.frombuffer(b"".join(held), dtype=np.uint16)
            end = len(ids) if last else len(ids) // block * block
            blocks = [ids[i : min(i + block, end)] for i in range(0, end, block)]
            ends = np.cumsum([n for _, n in heads]) if heads else np.empty(0, dtype=np.int64)
            out: dict[str, list] = {"doc_ids": [], "lengths": []}
            for i in range(len(blocks)):
                a, b = i * block, min((i + 1) * block, end)
                lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
                begin = np.maximum(np.r_[0, ends[:-1]][lo : hi + 1], a)
                out["doc_ids"].append([d for d, _ in heads[lo : hi + 1]])
                out["lengths"].append((np.minimum(ends[lo : hi + 1], b) - begin).tolist())
            if blocks:
                yield pd.DataFrame(out | {"n_ids": [len(x) for x in blocks], "payload": encode_blocks(blocks), "crc": [zlib.crc32(x.tobytes()) for x in blocks]})
            held = [ids[end:].tobytes()]
            size = len(ids) - end
            left = [(d, int(e - max(end, e - n))) for (d, n), e in zip(heads, ends) if e > end]
            heads = left

        for pdf in it:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                raw = encode_bytes(t, tokenizers, vocabulary) + mark
                held.append(raw)
                heads.append((None if d is pd.NA else d, len(raw) // 2))
                size += len(raw) // 2
                if size >= block * lanes:
                    yield from flush(False)
        if size:
            yield from flush(True)

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with a column ids (array<int>) instead of payload; raises where the ids don't agree with the checksum."""

    def run(it):
        for pdf in it:
            got = decode_blocks([bytes(p) for p in pdf["payload"]], pdf["n_ids"].tolist())
            for x, crc in zip(got, pdf["crc"]):
                if zlib.crc32(x.tobytes()) != crc:
                    raise ValueError("a block fails its checksum")
            yield pd.DataFrame({"doc_ids": pdf["doc_ids"], "lengths": pdf["lengths"], "n_ids": pdf["n_ids"], "ids": [x.astype(np.int32) for x in got], "crc": pdf["crc"]})

    return mapped(blocks.select("doc_ids", "lengths", "n_ids", "payload", "crc"), run, "doc_ids array<long>, lengths array<int>, n_ids int, ids array<int>, crc long")
