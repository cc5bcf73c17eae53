"""BLAKE3 in Python, for identities that must agree with stores that use it; Arrow-batched. SHA-256 is the default elsewhere."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_M = 0xFFFFFFFF


def _mix(s: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        s[a] = (s[a] + s[b] + word) & _M
        v = s[d] ^ s[a]
        s[d] = (v >> r1 | v << (32 - r1)) & _M
        s[c] = (s[c] + s[d]) & _M
        v = s[b] ^ s[c]
        s[b] = (v >> r2 | v << (32 - r2)) & _M


def _squeeze(cv: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> tuple[int, ...]:
    words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*cv, *_IV[:4], counter & _M, counter >> 32, size, flags]
    for r in range(7):
        for k in range(4):
            _mix(s, k, 4 + k, 8 + k, 12 + k, words[2 * k], words[2 * k + 1])
        for k in range(4):
            _mix(s, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, words[8 + 2 * k], words[9 + 2 * k])
        if r < 6:
            words = [words[i] for i in _ORDER]
    return tuple(a ^ b for a, b in zip(s[:8], s[8:]))


def _chunk(data: bytes, counter: int, last: int) -> tuple[int, ...]:
    cv: tuple[int, ...] = _IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        cv = _squeeze(cv, b, counter, len(b), (i == 0) | (i == len(blocks) - 1) * (2 | last))
    return cv


def _tree(data: bytes, counter: int, last: int) -> tuple[int, ...]:
    if len(data) <= 1024:
        return _chunk(data, counter, last)
    half = 1024 << (((len(data) - 1) // 1024).bit_length() - 1)
    left, right = _tree(data[:half], counter, 0), _tree(data[half:], counter + half // 1024, 0)
    return _squeeze(_IV, struct.pack("<16I", *left, *right), 0, 64, 4 | last)


def blake3_hex(data: bytes) -> str:
    return struct.pack("<8I", *_tree(data, 0, 8)).hex()


def blake3(column: Column) -> Column:
    """Hex digest of a text column; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake3_hex(t.encode()))

    return F.pandas_udf(run, "string")(column)
