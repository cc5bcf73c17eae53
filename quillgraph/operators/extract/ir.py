"""What an analyzer finds in one file."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_SPACES = re.compile(r"\s+")


@dataclass
class Symbol:
    name: str
    qualified_name: str
    kind: str
    start: int
    end: int
    parent: str | None = None
    fingerprint: str = ""
    visibility: str = "default"
    is_partial: bool = False
    is_record: bool = False
    ordinal: int | None = None
    roles: set[str] = field(default_factory=set)
    exported: bool = False
    top_level: bool = False

    @property
    def local_key(self) -> str:
        if self.ordinal is not None:
            return f"{self.qualified_name}#{self.ordinal}"
        return f"{self.qualified_name}${self.fingerprint}" if self.fingerprint else self.qualified_name


@dataclass
class Edge:
    source: str
    kind: str
    #: local (a key), unresolved (a name to look up), external (as it is), none (nothing to find; reason says why)
    tag: str
    target: str
    at: int
    provenance: str = "extracted"
    confidence: str = "exact"
    reason: str | None = None
    specifier: str | None = None


class Analysis:
    def __init__(self, path: str, language: str, source: str):
        self.path, self.language, self.source = path, language, source
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []
        self._lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self._ascii = source.isascii()

    def place(self, at: int) -> tuple[int, int, int]:
        """Byte, line from 1 and byte column from 0 of a character."""
        line = bisect_right(self._lines, at)
        begin = self._lines[line - 1]
        if self._ascii:
            return at, line, at - begin
        return len(self.source[:at].encode()), line, len(self.source[begin:at].encode())

    def add(self, s: Symbol) -> Symbol:
        """Adds a symbol; of two with one key the first stays."""
        if all(o.local_key != s.local_key for o in self.symbols[-200:]):
            self.symbols.append(s)
        return s

    def edge(self, *a, **k) -> None:
        self.edges.append(Edge(*a, **k))


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip()
