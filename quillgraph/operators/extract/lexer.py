"""Tokens of TypeScript, JavaScript and C#, with comments and white space left out; whatever is broken still gives tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_NUMBER = r"\d[\w.]*"
_TS = re.compile(rf"(?P<c>{_COMMENT})|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<t>`(?:[^`\\]|\\.)*`?)|(?P<i>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<n>{_NUMBER})|(?P<p>=>|\?\.|\.\.\.|[^\s\w])", re.S)
_CS = re.compile(rf"(?P<c>{_COMMENT}|^[ \t]*#[^\n]*)|(?P<s>\$?@\$?\"(?:[^\"]|\"\")*\"?|\"\"\".*?\"\"\"|\$?\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<i>@?[^\W\d]\w*)|(?P<n>{_NUMBER})|(?P<p>=>|\?\.|::|[^\s\w])", re.S | re.M)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_HOLE = re.compile(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    close: int = -1


def tokens(source: str, csharp: bool) -> list[Token]:
    """Tokens; a bracket's close is the place of its partner, or the end of the list where there is none."""
    out: list[Token] = []
    pattern, at, n = (_CS if csharp else _TS), 0, len(source)
    while at < n:
        if not csharp and source[at] == "/" and source[at : at + 2] not in ("//", "/*") and (not out or (out[-1].kind == "p" and out[-1].text not in ")]}") or out[-1].text in ("return", "typeof", "case")):
            m = _REGEX.match(source, at)
            if m:
                out.append(Token("r", m.group(), at, m.end()))
                at = m.end()
                continue
        m = pattern.match(source, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup or "p"
        if kind == "c":
            continue
        if kind == "i" and m.group().startswith("@") and not csharp:
            out.append(Token("p", "@", m.start(), m.start() + 1))
            out.append(Token("i", m.group()[1:], m.start() + 1, m.end()))
            continue
        out.append(Token(kind, m.group().lstrip("@") if csharp and kind == "i" else m.group(), m.start(), m.end()))
        if kind == "t":
            for hole in _HOLE.finditer(m.group()):
                for t in tokens(hole[1], False):
                    out.append(Token(t.kind, t.text, t.start + m.start() + hole.start(1), t.end + m.start() + hole.start(1)))
    stack: list[int] = []
    for i, t in enumerate(out):
        if t.kind != "p":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            for j in range(len(stack) - 1, -1, -1):
                if _OPEN[out[stack[j]].text] == t.text:
                    for k in stack[j:]:
                        out[k].close = i
                    del stack[j:]
                    break
    for i in stack:
        out[i].close = len(out)
    return out


def literal(t: Token) -> str:
    return t.text.lstrip("$@").strip("\"'`")
