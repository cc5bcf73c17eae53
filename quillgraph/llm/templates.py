"""Text of web pages without the templates of their sites: every element is hashed with all that is in it, hashes are
counted for each host, and elements that recur on many pages of a host are deleted."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import mapped, written

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no text; each ends with its own end tag, or the page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: An element that begins closes an open one of these kinds.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "br", "html", "body", "title"}}
#: Elements between which such closing stops.
_SCOPE = frozenset("div article section main nav header footer aside table ul ol body td th form blockquote".split())
_NO_TEXT = frozenset({"head"})
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "hash")

    def __init__(self, tag: str):
        self.tag, self.parts, self.hash = tag, [], 0


def tokens(text: str) -> Iterator[tuple[str, bool, bool]]:
    """The parts of a page in turn: (text, False, False), or (name, True, open) of a tag; open: whether it begins an element that may hold others. An end tag's name begins with a slash.

    Comments, declarations and elements without text are passed over. A `<` that begins nothing is text, and so is a tag that
    never ends. One walk from left to right: where quotes in a tag don't close, they count as other characters do, from there to
    the end of the page if need be, so no part is walked twice.
    """
    at, n, last = 0, len(text), text.rfind(">")
    closing = {q: text.rfind(q) for q in "\"'"}
    quoted = True
    begin = 0  # of text that is not yet given
    while True:
        at = text.find("<", at)
        if at < 0 or at > last and not text.startswith("<!--", at):
            break
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = n if end < 0 else end + 3
            name = None
        elif text[at + 1] in "!?":
            end, name = text.index(">", at) + 1, None
        elif m := _NAME.match(text, at + 1):
            name, end = m.group().lower(), m.end()
            while True:
                stop = _STOP.search(text, end) if quoted else None
                if stop is None:
                    if not quoted:
                        end = text.index(">", m.end()) + 1
                        break
                    # the quotes have swallowed the end of the tag
                    quoted, end = False, m.end()
                    continue
                c = stop.group()
                if c == ">":
                    end = stop.end()
                    break
                end = text.index(c, stop.end()) + 1 if closing[c] > stop.start() else stop.end()
        else:
            at += 1
            continue
        if at > begin:
            yield text[begin:at], False, False
        if name in _RAW and name is not None:
            close = _RAW[name].search(text, end)
            end = close.end() if close else n
        elif name is not None:
            yield name, True, not (name in _VOID or name[0] == "/" or text[m.end() : end - 1].rstrip().endswith("/"))
        at = begin = end
    if begin < n:
        yield text[begin:], False, False


def parse(text: str) -> Node:
    """The elements of a page as a tree; whatever isn't closed ends with its parent, and stray end tags are passed over."""
    root = Node("")
    stack = [root]
    where: dict[str, list[int]] = {}  # tag -> places of its open elements in the stack
    scopes: list[int] = []  # places of the open elements of _SCOPE

    def cut(i: int) -> None:
        for node in stack[i:]:
            where[node.tag].pop()
            if node.tag in _SCOPE:
                scopes.pop()
        del stack[i:]

    for tag, is_tag, opens in tokens(text):
        if not is_tag:
            stack[-1].parts.append(tag)
            continue
        if tag[0] == "/":
            if places := where.get(tag[1:]):
                cut(places[-1])
            continue
        if closes := _CLOSES.get(tag):
            i = max((where[t][-1] for t in closes if where.get(t)), default=0)
            if i and i >= (scopes[-1] if scopes else 0):
                cut(i)
        node = Node(tag)
        stack[-1].parts.append(node)
        if opens:
            where.setdefault(tag, []).append(len(stack))
            if tag in _SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    return root


def hashed(root: Node) -> dict[int, int]:
    """Sets the hash of every element (of its tag, its words and its elements, in order); hash -> number of letters and digits within, of those elements that have some."""
    out: dict[int, int] = {}
    todo = [(root, False)]
    sizes: dict[int, int] = {}
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(p, False) for p in node.parts if isinstance(p, Node)]
            continue
        key, size = [node.tag], 0
        for p in node.parts:
            if isinstance(p, Node):
                key.append(f"\1{p.hash}")
                size += sizes[id(p)]
            elif t := _SPACE.sub(" ", p).strip():
                key.append("\2" + t)
                size += len(t)
        node.hash = xxhash.xxh3_64_intdigest("\0".join(key).encode("utf-8", "surrogatepass")) - 2**63
        sizes[id(node)] = size
        if size and node.tag and node.tag not in ("html", "body"):
            out[node.hash] = size
    return out


def text_of(root: Node, gone: set[int] | frozenset[int] = frozenset()) -> tuple[str, int]:
    """The text without the elements whose hashes are in gone, a line for each block, and how many elements went."""
    out: list[str] = []
    removed = 0
    todo: list[Node | str] = [root]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
            continue
        if p.hash in gone and p.tag:
            removed += 1
            continue
        if p.tag in _NO_TEXT:
            continue
        edge = ["\n"] if p.tag in _BLOCK else []
        todo += [*edge, *(x if isinstance(x, Node) else _SPACE.sub(" ", x) for x in reversed(p.parts)), *edge]
    lines = (_SPACE.sub(" ", _html.unescape(line)).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def subtrees(pages: DataFrame) -> DataFrame:
    """(page_id, host, hash): the distinct elements with text of every page."""

    def run(it):
        for pdf in it:
            ids, hosts, hashes = [], [], []
            for i, u, h in zip(pdf["page_id"].tolist(), pdf["url"], pdf["html"]):
                found = list(hashed(parse(h))) if h else []
                ids += [None if i is pd.NA else i] * len(found)
                hosts += [host_of(u)] * len(found)
                hashes += found
            yield pd.DataFrame({"page_id": pd.array(ids, dtype="Int64"), "host": hosts, "hash": np.array(hashes, dtype=np.int64)})

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, host string, hash long")


def recurring(trees: DataFrame, least: int) -> DataFrame:
    """(host, hash, n) of elements on `least` pages of a host or more, however many pages the host has."""
    return trees.groupBy("host", "hash").agg((F.count_distinct("page_id") + F.max(F.col("page_id").isNull().cast("int"))).alias("n")).where(F.col("n") >= least)


def main_text(pages: DataFrame, least: int = 3, most: int = 500_000) -> DataFrame:
    """(page_id, host, removed, text) for every row of pages(page_id, url, html): its text without recurring elements.

    An element recurs if it stands, with the same tag and the same words and elements within, on `least` pages of the
    host, be they few or many of its pages; the outermost recurring element goes with all that is in it (removed: how many).
    Heads, scripts and styles are no text. Pages that are null or empty have the text ''; a null or odd url has the host
    ''; rows with a null id count as one page of their host, repeated rows of an id as one, and each is returned. Other
    columns are ignored; an empty table gives no rows. A very long page is read in time linear in its length. Up to `most` recurring elements are broadcast; more are joined.
    """
    trees = written(subtrees(pages), "subtrees")
    found = written(recurring(trees, least).select("host", "hash"), "recurring")
    spark = pages.sparkSession
    schema = "page_id long, host string, removed int, text string"
    base = pages.select("page_id", "url", "html")
    if found.count() <= most:
        table: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            table.setdefault(r["host"], set()).add(r["hash"])
        shared = spark.sparkContext.broadcast(table)

        def known(it):
            for pdf in it:
                yield from _extract(pdf, [shared.value.get(host_of(u), frozenset()) for u in pdf["url"]])

        return mapped(base, known, schema)
    lists = trees.join(found, ["host", "hash"], "left_semi").groupBy("host", "page_id").agg(F.collect_set("hash").alias("gone"))

    def hosted(it):
        for pdf in it:
            yield pd.DataFrame({"page_id": pdf["page_id"], "host": [host_of(u) for u in pdf["url"]], "url": pdf["url"], "html": pdf["html"]})

    def joined(it):
        for pdf in it:
            yield from _extract(pdf, [frozenset() if g is None else set(g) for g in pdf["gone"]])

    named = mapped(base, hosted, "page_id long, host string, url string, html string")
    same = (named["host"] == lists["host"]) & named["page_id"].eqNullSafe(lists["page_id"])
    rows = named.join(lists, same, "left").select(named["page_id"], "url", "html", "gone")
    return mapped(rows, joined, schema)


def _extract(pdf: pd.DataFrame, gone: list):
    texts, removed = [], []
    for h, g in zip(pdf["html"], gone):
        if h:
            root = parse(h)
            if g:
                hashed(root)
            t, n = text_of(root, g)
        else:
            t, n = "", 0
        texts.append(t)
        removed.append(n)
    yield pd.DataFrame({"page_id": pdf["page_id"], "host": [host_of(u) for u in pdf["url"]], "removed": np.array(removed, dtype=np.int32), "text": texts})
