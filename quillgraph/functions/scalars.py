"""Scalar functions of the graph queries, all of built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.model import CONFIDENCES


def confidence_rank(c: Column) -> Column:
    """4 for exact down to 0 for unresolved; text that is no confidence ranks 0, as does null."""
    out = F.when(c == CONFIDENCES[4], 4)
    for rank in (3, 2, 1):
        out = out.when(c == CONFIDENCES[rank], rank)
    return out.otherwise(0)


def weaker(a: Column, b: Column) -> Column:
    """The weaker of two confidences."""
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.least(confidence_rank(a), confidence_rank(b)) + 1)


def bare_name(c: Column) -> Column:
    """What follows the last :: and then the last dot."""
    return F.substring_index(F.substring_index(c, "::", -1), ".", -1)


def local_name(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def fts_tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, between single spaces, with one at either end."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def phrase_match(query: str, *columns: Column) -> Column:
    """Whether one of the columns has the tokens of query in a row; a query without tokens matches nothing."""
    q = fts_tokens(F.lit(query))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(fts_tokens(c), q)
    return out & (F.length(F.trim(q)) > 0)


def partial_terms(c: Column) -> Column:
    """Up to three distinct terms of three bytes or more, cut at what isn't alphanumeric and before capitals."""
    cut = F.regexp_replace(F.regexp_replace(c, r"(\p{Lu})", " $1"), r"[^\p{L}\p{N}]+", " ")
    terms = F.array_distinct(F.transform(F.split(F.trim(cut), " "), F.lower))
    return F.slice(F.filter(terms, lambda t: F.octet_length(t) >= 3), 1, 3)


def route_key(c: Column) -> Column:
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("/"), F.lit("")))


def join_route(prefix: Column, template: Column) -> Column:
    """Two parts of a route with one slash between; an empty part adds none."""
    p, t = F.rtrim(F.coalesce(prefix, F.lit("")), F.lit("/")), F.ltrim(F.coalesce(template, F.lit("")), F.lit("/"))
    return F.when(p == "", t).when(t == "", p).otherwise(F.concat(p, F.lit("/"), t))


def join_relative(importer: Column, specifier: Column) -> Column:
    """Path of a relative specifier, as seen from a file: . and .. are worked off, and .. above the root is passed over."""
    folder = F.when(F.contains(importer, F.lit("/")), F.regexp_replace(importer, "/[^/]*$", "")).otherwise(F.lit(""))
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def file_candidates(path: Column) -> Column:
    """Where a module of this path may be, the first choice first."""
    tails = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    return F.array(*[F.concat(path, F.lit(t)) for t in tails])


def language_of(path: Column) -> Column:
    """Language by extension, or null."""
    from quillgraph.model import LANGUAGES

    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.contains(F.substring_index(path, "/", -1), F.lit(".")), F.try_element_at(table, F.substring_index(path, ".", -1)))


def resolution_domain(language: Column) -> Column:
    """TypeScript and JavaScript see each other; C# only itself."""
    return F.when(language.isin("typescript", "javascript"), "web").when(language == "csharp", "csharp")


def matches_filter(path: Column, wanted: Column) -> Column:
    """A path is the wanted one, or below it as a folder."""
    return (path == wanted) | F.startswith(path, F.concat(wanted, F.lit("/")))


def is_oversized(changed: Column, tracked: Column, percent: Column) -> Column:
    return F.when(tracked == 0, changed > 0).otherwise(changed * 100 > tracked * percent)


def pending_warning(pending: Column) -> Column:
    return F.when(pending > 0, F.format_string("%d file(s) changed since the last index; results may be stale", pending))


def visibility_of(modifiers: Column) -> Column:
    """C# modifiers (array) as one visibility, compound ones first."""
    has = lambda m: F.array_contains(modifiers, m)
    return (
        F.when(has("protected") & has("internal"), "protectedinternal").when(has("private") & has("protected"), "privateprotected").when(has("public"), "public").when(has("protected"), "protected").when(has("internal"), "internal").when(has("private"), "private").otherwise("default")
    )


def fingerprint(*parts: Column) -> Column:
    """Parts with white space runs as one space, joined by the unit separator."""
    return F.concat_ws("\x1f", *[F.trim(F.regexp_replace(p, r"\s+", " ")) for p in parts])


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


KIND_COLOURS = {"class": "#4f7cac", "interface": "#7a9e7e", "function": "#c08552", "method": "#a26769", "namespace": "#6d6875", "module": "#8d99ae"}
OPACITY = {"exact": 1.0, "high": 0.85, "medium": 0.6, "low": 0.4}


def kind_colour(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("#999999"))


def confidence_opacity(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OPACITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(0.25))


TAU = 2 * math.pi


def parsed(c: Column, domain: tuple[str, ...], default: str) -> Column:
    """A stored value, or the default of its domain where it is unknown."""
    return F.when(c.isin(*domain), c).otherwise(F.lit(default))
