"""Search operators in query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, trim_space
from .urls import site_value

# The operators; ext: is filetype.
OPERATORS = ("site", "inurl", "intitle", "intext", "allintext", "inbody", "inanchor", "filetype", "related", "cache", "title", "url", "mime")
SPELLINGS = {"filetype": "(?:filetype|ext)"}

# The operators that each engine takes; an engine that is not listed takes site and filetype.
_FULL = ("site", "inurl", "intitle", "intext", "allintext", "inbody", "inanchor", "filetype", "related", "cache")
_USUAL = ("site", "intitle", "inurl", "filetype")
CAPABILITY = {
    "google": _FULL, "google_lite": _FULL, "chrome": _FULL,
    "bing": ("site", "intitle", "intext", "inbody", "inanchor", "filetype"),
    "yahoo": _USUAL, "duckduckgo": _USUAL, "duckduckgo_lite": _USUAL,
    "brave": ("site", "intitle", "intext", "filetype"),
    "mojeek": _USUAL, "startpage": _USUAL, "ecosia": _USUAL, "qwant": _USUAL,
    "swisscows": ("site", "filetype"), "seznam": ("site", "intitle", "url"), "yandex": ("site", "title", "url", "mime"),
    "marginalia": ("site", "filetype"), "wiby": (), "github": (), "wikipedia": (), "archive": (), "shodan": (),
}
DEFAULT_CAPABILITY = ("site", "filetype")


def unquote(v: Column) -> Column:
    return F.regexp_replace(trim_space(v), r'(?s)^"(.*)"$', "$1")


def operator_values(q: Column, name: str) -> Column:
    """The values that a query gives to one operator, unquoted, distinct, in order."""
    found = F.regexp_extract_all(q, F.lit(rf'(?i)\b{SPELLINGS.get(name, name)}:\s*("[^"]+"|[^\s]+)'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, unquote), lambda v: v != ""))


def any_operator(q: Column) -> Column:
    names = "|".join(SPELLINGS.get(n, n) for n in OPERATORS)
    return q.rlike(rf'(?i)\b(?:{names}):\s*("[^"]+"|[^\s]+)')


def operators(q) -> Column:
    """map<operator, values> of the operators that have a value."""
    q = text(q)
    both = F.map_from_arrays(F.array(*[F.lit(n) for n in OPERATORS]), F.array(*[operator_values(q, n) for n in OPERATORS]))
    return F.map_filter(both, lambda _, v: F.size(v) > 0)


def phrases(q) -> Column:
    """Quoted strings of two characters or more."""
    return F.regexp_extract_all(text(q), F.lit(r'"([^"]{2,})"'), F.lit(1))


def exclusions(q) -> Column:
    """Words after a minus sign at the beginning of a word."""
    return F.regexp_extract_all(text(q), F.lit(r"(?:^|\s)-(\S+)"), F.lit(1))


def site_targets(sites: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(sites, lambda v: site_value(unquote(v))), lambda v: v != ""))


def parsed(q) -> Column:
    """All of it as one struct."""
    ops = operators(q)
    sites = F.coalesce(F.try_element_at(ops, F.lit("site")), F.array().cast("array<string>"))
    marked = any_operator(text(q)) | (F.size(phrases(q)) > 0) | (F.size(exclusions(q)) > 0)
    return F.struct(
        ops.alias("operators"), phrases(q).alias("phrases"), exclusions(q).alias("exclusions"), site_targets(sites).alias("site_targets"),
        marked.alias("is_dork"), (F.size(ops) > 0).alias("has_operators"),
    )
