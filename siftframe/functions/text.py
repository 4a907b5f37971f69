"""Text expressions: white space, tags, entities, query strings, credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as browsers count it, for Java and RE2 alike.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# The entities that are decoded, in order. Pages decode the ampersand first, feeds last, so that
# "&amp;lt;" becomes "<" in the one and "&lt;" in the other.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
PAGE_ONLY, FEED_ONLY = ("&#x27;", "'"), ("&apos;", "'")
AMPERSAND = ("&amp;", "&")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose value is computed once a row: filters on it are not pushed below, where they would each
    compute it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def text(c) -> Column:
    """As a string, null as the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def decode_entities(c: Column, *, feed: bool = False) -> Column:
    pairs = [*ENTITIES, FEED_ONLY, AMPERSAND] if feed else [AMPERSAND, *ENTITIES, PAGE_ONLY]
    for entity, char in pairs:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trim_space(c)


def clean(c: Column, *, feed: bool = False) -> Column:
    """Tags out, white space collapsed, then entities decoded, in this order."""
    return decode_entities(strip_tags(text(c)), feed=feed)


def normal_query(c: Column, most: int = 512) -> Column:
    """Zero-width characters out, white space collapsed, at most `most` characters."""
    return F.substring(collapse(F.regexp_replace(text(c), r"[\x{200B}-\x{200D}\x{FEFF}]", "")), 1, most)


def mask_credentials(c: Column) -> Column:
    """//user:password@ to //***@."""
    return F.regexp_replace(text(c), r"//[^/@\s]*:[^/@\s]*@", "//***@")


def literal_pattern(c: str) -> str:
    """A string as a pattern that matches itself, in Java and RE2."""
    return "".join(x if x.isalnum() or x in "_/" else "\\" + x for x in c)


def any_of(words: list[str]) -> str:
    return "|".join(literal_pattern(w) for w in words)
