"""Tags of a page as expressions: attributes in any of their three spellings, and the anchors of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: An attribute: its name and, after an equals sign, a value in double quotes, in single quotes, or up to white space.
ATTRIBUTE = r"""([^\s>"'/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+"""
#: What stands between a tag's name and its end. A > inside a quoted value does not end the tag.
INSIDE = r"""(?:[^\s>"'/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|[\s/"'=]++)*+"""
#: What a document does not show as elements: comments, and elements whose content is text.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\z)"
#: An anchor's attributes, and its content up to its end, or up to the next anchor, which ends it too.
ANCHOR = rf"(?is)<a(?=[\s/>])({INSIDE})>(.*?)(?=</a\s*>|<a(?=[\s/>])|\z)"
#: Marks between attributes, between name and value, and after a value; white space where a page has one of them.
_NEXT, _IS, _END = "\x01", "\x02", "\x03"


def marked(inside: Column) -> Column:
    """The attributes of a tag in one string, in one pass: what `attribute` reads."""
    return F.regexp_replace(F.translate(inside, _NEXT + _IS + _END, "   "), ATTRIBUTE, f"{_NEXT}$1{_IS}$2$3$4{_END}")


def attribute(marked_: Column, name: str) -> Column:
    """The value of the first attribute with a name (lower case); null if there is none."""
    found = F.regexp_extract(marked_, f"(?i){_NEXT}{name}{_IS}([^{_END}]*){_END}", 0)
    return F.when(found != "", F.substring(found, len(name) + 3, F.length(found) - F.lit(len(name) + 3)))


def shown(html: Column) -> Column:
    """A page without what is no element of its document."""
    return F.regexp_replace(text(html), HIDDEN, " ")


def anchors(html: Column) -> Column:
    """array<struct<tag, label>>: the marked attributes and the content of each anchor, in order; html as `shown`."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
    return F.transform(found, lambda a: F.struct(marked(a["tag"]).alias("tag"), a["label"].alias("label")))


def without(html: Column, *names: str, role: str | None = None) -> Column:
    """A page without the elements of some names, and without those of a role (up to the first end tag of their name)."""
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}(?=[\s/>]){INSIDE}>.*?</{name}\s*>", " ")
    if role:
        spelled = rf"""(?=[^>]*\srole\s*=\s*["']?{role}["'\s>])"""
        html = F.regexp_replace(html, rf"(?is)<([a-z][a-z0-9]*)(?=[\s/>]){spelled}{INSIDE}>.*?</\1\s*>", " ")
    return html


def first_of_each(items: Column, key: str, most: int | None = None) -> Column:
    """The first item of each value of its field `key`, in order, `most` at most: first-wins inside one row, without a
    shuffle. Items whose key is null go."""
    kept = F.filter(items, lambda x: x[key].isNotNull())

    def pick(pair):
        distinct = F.array_distinct(pair["keys"])
        distinct = F.slice(distinct, 1, most) if most else distinct
        return F.transform(distinct, lambda k: F.get(pair["items"], (F.array_position(pair["keys"], k) - 1).cast("int")))

    both = F.transform(F.array(kept), lambda a: F.struct(a.alias("items"), F.transform(a, lambda x: x[key]).alias("keys")))
    return F.get(F.transform(both, pick), 0)
