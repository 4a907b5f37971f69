"""Site-relative line frequency: drop the lines that too many pages of their own host carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A line is boilerplate if over RATIO of its host's pages carry it, and at least LEAST of them.
RATIO, LEAST = 0.1, 5
#: A long line (so many words) is a passage if so many pages that are otherwise unlike carry it, and they are most of
#: those that do.
PASSAGE_WORDS, PASSAGE_LEAST = 50, 3
#: The boilerplate table is broadcast up to so many characters; beyond, pages are joined in so many parts of a site.
BROADCAST_CHARS, PARTS = 16_000_000, 64


def _lines(text) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def _at_site(rows: DataFrame, table: DataFrame, how: str = "inner", *, small: bool = True) -> DataFrame:
    """rows (site, ...) with the columns of their site's row of `table`. A table that is not small goes to each of PARTS
    parts of a site, so that a hot site's rows are dealt to many tasks."""
    other = table.withColumnRenamed("site", "_site")
    if small:
        return rows.join(other, F.col("site").eqNullSafe(F.col("_site")), how).drop("_site")
    dealt = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    other = other.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(other, F.col("site").eqNullSafe(F.col("_site")) & (F.col("_part") == F.col("_of")), how).drop("_site", "_part", "_of")


def boilerplate(df: DataFrame, site: Column, text: Column, *, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(site, boiler array<string>): trimmed lines that over `ratio` of the site's pages, and at least `least`, carry.

    Pages of a site with equal texts count as one, so copies of a page do not make its lines boilerplate. Lines are
    counted by hash first (24 bytes a line are shuffled, not the text); the few that are frequent enough are counted
    again as strings, so a collision of hashes cannot drop a line. A site has at most (mean lines a page) / ratio such
    lines, however many pages it has, so its array stays small. Distinct (site, line, page) rows spread a hot site or a
    hot line over all tasks before they are counted."""
    rows = df.select(site.alias("site"), text.alias("text")).withColumn("page", F.xxhash64("text"))
    totals = rows.groupBy("site").agg(F.count_distinct("page").alias("pages"))

    def frequent(lines: DataFrame, key: str) -> DataFrame:
        counts = lines.distinct().groupBy("site", key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        both = _at_site(counts, totals, small=False).where(F.col("n") > F.lit(ratio) * F.col("pages"))
        return both.groupBy("site").agg(F.collect_set(key).alias("boiler"))

    hashed = rows.select("site", "page", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.when(x != "", F.xxhash64(x))))).alias("line"))
    maybe, small = _sized(frequent(hashed.where("line is not null"), "line"), 8)
    near = _at_site(rows, maybe, small=small)
    exact = near.select("site", "page", F.explode(F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: (x != "") & F.array_contains("boiler", F.xxhash64(x)))).alias("line"))
    return frequent(exact, "line")


def _sized(boiler: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """Written once, marked for broadcast if it is small; and whether it is."""
    boiler = materialize(boiler, "boilerplate")
    size = F.aggregate("boiler", F.lit(0).cast("long"), lambda n, x: n + (F.length(x) if width == 1 else F.lit(width).cast("long")))
    total = boiler.agg(F.sum(size + 64)).first()[0] or 0
    return (F.broadcast(boiler), True) if total <= BROADCAST_CHARS else (boiler, False)


def drop_boilerplate(df: DataFrame, site: Column, text_col: str = "text", *, ratio: float = RATIO, least: int = LEAST, dropped: str = "n_dropped_lines") -> DataFrame:
    """df with the boilerplate lines of each row's site taken out of `text_col`, and a long column `dropped` (one of
    that name is replaced), how many lines went.

    Lines end at newlines and are compared trimmed of spaces; blank lines stay. A null site is a site of its own; a
    null text stays null; repeated rows and other pages with equal texts count as one page and are treated alike. A page
    that would be left without any words keeps its text whole: it is a page of its own, however many resemble it. No row
    goes. With an empty table the result is empty. Only DataFrame functions run."""
    boiler, small = _sized(boilerplate(df, site, F.col(text_col), ratio=ratio, least=least), 1)
    bad, kept = fresh(df, "_sd_bad"), fresh(df, "_sd_kept")
    out = _at_site(df.select(site.alias("site"), _whole(df)), boiler, "left", small=small).select("row.*", F.col("boiler").alias(bad))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(bad, F.trim(x)))
    return _replaced(out.withColumn(kept, F.when(F.col(bad).isNotNull(), lines)), text_col, F.col(kept), dropped).drop(bad, kept)


def _replaced(df: DataFrame, text_col: str, kept: Column, dropped: str) -> DataFrame:
    """df with the kept lines, where there are any words among them, and the number of those that went."""
    acts = kept.isNotNull() & F.exists(kept, lambda x: F.trim(x) != "")
    gone = F.when(acts, F.size(F.split(F.col(text_col), "\n")) - F.size(kept)).otherwise(0).cast("long")
    text = F.when(acts, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return df.withColumns({dropped: gone, text_col: text})


def drop_passages(df: DataFrame, text_col: str = "text", *, words: int = PASSAGE_WORDS, least: int = PASSAGE_LEAST, dropped: str = "n_dropped_lines") -> DataFrame:
    """df without the long lines that many otherwise unlike texts carry, wherever they come from: all rows are one site.

    A ratio says little about a corpus of millions of texts, so a line of `words` words or more counts by its carriers:
    it is a passage if at least `least` texts that are unlike each other carry it, and they are over half of the
    distinct texts that do. Two texts count as alike if the smallest hash among their other lines is the same; copies
    with edits mostly are, so a group of near-duplicates does not lose the lines that make it one. Nulls, empty
    texts, repeated rows, empty tables, texts that would be left empty: as in drop_boilerplate."""
    text = F.col(text_col)
    hashes = lambda x: F.transform(F.filter(_lines(x), lambda y: y != ""), lambda y: F.xxhash64(y))
    rows = df.select(F.xxhash64(text).alias("page"), F.slice(F.array_sort(F.array_distinct(hashes(text))), 1, 2).alias("low"), _lines(text).alias("lines"))
    long = rows.select("page", "low", F.explode(F.filter(F.array_distinct("lines"), lambda x: F.size(F.split(x, " +")) >= words)).alias("line"))
    long = long.select("page", F.xxhash64("line").alias("h"), "low")
    rest = F.when(F.get("low", 0) != F.col("h"), F.get("low", 0)).otherwise(F.coalesce(F.get("low", 1), F.lit(0)))
    seen = materialize(long.select("h", "page", rest.alias("rest")).distinct(), "long-lines")
    carriers = seen.groupBy("h").agg(F.count_distinct("page").alias("n"), F.count_distinct("rest").alias("m"))
    found = carriers.where((F.col("m") >= least) & (2 * F.col("m") > F.col("n"))).select("h")
    hits = seen.join(found, "h").groupBy(F.col("page").alias("site")).agg(F.collect_set("h").alias("bad"))
    hits = materialize(hits, "passages")
    most = BROADCAST_CHARS // 64
    small = hits.limit(most + 1).count() <= most
    bad, kept = fresh(df, "_sd_bad"), fresh(df, "_sd_kept")
    rows = df.select(F.xxhash64(text).alias("site"), _whole(df))
    out = _at_site(rows, F.broadcast(hits) if small else hits, "left", small=small).select("row.*", F.col("bad").alias(bad))
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(F.trim(x))))
    return _replaced(out.withColumn(kept, F.when(F.col(bad).isNotNull(), lines)), text_col, F.col(kept), dropped).drop(bad, kept)


def page_lines(html: Column) -> Column:
    """The text of a page, one block a line: scripts, styles and comments go, block tags end lines, other tags vanish."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|table|nav|article|footer|header|section|title|head|body|html)(?: [^>]*)?>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\n[ \t\n]*", "\n")
    return F.trim(x, F.lit("\n"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
