"""Readers of captured pages, query lists, host scans and result payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import tags, text, urls

#: A side is broadcast up to so many rows; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Captured pages; jobs that name the columns they need do not read html."""
    pages = spark.read.schema(schemas.PAGES).parquet(path)
    return pages.select(*columns) if columns else pages


def clean_query_list(df: DataFrame, col: str = "q", cap: int | None = None) -> DataFrame:
    """Trimmed queries, blank ones dropped; more than `cap` of them raise a ValueError."""
    rows = df.withColumn(col, text.trim_space(text.text(F.col(col)))).where(F.col(col) != "")
    if cap is not None and rows.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} queries")
    return rows


def read_queries(spark: SparkSession, path: str, cap: int = 200, most: int = 2000, *, lines: bool = False) -> DataFrame:
    """(batch_id, position, q) from JSON documents {"queries": [...]}, one a file, or one a line with `lines`. Queries
    are trimmed and blank ones dropped; a document with more than `cap` (at most `most`) of them raises a ValueError.
    What is no such document has no queries; batch_id numbers the documents of this scan."""
    raw = spark.read.schema("queries array<string>").json(path, multiLine=not lines)
    rows = raw.withColumn("batch_id", F.monotonically_increasing_id()).select("batch_id", F.posexplode("queries").alias("position", "q"))
    rows, cap = clean_query_list(rows, "q"), min(cap, most)
    if not rows.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") > cap).isEmpty():
        raise ValueError(f"a document has more than {cap} queries")
    return rows


def read_host_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row an address; fields that are missing are empty arrays."""
    return host_scan(spark.read.schema(schemas.HOST_SCAN).json(path))


def host_scan(df: DataFrame) -> DataFrame:
    arrays = {"ports": "array<int>", "hostnames": "array<string>", "cpes": "array<string>", "tags": "array<string>", "vulns": "array<string>"}
    return df.select("ip", *[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c, kind in arrays.items()])


def _first_of(field: Column) -> Column:
    """A JSON value as text; of a list its first entry."""
    raw = F.trim(field)
    return F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), 0)).otherwise(F.coalesce(F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 0), raw))


def result_items(raw: Column, kind: str) -> Column:
    """array<struct<pos, title, url, snippet>> of a JSON payload (see read_result_json): urls once, the first wins, in
    order, inside the payload's row."""
    words = lambda c: text.collapse(text.text(c))
    item = lambda k, title, url, snippet: F.struct(k.alias("pos"), title.alias("title"), url.alias("url"), snippet.alias("snippet"))
    if kind == "docs":
        docs = F.from_json(raw, "response struct<docs array<struct<identifier string, title string, description string>>>").getField("response").getField("docs")

        def doc(d, k):
            def named(i):
                title = text.collapse(F.coalesce(F.nullif(_first_of(d["title"]), F.lit("")), i))
                url = F.concat(F.lit("https://archive.org/details/"), F.replace(F.url_encode(i), F.lit("+"), F.lit("%20")))
                snippet = F.substring(text.collapse(F.coalesce(_first_of(d["description"]), F.lit(""))), 1, 300)
                return F.when((i != "") & ~i.rlike(r"[/\s]"), item(k, title, url, snippet))

            return text.let(F.trim(F.coalesce(d["identifier"], F.lit(""))), named)

        found = F.filter(F.transform(docs, doc), lambda x: F.length(x["title"]) >= 2)
    elif kind == "opensearch":

        def pages_of(parts):
            lists = [F.from_json(F.get(parts, k), "array<string>") for k in (1, 2, 3)]
            zipped = F.arrays_zip(lists[0].alias("t"), lists[1].alias("d"), lists[2].alias("u"))
            return F.when(F.size(parts) >= 4, F.transform(zipped, lambda z, k: item(k, words(z["t"]), F.trim(z["u"]), F.substring(words(z["d"]), 1, 300))))

        stands = lambda x: x["url"].rlike(urls.HTTP) & urls.host(x["url"]).rlike(r"(?:^|\.)wikipedia\.org$") & (F.length(x["title"]) >= 2)
        found = F.filter(text.let(F.from_json(raw, "array<string>"), pages_of), stands)
    elif kind == "items":
        items = F.from_json(raw, "array<struct<title string, link string, snippet string>>")
        found = F.transform(items, lambda x, k: item(k, words(x["title"]), urls.clean(x["link"]), words(x["snippet"])))
        found = F.filter(found, lambda x: x["url"].rlike(urls.HTTP))
    else:
        raise ValueError(f"no such kind of payload: {kind}")
    return tags.first_of_each(found, "url")


def read_result_json(df: DataFrame, kind: str, body: str = "body", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Result rows (by, pos, title, url, snippet, rank) of JSON payloads, or (by, pos, suggestion) for kind suggest.

    docs: {"response": {"docs": [{identifier, title, description}]}}, opensearch: [query, titles, texts, urls], items:
    [{title, link, snippet}], suggest: [query, [strings]], perhaps after a )]}' line. Payloads that cannot be read give
    no rows. Urls repeat once a payload, the first wins; nothing is shuffled."""
    keys, raw = list(by), text.text(F.col(body))
    if kind == "suggest":
        plain = F.regexp_replace(text.trim_space(raw), r"^\)\]\}'[^\n]*\n", "")
        items = F.from_json(F.get(F.from_json(plain, "array<string>"), 1), "array<string>")
        rows = df.select(*keys, F.posexplode(items).alias("pos", "_s")).withColumn("suggestion", text.clean(F.col("_s"), feed=True))
        return rows.where(F.col("suggestion") != "").select(*keys, "pos", "suggestion")
    rows = df.select(*keys, F.posexplode(result_items(raw, kind)).alias("_at", "_r"))
    return rows.select(*keys, "_r.*", (F.col("_at") + 1).alias("rank"))


def read_news_rss(df: DataFrame, col: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, pos, title, link, pub_date, published, source, source_url) of each titled item of a feed."""
    items = F.regexp_extract_all(text.text(F.col(col)), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    rows = df.select(*by, F.posexplode(items).alias("pos", "_item"))

    def field(name: str) -> Column:
        raw = F.regexp_extract("_item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return text.clean(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), feed=True)

    some = lambda c: F.when(c != "", c)
    source_url = text.decode_entities(F.regexp_extract("_item", r'(?i)<source\b[^>]*\burl="([^"]*)"', 1), feed=True)
    published = F.try_to_timestamp(F.regexp_replace(field("pubDate"), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    rows = rows.select(
        *by, "pos", field("title").alias("title"), field("link").alias("link"), field("pubDate").alias("pub_date"), published.alias("published"),
        some(field("source")).alias("source"), some(source_url).alias("source_url"),
    )
    return rows.where("title <> ''")


def read_embedded_extras(df: DataFrame, col: str = "html", marker: str = "serp-extras", out: str = "extras", schema: str = schemas.EXTRAS) -> DataFrame:
    """The JSON of the comment <!--marker:...--> as a struct; null where there is none or it cannot be read."""
    raw = F.regexp_extract(text.text(F.col(col)), rf"(?s)<!--{text.literal_pattern(marker)}:(.*?)-->", 1)
    good = F.try_parse_json(raw).isNotNull() if hasattr(F, "try_parse_json") else F.lit(True)
    return df.withColumn(out, F.when((raw != "") & good, F.from_json(raw, schema)))
