"""Column jobs over a table. Each returns the table with the named columns added or replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hosts, query_ops, text, urls


def canonicalize_urls(df: DataFrame, col: str = "url", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, urls.canonical(F.col(col)))


def clean_urls(df: DataFrame, col: str = "url", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, urls.clean(F.col(col)))


def unwrap_redirects(df: DataFrame, col: str = "url", out: str | None = None, *, cleaned: bool = True) -> DataFrame:
    """Result links to their targets; cleaned ones of the wrappers' own hosts become empty."""
    return df.withColumn(out or col, urls.target(F.col(col)) if cleaned else urls.unwrap(F.col(col)))


def resolve_links(df: DataFrame, href: str, base: str, out: str = "resolved") -> DataFrame:
    """Links against the page they are on, dot segments resolved; null where they lead to no http url."""
    return df.withColumn(out, urls.resolve(F.col(href), F.col(base)))


def host_columns(df: DataFrame, col: str = "url") -> DataFrame:
    """host, bare_host and host_labels."""
    u = F.col(col)
    return df.withColumns({"host": urls.host(u), "bare_host": urls.bare_host(u), "host_labels": urls.labels(u)})


def site_hosts(df: DataFrame, col: str, out: str = "site_host") -> DataFrame:
    return df.withColumn(out, urls.site_value(query_ops.unquote(text.text(F.col(col)))))


def pick_best_link(df: DataFrame, array_col: str, out: str = "best_link") -> DataFrame:
    return df.withColumn(out, urls.best_link(F.col(array_col)))


def breadcrumb_to_url(df: DataFrame, col: str, out: str = "breadcrumb_url") -> DataFrame:
    return df.withColumn(out, urls.from_breadcrumb(text.clean(F.col(col))))


def expand_index_of(df: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    return df.withColumn(url, urls.index_of(text.text(F.col(url)), F.col(title)))


def clean_text(df: DataFrame, col: str, out: str | None = None, *, feed: bool = False) -> DataFrame:
    return df.withColumn(out or col, text.clean(F.col(col), feed=feed))


def normalize_queries(df: DataFrame, col: str = "q", most: int = 512) -> DataFrame:
    return df.withColumn(col, text.normal_query(F.col(col), most))


def parse_query_operators(df: DataFrame, col: str = "q") -> DataFrame:
    """operators, phrases, exclusions, site_targets, is_dork, has_operators. An operator without a value still makes a
    query one with marks (is_dork); only operators with values count for has_operators."""
    return df.withColumn("_parsed", query_ops.parsed(F.col(col))).select("*", "_parsed.*").drop("_parsed")


def to_host_records(df: DataFrame, out: str = "host") -> DataFrame:
    """A host struct from url, title, ip, ports, hostnames and org."""
    return df.withColumn(out, hosts.host_record(*[F.col(c) for c in ("url", "title", "ip", "ports", "hostnames", "org")]))


def parse_cpe(df: DataFrame, col: str, out: str = "cpe") -> DataFrame:
    return df.withColumn(out, hosts.cpe(F.col(col)))


def ip_to_number(df: DataFrame, col: str, out: str = "ip_number") -> DataFrame:
    return df.withColumn(out, hosts.ip_number(F.col(col)))


def project_host_fields(df: DataFrame, fields: list[str], col: str = "host") -> DataFrame:
    """The host struct with the named fields that it has, 32 at most, in the order asked for."""
    own = df.schema[col].dataType.fieldNames()
    named = [f for f in [x.strip() for x in fields if x.strip()][:32] if f in own]
    return df.withColumn(col, F.struct(*[F.col(f"{col}.{f}").alias(f) for f in dict.fromkeys(named)]) if named else F.lit(None))


def mask_credentials(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, text.mask_credentials(F.col(col)))


def content_fingerprint(df: DataFrame, cols: list[str], out: str = "fingerprint") -> DataFrame:
    """The first 16 hexadecimal digits of the SHA-256 of the columns as a JSON object, nulls included."""
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.withColumn(out, F.substring(F.sha2(body, 256), 1, 16))


# Codes that tell a caller no more than that an engine could not be used.
UNAVAILABLE = ("BLOCKED", "SORRY", "CIRCUIT_OPEN", "NO_ATTEMPT", "QUEUE_TIMEOUT", "TIMEOUT")
HARD_BLOCKS = ("BLOCKED", "SORRY")
NETWORK = r"(?i)ERR_EMPTY_RESPONSE|ERR_CONNECTION|ERR_TUNNEL|ERR_SOCKS|ERR_TIMED_OUT|ERR_PROXY|ERR_HTTP2|net::ERR_|Navigation timeout|Timeout|ECONNRESET|ENOTFOUND"


def public_code(df: DataFrame, col: str = "code", out: str = "public_code") -> DataFrame:
    c = F.col(col)
    return df.withColumn(out, F.when(c.isin(*UNAVAILABLE), "ENGINE_UNAVAILABLE").when(F.coalesce(c, F.lit("")) == "", "ERROR").otherwise(c))


# Spellings of engine names, and what "all" means.
ALIASES = {"googlelite": "google_lite", "google-lite": "google_lite", "glite": "google_lite", "chromium": "chrome"}
ALL_ENGINES = ("google", "duckduckgo", "bing")


def alias_engines(df: DataFrame, col: str = "engines", out: str = "engine_list") -> DataFrame:
    """A comma list of engine names to an array of canonical ones; * and all name three, nothing names the default."""
    raw = F.lower(F.trim(F.coalesce(F.col(col), F.lit(""))))
    names = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    listed = F.transform(names, lambda x: F.coalesce(known[x], x))
    every = F.array(*[F.lit(e) for e in ALL_ENGINES])
    return df.withColumn(out, F.when(raw.isin("*", "all"), every).when(F.size(names) == 0, F.array(F.lit(ALL_ENGINES[0]))).otherwise(listed))


CATEGORIES = ("social", "dev", "ugc", "forum", "blog")


def resolve_filter_policy(df: DataFrame, params: str = "params", out: str = "policy") -> DataFrame:
    """What a query's parameters ask to leave out: a struct of social, dev, ugc, forum, blog (null: the default),
    exclude_domains and allow_domains.

    `unique` turns all on, then the `exclude` list, then 0 or 1 for each category. A query with operators turns on
    those that are still unset, and its host-like site targets are allowed whatever they are. Needs the columns of
    parse_query_operators."""
    p = F.col(params)
    get = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    parts = lambda k: F.filter(F.transform(F.split(F.lower(get(k)), ","), lambda x: F.trim(x)), lambda x: x != "")
    unique = get("unique").isin("1", "true")

    def flag(name):
        asked = F.when(get(name).isin("1", "true"), True).when(get(name).isin("0", "false"), False)
        asked = F.coalesce(asked, F.when(unique | F.array_contains(parts("exclude"), name), True))
        return F.coalesce(asked, F.when(F.col("has_operators"), True)).alias(name)

    allow = F.filter("site_targets", lambda t: t.contains(".") & ~t.startswith("."))
    return df.withColumn(out, F.struct(*[flag(c) for c in CATEGORIES], parts("exclude_domains").alias("exclude_domains"), allow.alias("allow_domains")))


def classify_errors(df: DataFrame, code: str = "code", message: str = "message", engine: str = "engine") -> DataFrame:
    """network_failure, hard_block and public_message."""
    c, m = F.col(code), F.coalesce(F.col(message), F.lit(""))
    quiet = c.isin(*UNAVAILABLE, "LITE_EMPTY")
    neutral = F.concat(F.lit('Engine "'), F.coalesce(F.col(engine), F.lit("")), F.lit('" could not be reached from this network. No results were returned.'))
    shown = F.when(quiet, neutral).when(m != "", m).otherwise("Search failed")
    return df.withColumns({"network_failure": m.rlike(NETWORK), "hard_block": F.coalesce(c.isin(*HARD_BLOCKS), F.lit(False)), "public_message": shown})
