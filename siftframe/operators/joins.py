"""Joins: host suffixes, enrichment, engine capability, stored answers, engine status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hosts, query_ops, urls
from ..sources.readers import broadcast_if_small


# Domains by category; a host belongs to a domain if it is the domain or below it.
DOMAINS = {
    "social": [
        "facebook.com", "fb.com", "fb.watch", "instagram.com", "instagr.am", "twitter.com", "x.com", "linkedin.com", "reddit.com",
        "tiktok.com", "pinterest.com", "youtube.com", "youtu.be", "tumblr.com", "quora.com", "medium.com", "threads.net", "snapchat.com",
        "discord.com", "discord.gg", "telegram.org", "t.me", "vk.com", "weibo.com", "douyin.com", "line.me", "whatsapp.com",
    ],
    "dev": [
        "github.com", "github.io", "githubusercontent.com", "gitlab.com", "gitlab.io", "bitbucket.org", "bitbucket.io", "stackoverflow.com",
        "stackexchange.com", "superuser.com", "serverfault.com", "npmjs.com", "pypi.org", "packagist.org", "rubygems.org", "crates.io",
        "nuget.org", "dev.to", "hashnode.com", "mdn.mozilla.org", "w3schools.com", "geeksforgeeks.org", "tutorialspoint.com",
        "javatpoint.com", "baeldung.com", "freecodecamp.org", "codecademy.com", "leetcode.com", "hackerrank.com", "sourceforge.net",
        "readthedocs.io", "gitbook.io", "devdocs.io", "docs.rs", "pkg.go.dev", "godoc.org", "rubydoc.info", "cppreference.com",
        "learn.microsoft.com", "pastebin.com", "gist.github.com", "codesandbox.io", "jsfiddle.net", "codepen.io",
    ],
    "ugc": [
        "scribd.com", "slideshare.net", "issuu.com", "academia.edu", "researchgate.net", "fandom.com", "wikipedia.org", "wikihow.com",
        "about.me", "linktr.ee", "hubpages.com", "vocal.media", "answers.com", "ask.com", "ehow.com", "genius.com", "pdfcoffee.com",
        "studocu.com", "coursehero.com", "chegg.com", "brainly.com", "quizlet.com", "docsity.com", "goodreads.com", "wattpad.com",
        "archiveofourown.org", "fanfiction.net",
    ],
    "blog": [
        "blogspot.com", "blogger.com", "wordpress.com", "substack.com", "ghost.io", "tumblr.com", "livejournal.com", "typepad.com",
        "weebly.com", "wixsite.com", "medium.com", "hatenablog.com", "over-blog.com", "jimdo.com",
    ],
    "forum": [
        "discourse.org", "phpbb.com", "vbulletin.com", "xenforo.com", "groups.google.com", "4chan.org", "4channel.org", "lemmy.world",
        "kbin.social", "discourse.group",
    ],
}


def domain_category(df: DataFrame) -> DataFrame:
    """The built-in (domain, category) table; a fixed list, so it may be broadcast."""
    rows = [(d, c) for c, ds in DOMAINS.items() for d in ds]
    return df.sparkSession.createDataFrame(rows, "domain string, category string")


def host_categories(df: DataFrame, url: str, out: str, categories: DataFrame | None = None) -> DataFrame:
    """df with the array of categories that a row's host belongs to.

    Whether a host is below a domain is a suffix question. Each host has as many suffixes as labels, so they are looked
    up in one small map of the fixed domain list; a table given by the caller is joined on exploded suffixes instead."""
    if categories is None:
        lookup = {}
        for c, ds in DOMAINS.items():
            for d in ds:
                lookup.setdefault(d, []).append(c)
        known = F.create_map(*[x for d, cs in lookup.items() for x in (F.lit(d), F.array(*[F.lit(c) for c in cs]))])
        found = F.transform(urls.suffixes(urls.host(F.col(url))), lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast("array<string>")))
        return df.withColumn(out, F.array_distinct(F.flatten(found)))
    hosts_ = df.select(urls.host(F.col(url)).alias("_h")).distinct()
    named = hosts_.withColumn("_s", F.explode(urls.suffixes(F.col("_h")))).join(broadcast_if_small(categories), F.col("_s") == F.col("domain"))
    named = named.groupBy("_h").agg(F.collect_set("category").alias(out))
    rows = df.join(named, urls.host(F.col(url)) == F.col("_h"), "left").drop("_h")
    return rows.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def match_domains(df: DataFrame, rules: DataFrame, *, url: str = "url", target: str = "target", how: str = "left_semi") -> DataFrame:
    """Rows whose host is one of the targets or below it (left_semi), or is not (left_anti). ".com" is a suffix rule.
    An equi-join on exploded suffixes of the distinct hosts, never a comparison of all pairs."""
    t = rules.select(F.regexp_replace(F.regexp_replace(F.lower(target), r"^www\.", ""), r"^\.", "").alias("_t")).where("_t <> ''").distinct()
    hosts_ = df.select(urls.bare_host(F.col(url)).alias("_h")).where("_h <> ''").distinct()
    hit = hosts_.withColumn("_s", F.explode(urls.suffixes(F.col("_h")))).join(t, F.col("_s") == F.col("_t")).select("_h").distinct()
    return df.join(hit, urls.bare_host(F.col(url)) == F.col("_h"), how)


def _ints(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<int>"))


def _strings(c) -> Column:
    return F.filter(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def enrich_hosts(df: DataFrame, scan: DataFrame, host: str = "host") -> DataFrame:
    """Host structs joined with a scan by address. Ports and names become ordered distinct unions (names without
    addresses), a missing port is the first of them; cpes, tags and vulns are replaced; the first CPE that can be read
    sets vendor, product and version where it has them. Hosts that were not scanned stay as they are."""
    one = scan.where("ip is not null").groupBy(F.col("ip").alias("_ip")).agg(F.min(F.struct(*[c for c in scan.columns if c != "ip"])).alias("_scan"))
    rows = df.join(one, F.col(f"{host}.ip_str") == F.col("_ip"), "left")
    h = lambda f: F.col(f"{host}.{f}")
    s = lambda f: F.col(f"_scan.{f}")
    ports = F.array_distinct(F.concat(_ints(h("ports")), _ints(s("ports"))))
    names = F.array_distinct(F.concat(_strings(h("hostnames")), F.filter(_strings(s("hostnames")), lambda x: ~hosts.is_ip(x))))
    first = F.get(F.filter(F.transform(_strings(s("cpes")), hosts.cpe), lambda x: x.isNotNull()), 0)
    new = {
        "ip_str": F.when(hosts.is_ip(F.col("_ip")), F.col("_ip")).otherwise(h("ip_str")),
        "port": F.coalesce(h("port"), F.get(ports, 0)), "ports": ports, "hostnames": names, "domains": names,
        "cpes": _strings(s("cpes")), "tags": _strings(s("tags")), "vulns": _strings(s("vulns")),
    } | {f: F.coalesce(first[f], h(f)) for f in ("vendor", "product", "version")}
    fields = df.schema[host].dataType.fieldNames()
    merged = F.struct(*[new.get(f, h(f)).alias(f) for f in fields])
    return rows.withColumn(host, F.when(F.col("_scan").isNotNull(), merged).otherwise(F.col(host))).drop("_ip", "_scan")


def capability(df: DataFrame) -> DataFrame:
    """The built-in (engine, operator) table, a fixed list. Engines without any operator have a row with null."""
    rows = [(e, o) for e, ops in query_ops.CAPABILITY.items() for o in (ops or [None])]
    return df.sparkSession.createDataFrame(rows, "engine string, operator string")


def engine_support(queries: DataFrame, capabilities: DataFrame | None = None) -> DataFrame:
    """(query_id, engine, supported, unsupported): the operators that a query uses, by whether its engine takes them.
    queries has query_id, engine and operators; an engine that is not listed takes site and filetype."""
    table = capabilities if capabilities is not None else capability(queries)
    takes = broadcast_if_small(table.groupBy(F.col("engine").alias("_e")).agg(F.collect_list("operator").alias("_takes")))
    default = F.array(*[F.lit(x) for x in query_ops.DEFAULT_CAPABILITY])
    rows = queries.join(takes, F.col("engine") == F.col("_e"), "left").withColumn("_takes", F.coalesce("_takes", default))
    used = F.map_keys("operators")
    taken = lambda o: F.array_contains("_takes", o)
    sides = [F.filter(used, taken).alias("supported"), F.filter(used, lambda o: ~taken(o)).alias("unsupported")]
    return rows.select("query_id", "engine", *sides)


def request_key(cols: list[str]) -> Column:
    """A digest of all options that change a result."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def split_cached(requests: DataFrame, stored: DataFrame, ttl_s: int = 300, *, key: str = "key", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(hits, misses). A request is answered by the newest stored row of its key that is not newer than the request
    and at most ttl_s seconds older. stored has the key, stored_ts and what goes with it; only successful, non-empty
    answers belong there. Requests without a key are misses.

    Time is cut into buckets of ttl_s. The answer lies in the request's own bucket, where a running last value finds
    it, or else it is the newest of the bucket before. So a key costs a sort of its rows, bucket by bucket, and not a
    comparison of all its requests with all its answers."""
    extra = [c for c in stored.columns if c != key]
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    r = requests.select(F.col(key).alias("_k"), seconds(ts).alias("_t"), F.lit(1).alias("_asks"), F.struct(*requests.columns).alias("_row"))
    s = stored.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), seconds("stored_ts").alias("_t"), F.lit(0).alias("_asks"), F.struct(*extra).alias("_found"))
    bucket = F.floor(F.col("_t") / ttl_s)
    both = r.unionByName(s, allowMissingColumns=True).withColumn("_b", bucket)
    so_far = Window.partitionBy("_k", "_b").orderBy("_t", "_asks", "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = both.withColumn("_near", F.last("_found", ignorenulls=True).over(so_far)).where("_asks = 1").drop("_found")
    newest = s.groupBy(F.col("_k").alias("_k2"), (bucket + 1).alias("_b2")).agg(F.max(F.struct("_t", "_found")).alias("_last"))
    asked = asked.join(newest, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")), "left")
    young = F.when(F.col("_t") - F.col("_last._t") <= ttl_s, F.col("_last._found"))
    rows = asked.withColumn("_hit", F.when(F.col("_k").isNotNull(), F.coalesce("_near", young)))
    return rows.where("_hit is not null").select("_row.*", "_hit.*"), rows.where("_hit is null").select("_row.*")


def attach_enrichment(results: DataFrame, suggestions: DataFrame, news: DataFrame, limit: int = 10) -> DataFrame:
    """results (one row a query) with the first `limit` suggestions and news; empty arrays are null."""
    for side in (suggestions, news):
        name = next(c for c in side.columns if c != "query_id")
        results = results.join(side.select("query_id", F.when(F.size(name) > 0, F.slice(name, 1, limit)).alias(name)), "query_id", "left")
    return results


def engine_status(registry: DataFrame, breaker: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Every registered engine with its counters, zeros where none were recorded, and, with the state of its breaker
    (see aggregates.breaker_state), whether it is open, its failures in a row and how long it is skipped yet."""
    sides = [breaker] if state is None else [breaker, state]
    rows = registry
    for side in sides:
        rows = rows.join(side.withColumnRenamed("key", "engine"), "engine", "left")
    counted = [F.coalesce(c, F.lit(False if c == "open" else 0)).alias(c) for side in sides for c in side.columns if c not in ("key", "last_code")]
    return rows.select(*registry.columns, *counted, *[c for c in breaker.columns if c == "last_code"])
