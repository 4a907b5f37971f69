"""Bounded breadth-first traversal of a link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from .windows import top

MAX_PAGES, MAX_DEPTH = 20, 3
#: Links, and urls of lists, that a task sorts or groups. Spark deals by compressed bytes, of which urls take ten times the memory and more.
LINKS_A_TASK, URLS_A_TASK = 250_000, 500_000
#: Tasks that a hub's links, or the copies of a link, are dealt to.
PARTS = 64


def _tasks(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def link_lists(links: DataFrame, most: int) -> DataFrame:
    """(src_url, dsts): the first `most` distinct links of each page, in order, as one row, written once. They are cut
    before they are listed, so a hub's row is as short as any other's. The links are written first: their number says
    how many tasks they need."""
    links = written(links.where("src_url is not null and dst_url is not null").select("src_url", "pos", "dst_url"), "crawl-table")
    tasks = _tasks(links.count(), LINKS_A_TASK)
    part = F.pmod(F.xxhash64("dst_url", "pos", F.spark_partition_id()), F.lit(PARTS))
    parted = links.withColumn("part", part).repartition(tasks, "src_url", "part").groupBy("src_url", "part", "dst_url").agg(F.min("pos").alias("pos"))
    # What is among the first of its page is so among any of its links. Links without a position come first in the end: none is cut here.
    at = F.row_number().over(Window.partitionBy("src_url", "part").orderBy(F.asc_nulls_last("pos"), "dst_url"))
    parted = parted.withColumn("at", at).where((F.col("at") <= most) | F.col("pos").isNull()).select("src_url", "dst_url", "pos")
    first = parted.repartition(tasks, "src_url").groupBy("src_url", "dst_url").agg(F.min("pos").alias("pos"))
    cut = top(first, most, ("src_url",), ("pos", "dst_url"))
    listed = cut.groupBy("src_url").agg(F.array_sort(F.collect_list(F.struct("pos", "dst_url"))).alias("l"))
    return written(listed.select("src_url", F.transform("l", lambda x: x["dst_url"]).alias("dsts")), "crawl-links")


def _most_starts(rows: DataFrame, n_rows: int) -> int:
    """No fewer than the starts that a page is new to. A page that is new to very many is left to Spark's join of skewed
    sides, which joins it in parts; the others are dealt by number."""
    part = F.pmod(F.xxhash64("start_url"), F.lit(PARTS)).alias("part")
    counts = rows.select("url", part).repartition(_tasks(n_rows, LINKS_A_TASK), "url", "part").groupBy("url", "part").count()
    return PARTS * (counts.agg(F.max("count")).first()[0] or 0)


def crawl_frontier(
    links: DataFrame, starts: DataFrame | None = None, max_pages: int = 8, max_depth: int = 1, *, cap_pages: int = MAX_PAGES
) -> DataFrame:
    """(start_url, url, depth, visit_order): for each start, the first max_pages pages (20 at most) in breadth-first
    order, no deeper than max_depth links (3 at most; 0 is the start alone). Without starts, every page that has links
    is one.

    links has src_url, pos and dst_url. A page is visited once, from the first page in order that links to it; its
    order is that of its parent, then the link's position. All starts advance together. A start is one row: the pages
    that it has visited, in order, and how many there were after each level. The first level is a join of the starts
    with their lists of links. A further one is a join of the newest pages with their lists and one fold by start, which
    puts the lists in the order of their parents and appends what is new; a row holds max_pages urls at most, and its
    lists max_pages times as many. Starts that have their max_pages, or found nothing new, are done and take no part.

    A page needs no more than its first max_pages distinct links: at most that many pages are visited, so those that
    were seen before leave enough."""
    max_pages, max_depth = min(cap_pages, max(1, max_pages)), min(MAX_DEPTH, max(0, max_depth))
    none = F.array().cast("array<string>")
    appended = lambda seen, more: F.slice(F.array_distinct(F.concat(seen, more)), 1, max_pages)
    known = starts if starts is not None else links.where("src_url is not null and dst_url is not null").select(F.col("src_url").alias("start_url"))
    if not max_depth:
        return known.select("start_url").distinct().select("start_url", F.col("start_url").alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("visit_order"))

    lists = link_lists(links, max_pages)
    n_lists = lists.count()
    if starts is None:
        state = lists.withColumnRenamed("src_url", "start_url")
    else:
        dealt = known.select("start_url").distinct().repartition(_tasks(n_lists * max_pages, URLS_A_TASK), "start_url")
        state = dealt.join(lists, F.col("start_url") == F.col("src_url"), "left")
    state = state.select("start_url", appended(F.array("start_url"), F.coalesce("dsts", none)).alias("seen"))
    state = state.select("start_url", "seen", F.array(F.lit(1), F.size("seen")).alias("ends"))

    done = []
    before = F.element_at("ends", -2)
    n_newest = F.size("seen") - before
    is_open = (n_newest > 0) & (F.size("seen") < max_pages)
    for _ in range(1, max_depth):
        state = written(state, "crawl-level")
        done.append(state.where(~is_open))
        state = state.where(is_open)
        urls = state.agg(F.sum(n_newest)).first()[0]
        if not urls:
            break
        rows = state.select("start_url", "seen", "ends", F.posexplode(F.slice("seen", before + 1, n_newest)).alias("at", "url"))
        # What a start has seen travels with the first of its rows only.
        rows = rows.select("start_url", "at", "url", F.when(F.col("at") == 0, F.struct("seen", "ends")).alias("state"))
        page = lists
        if _most_starts(rows, urls) * max_pages <= URLS_A_TASK:
            tasks = _tasks((n_lists + urls) * max_pages, URLS_A_TASK)
            rows, page = rows.repartition(tasks, "url"), lists.repartition(tasks, "src_url")
        met = rows.join(page, F.col("url") == F.col("src_url"), "left").select("start_url", "at", "state", F.coalesce("dsts", none).alias("dsts"))
        met = met.repartition(_tasks(urls * max_pages, URLS_A_TASK), "start_url")
        found = met.groupBy("start_url").agg(F.max("state").alias("state"), F.array_sort(F.collect_list(F.struct("at", "dsts"))).alias("found"))
        every = appended(F.col("state.seen"), F.flatten(F.transform("found", lambda x: x["dsts"])))
        state = found.select("start_url", every.alias("seen"), F.col("state.ends").alias("ends"))
        state = state.withColumn("ends", F.concat("ends", F.array(F.size("seen"))))
    state = reduce(DataFrame.unionByName, done, state)
    out = state.select("start_url", "ends", F.posexplode("seen").alias("at", "url"))
    depth = F.size(F.filter("ends", lambda e: e <= F.col("at")))
    return out.select("start_url", "url", depth.alias("depth"), (F.col("at") + 1).alias("visit_order"))
