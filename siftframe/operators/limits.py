"""Sorts, page windows and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hosts
from .windows import ORDER, first_wins, top, with_ranks

#: Engines that serve a fixed number of results a page.
FIXED_PAGE = ("google", "google_lite", "chrome", "yahoo")
MOST, MOST_PAGES, STEP = 100, 10, 10


def top_results(results: DataFrame, num: int = 10, by=("query_id",), order=ORDER) -> DataFrame:
    """The first num rows (1 to 100) of each query."""
    return top(results, min(MOST, max(1, num)), by, order)


def host_order(by: str, host: str = "host") -> list:
    """What hosts are ordered by: ports or vulns, most first, or ip, lowest first and none last."""
    n = lambda f, kind: F.size(F.coalesce(F.col(f"{host}.{f}"), F.array().cast(kind))).desc()
    keys = {"ports": lambda: n("ports", "array<int>"), "vulns": lambda: n("vulns", "array<string>"), "ip": lambda: hosts.ip_number(F.col(f"{host}.ip_str")).asc_nulls_last()}
    return [keys[by]()]


def sort_hosts(df: DataFrame, by: str, host: str = "host", pos: str = "pos") -> DataFrame:
    """By the number of ports or vulns, most first, or by address, lowest first and none last; ties by position."""
    return df.orderBy(*host_order(by, host), pos)


def page_plan(df: DataFrame, engine: str = "engine", num: str = "num", page: str = "page") -> DataFrame:
    """step, pages and start of each request: fixed-size engines serve 10 a page, so num asks for up to 10 pages of
    them; the others serve num on one page."""
    n = F.least(F.lit(MOST), F.greatest(F.lit(1), F.col(num)))
    fixed = F.col(engine).isin(*FIXED_PAGE)
    pages = F.when(fixed, F.least(F.lit(MOST_PAGES), F.ceil(n / STEP).cast("int"))).otherwise(1)
    step = F.when(fixed, STEP).otherwise(n)
    return df.withColumns({"step": step, "pages": pages, "start": (F.greatest(F.col(page), F.lit(1)) - 1) * step})


def page_slice(results: DataFrame, requests: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The ranked results that a request's page window shows: ranks start + 1 to start + num."""
    plan = page_plan(requests).select(F.col(by).alias("_q"), "start", F.col("num").alias("_num"))
    rows = results.join(plan, results[by] == F.col("_q"))
    return rows.where(F.col(rank).between(F.col("start") + 1, F.col("start") + F.col("_num"))).select(*[results[c] for c in results.columns])


def top_up(results: DataFrame, num: int = 10, by=("query_id",), order=ORDER) -> DataFrame:
    """Results of all pages of a query as one list without repeated urls, num at most, ranked: a short first page is
    filled from the next ones."""
    return with_ranks(top_results(first_wins(results, "url", by, order), num, by, order), by, order)


def stop_at_stale_page(results: DataFrame, by=("query_id",), order=("page", "pos")) -> DataFrame:
    """Without the first page of a query that brings no new url, and everything after it."""
    by = list(by)
    first = first_wins(results.select(*by, "url", *order), "url", by, order).withColumn("_new", F.lit(1))
    pages = results.select(*by, "page").distinct().join(first.groupBy(*by, "page").agg(F.sum("_new").alias("_n")), [*by, "page"], "left")
    stale = pages.where(F.col("_n").isNull()).groupBy(*by).agg(F.min("page").alias("_stale"))
    rows = results.join(stale, by, "left")
    return rows.where(F.col("_stale").isNull() | (F.col("page") < F.col("_stale"))).select(*results.columns)


def cap_list(df: DataFrame, col: str, n: int) -> DataFrame:
    """The first n entries of an array; null stays null."""
    return df.withColumn(col, F.slice(F.col(col), 1, n))


def latest_per_key(df: DataFrame, key: str, order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
