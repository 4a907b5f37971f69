"""Counts and summaries of outcomes, results, crawls and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import failure_streak

BLOCKED, EMPTY = ("BLOCKED", "SORRY"), ("EMPTY_RESULTS", "LITE_EMPTY")
#: Kinds of runs that are counted apart from searches.
RUNS = ("batch", "crawl")


def _counts():
    ok, source = F.col("ok"), F.col("source")
    return [
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"),
        F.count_if(source == "lite").alias("lite"), F.count_if(source == "render").alias("render"),
    ]


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row: searches, ok, fail, lite and render counts of searches. Where there is a column `kind`, rows of the kinds
    batch and crawl are runs of those, which are counted apart and are no searches; null is a search."""
    if "kind" not in outcomes.columns:
        return outcomes.agg(F.count("*").alias("search"), *_counts())
    runs = F.coalesce(F.col("kind").isin(*RUNS), F.lit(False))
    searches = outcomes.withColumns({"ok": F.when(~runs, F.col("ok")), "source": F.when(~runs, F.col("source"))})
    return searches.agg(F.count_if(~runs).alias("search"), *_counts(), *[F.count_if(F.col("kind") == k).alias(k) for k in RUNS])


def outcomes_by_key(outcomes: DataFrame, key: str = "key") -> DataFrame:
    """ok, fail, lite and render counts of each key; comma lists of keys count for each of theirs."""
    rows = outcomes.withColumn(key, F.explode(F.split(F.col(key), ","))).where(F.trim(key) != "")
    return rows.groupBy(key).agg(*_counts())


def latency_percentiles(outcomes: DataFrame, last: int = 500, order=("ts", "event_id")) -> DataFrame:
    """n, p50, p95 (nearest rank) and max of the last finite durations that are not negative, rounded; zeros if none.
    The newest rows are picked by a top-k that keeps `last` rows a task."""
    ms = F.col("duration_ms")
    good = outcomes.where(ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms < float("inf")))
    newest = good.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)")
    whole = lambda c: F.coalesce(F.floor(c + 0.5), F.lit(0)).cast("long")
    return newest.agg(F.count("*").alias("n"), whole(p(0.5)).alias("p50"), whole(p(0.95)).alias("p95"), whole(F.max("duration_ms")).alias("max"))


def breaker_counters(outcomes: DataFrame, key: str = "key", *, per_host: bool = False, order=("ts", "event_id")) -> DataFrame:
    """ok, blocked, empty, error and the last code of each key. Per host, SOFT_BLOCK counts as empty and LITE_EMPTY as an
    error, and uses are counted too."""
    empty = ("EMPTY_RESULTS", "SOFT_BLOCK") if per_host else EMPTY
    code = F.coalesce("code", F.lit(""))
    cols = [
        F.count_if(code == "OK").alias("ok"), F.count_if(code.isin(*BLOCKED)).alias("blocked"), F.count_if(code.isin(*empty)).alias("empty"),
        F.count_if(~code.isin("OK", *BLOCKED, *empty)).alias("error"), F.max_by("code", F.struct(*order)).alias("last_code"),
    ]
    return outcomes.groupBy(key).agg(*cols, *([F.count("*").alias("uses")] if per_host else []))


def breaker_state(outcomes: DataFrame, now: Column, fails: int = 3, open_ms: int = 120_000, key: str = "key", order=("ts", "event_id")) -> DataFrame:
    """(key, consecutive_fail, open, skip_remaining_ms) of each key at a time `now`, from the rows that are not younger:
    failures since the last success, whether the key takes no traffic, and for how many milliseconds yet. Each failure
    that makes or extends a streak of `fails` keeps it away for open_ms. Streaks are handed on from day to day (see
    windows.failure_streak), so no key's history is in one task. Of newest rows that are equal in order, as copies are, the
    last one counted tells the streak."""
    fails, open_ms = max(2, fails), max(5_000, open_ms)
    known = outcomes.where(F.col(order[0]) <= now)
    last = failure_streak(known, key, order).groupBy(key).agg(F.max_by("streak", F.struct(*order, "streak")).alias("consecutive_fail"), F.max(order[0]).alias("_last"), F.max(now).alias("_now"))
    ms = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000)
    left = F.when(F.col("consecutive_fail") >= fails, F.greatest(ms("_last") + open_ms - ms("_now"), F.lit(0))).otherwise(0).cast("long")
    return last.select(key, "consecutive_fail", (left > 0).alias("open"), left.alias("skip_remaining_ms"))


def merge_summary(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per query: engines tried and ok, the number of results, the longest duration, and the sources joined by +."""
    tried = outcomes.groupBy("query_id").agg(
        F.count_distinct("engine").alias("engines_tried"), F.count_distinct(F.when(F.col("ok"), F.col("engine"))).alias("engines_ok"),
        F.max("duration_ms").alias("duration_ms"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )
    n = results.groupBy("query_id").agg(F.count("*").alias("count"))
    return tried.join(n, "query_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def batch_summary(outcomes: DataFrame, batch: str = "batch_id", ts: str = "ts") -> DataFrame:
    """Per batch: its size, the queries that completed, and the milliseconds from the first start (ts) to the last end
    (ts plus duration_ms). Queries run side by side, so their durations do not add up; null durations count as 0."""
    start = F.unix_micros(F.col(ts).cast("timestamp"))
    end = start + F.floor(F.coalesce("duration_ms", F.lit(0.0)) * 1000).cast("long")
    elapsed = ((F.max(end) - F.min(start)) / 1000.0).alias("duration_ms")
    return outcomes.groupBy(batch).agg(F.count("*").alias("batch_size"), F.count_if("ok").alias("completed"), elapsed)


def crawl_summary(crawl: DataFrame, reachable: DataFrame, max_pages: int) -> DataFrame:
    """Per start: pages crawled, and queued, which is 1 if more than max_pages pages could be reached, else 0. reachable
    is the same crawl with room for one page more."""
    more = reachable.groupBy("start_url").agg(F.count("*").alias("_n"))
    done = crawl.groupBy("start_url").agg(F.count("*").alias("crawled"))
    return done.join(more, "start_url").select("start_url", "crawled", F.when(F.col("_n") > max_pages, 1).otherwise(0).alias("queued"))


def host_lookup_summary(df: DataFrame) -> DataFrame:
    """One row: the addresses that were asked for, and those that the scan knows."""
    return df.agg(F.count("*").alias("count"), F.count_if("found").alias("found"))


def reuse_rate(hits: DataFrame, misses: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: hits, misses and the number of stored answers."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(hits, "hits").join(n(misses, "misses"), F.lit(True)).join(n(stored, "size"), F.lit(True))


def running_outcomes(outcomes: DataFrame, key: str = "key", order=("ts", "event_id")) -> DataFrame:
    """outcomes with the ok and fail counts of their key so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return outcomes.withColumns({"ok_so_far": F.count_if("ok").over(w), "fail_so_far": F.count_if(~F.col("ok")).over(w)})
