"""First-wins deduplication, ranks and running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

ORDER = ("engine_pos", "page", "pos")


def with_ranks(df: DataFrame, by="query_id", order=ORDER, out: str = "rank") -> DataFrame:
    """1..n without gaps in each query."""
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_wins(df: DataFrame, key="url", by=("query_id",), order=ORDER) -> DataFrame:
    """The first row of each key in each query. An aggregate that combines before the shuffle, so that a key with many
    rows costs one row a task; ties in the order go to the row that is smaller as a whole."""
    key = F.col(key) if isinstance(key, str) else key
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], key.alias("_key"), F.struct(*[F.col(o) for o in order]).alias("_ord"), whole.alias("_row"))
    rows = rows.where(F.col("_key").isNotNull())
    return rows.groupBy(*[c for c in rows.columns if c.startswith("_by")], "_key").agg(F.min(F.struct("_ord", "_row"))["_row"].alias("_row")).select("_row.*")


def dedupe_canonical(df: DataFrame, cap: int | None = None, by=("query_id",), order=ORDER) -> DataFrame:
    """The first row of each canonical url; rows without one go; at most `cap` a query."""
    key = urls.canonical(F.col("url"))
    kept = first_wins(df.where(key != ""), key, by, order)
    return kept if cap is None else top(kept, cap, by, order)


def top(df: DataFrame, n, by=("query_id",), order=ORDER) -> DataFrame:
    """The first n rows of each query; Spark prunes them before the shuffle. n may be a number or a column."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def keep_organic(cards: DataFrame, least: int = 5, by=("page_id",), order=("pos",)) -> DataFrame:
    """A page with `least` cards that have a snippet or a displayed link keeps only those; ranks follow."""
    organic = (F.coalesce("snippet", F.lit("")) != "") | (F.coalesce("displayed_link", F.lit("")) != "")
    n = F.count_if(organic).over(Window.partitionBy(*by))
    kept = cards.withColumn("_organic", organic).withColumn("_n", n).where((F.col("_n") < least) | F.col("_organic"))
    return with_ranks(kept.drop("_organic", "_n"), by, order)


#: Seconds of a key's history that are ordered in one task.
BUCKET_S = 86_400


def _streaks(outcomes: DataFrame, key: str, order, bucket_s: int = BUCKET_S) -> DataFrame:
    """_run counts the successes so far, so the failures after a success share its number; streak counts them.

    Time is cut into buckets, and rows are ordered within a key's bucket only. One row a bucket (its successes, its
    failures, those after its last success) then gives what it hands on to the next: the sum since the last bucket with
    a success. So a key's whole history is never in one task, only its bucket summaries are."""
    rows = outcomes.withColumn("_b", F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (1_000_000 * bucket_s)))
    inside = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_oks", F.count_if("ok").over(inside))
    since = Window.partitionBy(key, "_b", "_oks").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_fails", F.count_if(~F.col("ok")).over(since))

    sums = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count_if("ok").alias("_ok"), F.max_by("_fails", F.struct(*order, "_oks", "_fails")).alias("_tail"))
    by_key = Window.partitionBy("_k").orderBy("_kb")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_seg", F.count_if(F.col("_ok") > 0).over(so_far)).withColumn("_oks_before", F.sum("_ok").over(so_far) - F.col("_ok"))
    in_seg = Window.partitionBy("_k", "_seg").orderBy("_kb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_handed", F.sum("_tail").over(in_seg))
    sums = sums.select("_k", "_kb", "_oks_before", F.coalesce(F.lag("_handed").over(by_key), F.lit(0)).alias("_carry"))

    rows = rows.join(sums, rows[key].eqNullSafe(sums["_k"]) & rows["_b"].eqNullSafe(sums["_kb"]))
    streak = F.col("_fails") + F.when(F.col("_oks") == 0, F.col("_carry")).otherwise(0)
    return rows.withColumns({"_run": F.col("_oks") + F.col("_oks_before"), "streak": streak}).drop("_k", "_kb", "_oks", "_fails", "_oks_before", "_carry")


def failure_streak(outcomes: DataFrame, key: str = "key", order=("ts", "event_id")) -> DataFrame:
    """outcomes with `streak`: failures of the key since its last success, this row included."""
    return _streaks(outcomes, key, order).drop("_run", "_b")


def breaker_intervals(outcomes: DataFrame, fails: int = 3, open_ms: int = 120_000, key: str = "key", order=("ts", "event_id")) -> DataFrame:
    """(key, open_from, open_until): when a key takes no traffic. It opens with the failure that makes the streak
    `fails`; each further failure of the streak moves the end to its own time plus open_ms; a success ends it at once.

    Failures are joined to intervals within a key's time bucket first, and the few intervals of all buckets then with
    each other. Engines use 3 failures and two minutes; HOST_PRESET has those of hosts."""
    fails, open_ms = max(2, fails), max(5_000, open_ms)
    rows = _streaks(outcomes, key, order)
    bad = rows.where((~F.col("ok")) & (F.col("streak") >= fails))
    ends = rows.where("ok").select(F.col(key).alias("_k"), (F.col("_run") - 1).alias("_r"), F.col("ts").alias("_ok_ts"))
    until = F.col("ts") + F.make_dt_interval(secs=F.lit(open_ms / 1000))
    spans = bad.select(key, "_run", "_b", F.col("ts").alias("open_from"), until.alias("_last"))
    for by in ([key, "_run", "_b"], [key, "_run"]):
        w = Window.partitionBy(*by).orderBy("open_from", "_last")
        # A failure after the interval has run out opens a new one.
        before = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(before.isNull() | (F.col("open_from") > before), 1).otherwise(0)
        numbered = spans.withColumn("_new", new).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        spans = numbered.groupBy(*by, "_n").agg(F.min("open_from").alias("open_from"), F.max("_last").alias("_last"))
    closed = spans.join(ends, (spans[key] == ends["_k"]) & (spans["_run"] == ends["_r"]), "left")
    return closed.select(key, "open_from", F.least("_last", F.greatest(F.coalesce("_ok_ts", "_last"), "open_from")).alias("open_until"))


#: The breaker of hosts: failures and how long it stays open.
HOST_PRESET = {"fails": 2, "open_ms": 180_000}


def last_n(df: DataFrame, n: int, by=("key",), order=("ts",)) -> DataFrame:
    """The last n rows of each key."""
    desc: list[Column] = [F.col(o).desc() for o in order]
    return top(df, n, by, desc)


def with_position(results: DataFrame, by=("query_id",), order=ORDER) -> DataFrame:
    """Rows with url and title, one a url, trimmed, with position 1..n."""
    full = results.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    kept = first_wins(full, "url", by, order)
    kept = kept.withColumn("title", F.trim("title")).withColumn("snippet", F.trim(F.coalesce("snippet", F.lit(""))))
    return with_ranks(kept, by, order, "position")
