"""Merging engines, falling back, sharding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .windows import ORDER, dedupe_canonical, first_wins, top, with_ranks

#: Engines that are tried after the requested ones.
CHAIN = ("duckduckgo", "bing")


def merge_engines(results: DataFrame | list[DataFrame], num: int, *, canonical: bool = False, by=("query_id",), order=ORDER) -> DataFrame:
    """All engines of a query in listed order, one row a url, num at most; then, if asked, one a canonical url, so fewer
    may remain. engine_rank is the rank within the engine before the merge, rank runs over the merged list."""
    if isinstance(results, list):
        results = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    by = list(by)
    ranked = with_ranks(results, [*by, "engine"], order, "engine_rank")
    kept = top(first_wins(ranked, "url", by, order), num, by, order)
    return with_ranks(dedupe_canonical(kept, None, by, order) if canonical else kept, by, order)


def first_nonempty_engine(results: DataFrame, tried: DataFrame, by: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(results of the first engine of each query that has any, outcomes of the engines tried). tried has by, engine and
    engine_pos; engines before the winner have the code EMPTY_RESULTS, those after it were never asked."""
    winner = results.groupBy(by).agg(F.min("engine_pos").alias("_win"))
    rows = results.join(winner, by).where(F.col("engine_pos") == F.col("_win")).drop("_win")
    asked = tried.join(winner, by, "left").where(F.col("_win").isNull() | (F.col("engine_pos") <= F.col("_win")))
    ok = F.coalesce(F.col("engine_pos") == F.col("_win"), F.lit(False))
    return rows, asked.select(by, "engine", "engine_pos", F.when(ok, "OK").otherwise("EMPTY_RESULTS").alias("code"), ok.alias("ok"))


def fallback_order(queries: DataFrame, requested: str = "engine_list", off: str | None = None, chain=CHAIN, out: str = "try_list") -> DataFrame:
    """The requested engines and then the chain, each once, in order; only the requested ones where `off` is true."""
    full = F.array_distinct(F.concat(F.col(requested), F.array(*[F.lit(c) for c in chain])))
    return queries.withColumn(out, full if off is None else F.when(F.coalesce(F.col(off), F.lit(False)), F.col(requested)).otherwise(full))


def shard_rows(df: DataFrame, index: int, total: int, position: str = "position") -> DataFrame:
    """Every total-th row by position, from index on; the shards of all indices cover the table once."""
    if not 0 <= index < total:
        raise ValueError("index must be from 0 to total - 1")
    return df.where(F.pmod(F.col(position), F.lit(total)) == index)


def one_per_host(df: DataFrame, url: str = "url", order=("position",)) -> DataFrame:
    """The first row of each host; rows without a host go."""
    h = urls.host(F.col(url))
    return first_wins(df.where(h != ""), h, (), order)


def engine_of_first(results: DataFrame, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by)
    return results.withColumn("_w", F.min("engine_pos").over(w)).where(F.col("engine_pos") == F.col("_w")).drop("_w")
