"""Writers of result envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import with_position


def envelopes(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a query: query_id, engine, success, code, count, duration_ms and its results in rank order.

    outcomes (query_id, engine, ok, code, duration_ms) says which queries there are; those without results have an
    empty list. A query's results are at most a request's num, so the list is small."""
    cols = [c for c in ("rank", "title", "url", "snippet", "displayed_link", "date") if c in results.columns]
    lists = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("results"))
    rows = outcomes.join(lists, "query_id", "left")
    kind = lists.schema["results"].dataType.simpleString()
    rows = rows.withColumn("results", F.coalesce("results", F.array().cast(kind)))
    return rows.select("query_id", "engine", F.col("ok").alias("success"), "code", F.size("results").alias("count"), "duration_ms", "results")


def write_envelopes(results: DataFrame, outcomes: DataFrame, path: str, *, run_date: str, fmt: str = "json") -> None:
    """Append envelopes to the folder of their run date."""
    envelopes(results, outcomes).withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").format(fmt).save(path)


def organic(results: DataFrame, queries: DataFrame, order=("engine_pos", "page", "pos")) -> DataFrame:
    """One compact row a query: its parameters, organic [{title, link, snippet, position}] and credits."""
    rows = with_position(results, ("query_id",), order)
    item = F.struct("position", "title", F.col("url").alias("link"), "snippet")
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("organic"))
    params = F.struct(*[c for c in queries.columns if c != "query_id"]).alias("searchParameters")
    out = queries.select("query_id", params).join(lists, "query_id", "left")
    kind = lists.schema["organic"].dataType.simpleString()
    return out.withColumn("organic", F.coalesce("organic", F.array().cast(kind))).withColumn("credits", F.lit(1))


def write_organic(results: DataFrame, queries: DataFrame, path: str) -> None:
    """Append compact rows as JSON lines."""
    organic(results, queries).write.mode("append").json(path)
