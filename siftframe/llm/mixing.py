"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, fresh, global_rank, materialize, text_or_empty

#: Weights of the sources in order, repeating; a target stops at so many times its source's size.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 100_000


def source_key(source: Column) -> Column:
    """A string that sorts as the source does by code point, null last, and is never null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def size_of(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def source_targets(sized: DataFrame, *, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, size) rows to one row a source: key, source_size, weight, target.

    Sources share the sum of all sizes by weight. Those whose share is over `most` times their size get that much, and
    what is left is shared by weight among the others, until none is above. Each turn is one small aggregate over the
    sources; the driver sees one row of sums a turn."""
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, "key", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.select("key", "source_size", weight.cast("long").alias("weight")), "sources")
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(capped).alias("n"),
        ).first()
        left, shared = everything - (row.fixed or 0), row.weights or 0
        wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products of sums of many sources do not fit in a long
        over = wide(F.col("weight")) * wide(F.lit(left)) > wide(F.col("source_size")) * wide(F.lit(most * shared))
        now = capped | over if shared else F.lit(True)
        if not shared or sources.agg(F.count_if(now)).first()[0] == row.n:
            break
        capped = now
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(shared).cast("double") if shared else F.lit(0.0)
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share)
    return sources.select("key", "source_size", "weight", target.alias("target"))


def measured(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """df with size, its number of words, and draw, a number in [0, 1) from the MD5 of the seed and the row's id (of its
    text where the id is null); columns of these names are replaced. What follows reads no text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(text_or_empty(F.col(text_col))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return df.withColumns({"size": size_of(F.col(text_col)), "draw": draw})


def copies_of(rows: DataFrame, *, source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """rows, as measured gives them, with source_size, target, rate and copies; rows are read twice."""
    rows = rows.drop("source_size", "target", "rate", "copies")
    key, of = fresh(rows, "_mix_key"), fresh(rows, "_mix_of")
    rows = rows.withColumn(key, source_key(F.col(source_col)))
    targets = source_targets(rows.select(F.col(key).alias("key"), "size"), weights=weights, most=most)
    targets = targets.select(F.col("key").alias(of), "source_size", "target")
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(targets) if few else targets, F.col(key) == F.col(of), "left").drop(key, of)
    rows = rows.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return rows.withColumn("copies", F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0))


def mix_counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """df with size, draw, source_size, target, rate and copies (columns of these names are replaced): how often the mix
    takes each row.

    A source's rate is target / source_size; each row is taken floor(rate) times, and once more where its draw is under
    the fraction. So reruns agree, rows decide by themselves, repeated rows with one id decide alike, and the words that
    a source gives come near its target as it has more rows. Null and empty texts have size 0 and are copied at their
    source's rate; a null source is a source of its own, the last in order; a source without words has target 0 and rate
    0. An empty table gives an empty result. A hot source is summed in part before the shuffle and joined by broadcast
    while there are few sources."""
    return copies_of(measured(df, id_col=id_col, text_col=text_col, seed=seed), source_col=source_col, weights=weights, most=most)


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each row of df as often as mix_counts says, with df's own columns, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_mix_row")
    rows = df.select(whole, F.col(id_col).alias("_mix_id"), F.col(text_col).alias("_mix_text"), F.col(source_col).alias("_mix_source"))
    counted = mix_counts(rows, id_col="_mix_id", text_col="_mix_text", source_col="_mix_source", **kw).where("copies > 0")
    return counted.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mix_n")).select("_mix_row.*")
