"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Production size: slots (a prime, over 100 a shard, so that shares differ by under one in a hundred) and shards.
SLOTS, SHARDS = 65_537, 128


def _number(name: str, salt: str, below: int) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest(), 16) % below


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard. Shards take turns; each claims the next free slot of its own permutation of the
    slots (offset and skip from its name), so shares differ by one at most, and few slots change hands when a shard
    comes or goes. Its size is a parameter and does not depend on the data."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("one to `slots` distinct shard names are needed")
    at = [_number(s, "offset", slots) for s in shards]
    skip = [_number(s, "skip", slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string key: 60 bits of its MD5, so that any engine can compute it."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard` (columns of these names are replaced, all others stay, whatever their names). A null
    key counts as the empty string; equal keys, and so repeated rows, get one shard; an empty table stays empty.

    The table has `slots` rows, a parameter, and is broadcast for that reason: placement is a hash lookup per row
    without a shuffle, however hot a key is. Callers that want even shards pass a key that is unique to each row."""
    rows = df.withColumn("slot", slot_of(F.coalesce(key.cast("string"), F.lit("")), slots)).drop("shard")
    place = fresh(rows, "_slot")
    table = [(s, shards[k]) for s, k in enumerate(fill_table(shards, slots))]
    lookup = df.sparkSession.createDataFrame(table, f"{place} long, shard string")
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col(place), "left").drop(place)


def write_shards(df: DataFrame, path: str) -> None:
    """Write assigned rows as one folder a shard; files of a shard come from all tasks, so no shard meets in one. What
    is at the path is replaced, so a run that is repeated doubles nothing."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)
