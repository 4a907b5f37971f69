"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, add_columns, cut_text, join_groups, materialize, text_or_empty, with_row_id

#: Fixed values of the fingerprint: two primes under 2 ** 31, so that products stay in 62 bits, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_007, 870_123_457)
#: Characters of a chunk; longer texts are hashed in chunks that are dealt to all tasks.
CHUNK = 32_768
#: Bits of the map that picks the texts to compare: 8 MB, whatever the data.
BITS = 1 << 26
#: Rows of a group that meet the group's first text in one task.
PART = 256
#: Bytes that are hashed in one vector.
BLOCK = 1 << 16


@lru_cache(maxsize=4)
def _powers(k: int, n: int) -> np.ndarray:
    """base ** (n - 1), ..., base, 1 modulo prime k."""
    out, p, b = np.empty(n, dtype=np.uint64), PRIMES[k], BASES[k]
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * b % p
    return out


def hash_bytes(data: bytes) -> tuple[int, int, int, int]:
    """(h0, h1, s0, s1): the sum of (byte + 1) * base ** (bytes after it) for each prime, and base ** len(data)."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    out, shifts = [], []
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        powers, h = _powers(k, BLOCK), 0
        for at in range(0, len(values), BLOCK):
            part = values[at : at + BLOCK]
            h = (h * pow(b, len(part), p) + int((part * powers[BLOCK - len(part) :]).sum()) % p) % p
        out.append(h)
        shifts.append(pow(b, len(values), p))
    return out[0], out[1], shifts[0], shifts[1]


def combine(left: tuple, right: tuple) -> tuple:
    """The hash of two joined byte strings from their hashes."""
    return tuple((left[k] * right[2 + k] + right[k]) % PRIMES[k] for k in (0, 1)) + tuple(left[2 + k] * right[2 + k] % PRIMES[k] for k in (0, 1))


def _hashes():
    def work(batch):
        found = [hash_bytes(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        return {name: [f[k] for f in found] for k, name in enumerate(("h0", "h1", "s0", "s1"))}

    return work


HASH_FIELDS = {k: ("long", pa.int64) for k in ("h0", "h1", "s0", "s1")}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def _chunks(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each CHUNK characters of `text`, at least one; columns `keep`, n and text."""
    return df.select(*keep, F.posexplode(cut_text(F.col("text"), CHUNK)).alias("n", "text"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, text) to (rid, doc_id, n_bytes, h0, h1, text_sha256); text is normalised already.

    Short texts are hashed in place. The chunks of longer ones are dealt to all tasks, hashed there, and combined by
    length-shifted arithmetic: h(ab) = h(a) * base ** len(b) + h(b) modulo the prime, in Spark expressions."""
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("text_sha256", F.sha2("text", 256))
    keep = ["rid", "doc_id", "n_bytes", "text_sha256"]
    short = add_columns(rows.where(F.length("text") <= CHUNK), keep, _hashes, HASH_FIELDS)
    pieces = _chunks(rows.where(F.length("text") > CHUNK), keep).repartition("rid", "n")
    hashed = add_columns(pieces, [*keep, "n"], _hashes, HASH_FIELDS)
    parts = F.sort_array(F.collect_list(F.struct("n", "h0", "h1", "s0", "s1")))
    joined = hashed.groupBy(*keep).agg(parts.alias("parts"))
    fold = lambda k: F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: (h * x[f"s{k}"] + x[f"h{k}"]) % PRIMES[k])
    long = joined.select(*keep, fold(0).alias("h0"), fold(1).alias("h1"))
    return short.select(*keep, "h0", "h1").unionByName(long)


PRINT = ["n_bytes", "h0", "h1"]


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose rid may be among wanted's: a bit map of their hashes, BITS long, is broadcast, so that the texts of the
    other rows are not shuffled. A bit that two rows share lets one too many through; the join that follows drops it."""
    place = F.pmod(F.xxhash64("rid"), F.lit(BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = wanted.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(maps), "_bucket")
    return near.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; texts are equal if they are the same after each
    run of ASCII white space has become one space.

    keep_id is the smallest id of the equal texts; ids that are null come after all others, and keep_id is null only if
    all are. One row of a group is kept: that with keep_id, of repeated rows the first in the scan. A null text counts
    as empty; an empty table gives an empty result; other columns are not read.

    Rows of one fingerprint (length and two polynomial hashes) form a group by an aggregate that combines before the
    shuffle. Every row of a group with several then meets the text of the group's first row chunk by chunk, which joins
    on fingerprint and chunk number, so neither a long text nor a large group has to be held; a large group is dealt to
    one task for each PART rows. Rows that differ in a chunk (a collision) leave the group for one of their own text's
    digest. Groups are joined in parts, so no task gets a hot one whole."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    rows = scratch.write(with_row_id(rows, "rid"), "rows")
    prints = scratch.write(fingerprints(rows), "fingerprints")
    first = [F.min("rid").alias("first_rid"), F.count("*").alias("members")]
    suspects = join_groups(prints.select("rid", *PRINT), PRINT, "rid", first, where="members > 1")
    suspects = scratch.write(suspects.select("rid", "first_rid", F.floor(F.col("members") / PART).cast("int").alias("parts")), "suspects")

    # Joined by sort at every size: the few texts that are left are shuffled, and nothing but the bit map is broadcast.
    texts = _picked(rows, suspects).join(suspects.hint("merge"), "rid")
    texts = scratch.write(_chunks(texts, ["rid", "first_rid", "parts"]), "chunks")
    firsts = texts.where("rid = first_rid").select("first_rid", "n", F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"))
    others = texts.where("rid <> first_rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts") + 1).cast("int"))
    differs = others.join(firsts.hint("merge"), ["first_rid", "n", "part"], "left").where(~F.col("text").eqNullSafe(F.col("first_text"))).select("rid").distinct()

    marked = prints.select("rid", "doc_id", "text_sha256").join(suspects.select("rid", "first_rid").hint("merge"), "rid", "left").join(differs.withColumn("own", F.lit(True)), "rid", "left")
    marked = marked.withColumn("grp", F.when(F.col("own"), F.col("text_sha256")).otherwise(F.col("first_rid").cast("string")))
    marked = materialize(marked.select("rid", "doc_id", "text_sha256", "grp"), "groups")
    scratch.clear()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    out = join_groups(marked.where("grp is not null"), ["grp"], "rid", [F.min(order).alias("stays"), F.count("*").alias("group_size")])
    out = out.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("stays.rid")).alias("kept"), "text_sha256")
    alone = marked.where("grp is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return out.unionByName(alone)
