"""SpotSigs: chains of content words after common-word anchors as fingerprints of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, add_columns, join_groups, materialize, text_or_empty
from .textvec import LOWER_ALNUM, U64, groups_of, hash_spans, mix, word_hashes, words

# Anchors, the most common words of English, French, Spanish and German.
ANCHORS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you",
    "fr": "au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous",
    "es": "al como con de del el en es esta la las lo los más no o para pero por que se sin sobre su sus un una y ya",
    "de": "als am auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind so und von war wie zu zum zur",
}
#: Content words of a chain, and how many words without an anchor make the next word one.
CHAIN, GAP = 2, 12
#: Sets so alike are near-duplicates.
THRESHOLD = 0.75
#: A signature with more rows than PART is joined in SPREAD parts.
PART, SPREAD = 256, 32


@lru_cache(maxsize=1)
def _anchors() -> np.ndarray:
    every = sorted({w for ws in ANCHORS.values() for w in ws.split()})
    buf, starts, lens, _ = words(every, LOWER_ALNUM)
    return np.sort(hash_spans(buf, starts, lens))


def _signature_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct sorted 32-bit signatures of each text."""
    out, anchors = [], _anchors()
    for a, b in groups_of(texts, 1 << 19):
        (h, counts), at = word_hashes(texts[a:b], LOWER_ALNUM), 0
        common = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
        for n in counts:
            out.append(_signatures(h[at : at + n], common[at : at + n]))
            at += n
    return out


def _signatures(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(common, place, -1))
    since = place - last
    anchor = common | ((since % GAP == 0) & ~common)  # text without common words has anchors by distance
    content = np.flatnonzero(~common)
    nth = np.concatenate([[0], np.cumsum(~common)])[place + 1]  # content words up to each place: where a chain begins
    begin, lead = nth[anchor], h[anchor]
    lead, begin = lead[begin < len(content)], begin[begin < len(content)]
    if not len(begin):  # nothing follows any anchor: the whole sequence is one chain
        x = np.full(1, U64(n))
        for w in h:
            x = mix(x * U64(0x100000001B3) + w)
        return (x >> U64(32)).astype(np.uint32)
    sig = mix(lead)
    for k in range(CHAIN):
        there = begin + k < len(content)
        word = np.where(there, h[content[np.minimum(begin + k, len(content) - 1)]], U64(0))
        sig = mix(sig * U64(0x100000001B3) + word)
    return np.unique((sig >> U64(32)).astype(np.uint32))


def add_signatures(df: DataFrame, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """Columns `keep` and, for each {new: text column}, the sorted array<long> of the text's signatures."""

    def make():
        def work(batch):
            return {new: [s.astype(np.int64) for s in _signature_sets([t or "" for t in batch.column(old).to_pylist()])] for new, old in columns.items()}

        return work

    return add_columns(df, keep, make, {new: ("array<long>", lambda: pa.list_(pa.int64())) for new in columns})


def fingerprint_text(sigs: Column) -> Column:
    """The set as a string: 8 hexadecimal digits a signature, ascending, joined by nothing."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(x: Column, y: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike (1)."""
    both = F.size(F.array_intersect(x, y))
    j = both.cast("double") / (F.size(x) + F.size(y) - both)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(j)


def length_class(n: Column, threshold: float) -> Column:
    """floor(log(n) / log(1 / threshold)): sets whose classes differ by more than one are under the threshold."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / float(-np.log(threshold)) + 1e-9)).otherwise(-2)


def alike(x: Column, y: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two sets are at least `threshold` alike. Sets of distant length classes, then those whose sizes rule it
    out, are pruned without an intersection."""
    near = F.abs(length_class(F.size(x), threshold) - length_class(F.size(y), threshold)) <= 1
    fits = F.least(F.size(x), F.size(y)) >= F.lit(threshold - 1e-9) * F.greatest(F.size(x), F.size(y))
    return F.when(near & fits, likeness(x, y) >= threshold - 1e-9).otherwise(False)


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints, each by the smallest id that has it, that are at least
    `threshold` alike. Documents of equal fingerprints share a representative and are not paired; null and empty texts
    have no signatures and no partner; an empty table gives an empty result.

    Sets are partitioned by length class, so a partner's class differs by one at most. In a pair that is alike enough,
    the prefixes of size - ceil(threshold * size) + 1 rarest signatures (by counts over all sets) share one; only such
    pairs are made, and Jaccard is taken after the sizes have pruned. A frequent signature is joined in parts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    sets = add_signatures(rows, ["doc_id"], {"sigs": "text"}).where("size(sigs) > 0")
    sets = materialize(sets.groupBy("sigs").agg(F.min("doc_id").alias("id")), "spotsigs")
    entries = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counted = join_groups(entries, ["sig"], "id", [F.count("*").alias("df")], where="df > 1", how="left")
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "sig")))
    short = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("df").isNotNull())
    short = materialize(short.select("id", "n", "sig", "df", length_class(F.col("n"), threshold).alias("klass")), "prefixes")
    hot = F.col("df") > PART
    x = short.withColumn("part", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0)).alias("x")
    y = short.withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    y = y.withColumn("klass", F.explode(F.array(F.col("klass") - 1, F.col("klass"), F.col("klass") + 1))).alias("y")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.klass") == F.col("y.klass")) & (F.col("x.id") < F.col("y.id"))
    fits = F.least("x.n", "y.n") >= F.lit(threshold - 1e-9) * F.greatest("x.n", "y.n")
    pairs = x.join(y, on & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    pairs = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-9)


#: Bytes of text of one run of neighbours; a run is sorted and read in order by one task.
RUN_BYTES = 4 << 20
#: Runs that there are at most: the driver gets one key for each, whatever the size of the table.
MOST_RUNS = 16_384
#: Bits of the map that picks rows whose id and text may repeat: 8 MB, whatever the data.
BITS = 1 << 26
#: Copies of a row that one task writes.
COPIES = 1_024


def _cut_keys(rows: DataFrame, run_bytes: int) -> list:
    """The first keys of runs of about run_bytes each, ascending; the first is the smallest of all. Keys alone are range-
    partitioned, and the driver gets one a run, MOST_RUNS at most: of a larger table the runs are longer, which costs a
    task a larger sort and nothing else, since rows are sorted with spill and read in order."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    keys = rows.select("key.*").repartitionByRange(max(1, min(MOST_RUNS, -(-total // run_bytes))), "last", "id", "hash")
    firsts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("last", "id", "hash")).alias("first"))
    return sorted(tuple(r["first"]) for r in firsts.collect())


def _place(cuts: list, key: Column) -> tuple[Column, Column]:
    """(run of a key, whether the run begins with it): a binary search in the cuts, which travel as three arrays."""
    arrays = [F.split(F.lit(",".join(str(int(c[k])) for c in cuts)), ",").cast("array<long>") for k in range(3)]
    at = lambda k: F.struct((F.get(arrays[0], k) == 1).alias("last"), F.get(arrays[1], k).alias("id"), F.get(arrays[2], k).alias("hash"))

    def halve(span, _):
        lo, hi = span["lo"], span["hi"]
        middle = F.floor((lo + hi) / 2).cast("int")
        below = at(middle) <= key
        return F.struct(F.when((lo < hi) & below, middle + 1).otherwise(lo).alias("lo"), F.when((lo < hi) & ~below, middle).otherwise(hi).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda span: span["lo"] - 1)
    return run, at(F.col("run")) == key


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows with equal ones once, those that repeat with the number of their other copies; None if there are none).

    Keys are counted first. Only the texts of rows whose key repeats, picked by a bit map of BITS, are grouped, and
    Spark combines equal ones before the shuffle; the others stay where they are."""
    place = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    maps = materialize(repeated.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")), "repeated")
    if maps.isEmpty():
        return rows, None
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumns({"bucket": bucket, "bit": bit}).join(F.broadcast(maps), "bucket", "left")
    marked = marked.withColumn("may", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False)))
    groups = materialize(marked.where("may").groupBy(*rows.columns).agg((F.count("*") - 1).alias("copies")), "equal-rows")
    return marked.where("not may").select(*rows.columns).unionByName(groups.select(*rows.columns)), groups.where("copies > 0")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, (run, extra, doc_id, text, copies): each row that is not extra with the one after it, in one pass."""
    held = None
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            runs, extras, ids, texts, copies = (batch.column(c).to_pylist() for c in ("run", "extra", "doc_id", "text", "copies"))
            found = []
            for run, extra, doc, text, n, sigs in zip(runs, extras, ids, texts, copies, _signature_sets(texts), strict=True):
                if held is not None and held[0] == run:
                    _, own_id, own_text, own_n, own_sigs = held
                    found.append((own_id, own_text, _edit(own_text, text), own_sigs, sigs, own_n))
                held = None if extra else (run, doc, text, n, sigs)
            longs = lambda sets: pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            new = [f[2] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array(new, pa.string()),
                    longs([f[3] for f in found]), longs(_signature_sets(new)), longs([f[4] for f in found]), pa.array([f[5] for f in found], pa.int64()),
                ],
                names=["doc_id", "text", "edited", "own", "other", "follower", "copies"],
            )
        pa.default_memory_pool().release_unused()


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(doc_id, text, edited, own, other, follower) for every row: the signatures of its text, of its edited text, and of
    the text of the next row by ascending id (after the last row comes the first).

    The edited text has the last floor(n / 4) code points replaced by the next text's first as many. Ids that are null
    come last; rows with equal ids follow each other by the hash of their texts. Null texts count as empty, and have no
    signatures. One row is followed by itself; repeated rows follow each other; an empty table gives an empty result;
    other columns are not read.

    Rows go to runs of about run_bytes (longer ones beyond MOST_RUNS), cut at keys that exist; the rows with a run's first key also go to the run
    before, whose last row needs its follower, and those with the first key of all to the last run. So texts are
    shuffled once and sorted within a task, with spill, and a task holds one batch of them. Of rows that are equal in id
    and text one goes to a run; the others, which are followed by themselves, are compared once and multiplied in parts
    of COPIES, so that a row which makes up a third of the table is neither sorted nor written by one task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("hash"))
    rows, repeated = _apart(rows.withColumn("key", key))
    cuts = _cut_keys(rows, run_bytes) or [(False, 0, 0)]
    run, first = _place(cuts, F.col("key"))
    rows = rows.withColumn("run", run).withColumn("first", first)
    before = F.when(F.col("run") == 0, len(cuts) - 1).otherwise(F.col("run") - 1)
    homes = F.array(F.struct("run", F.lit(0).alias("extra")), F.when(F.col("first"), F.struct(before.alias("run"), F.lit(1).alias("extra"))))
    dealt = rows.select("doc_id", "text", "key", F.explode(F.array_compact(homes)).alias("home")).select("doc_id", "text", "key", "home.*")
    dealt = dealt.repartition("run").sortWithinPartitions("run", "extra", "key", "text").select("run", "extra", "doc_id", "text", F.lit(0).cast("long").alias("copies"))
    fields = "doc_id long, text string, edited string, own array<long>, other array<long>, follower array<long>, copies long"
    out = dealt.mapInArrow(_compare, fields).drop("copies")
    if repeated is None:
        return out
    twice = repeated.select(F.lit(0).alias("run"), F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"), "doc_id", "text", "copies")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("part")
    parts = twice.mapInArrow(_compare, fields).select("*", part).repartition("doc_id", "part")
    here = F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES).cast("int")
    return out.unionByName(parts.select(*out.columns, F.explode(F.array_repeat(F.lit(0), here)).alias("copy")).drop("copy"))


def _edit(text: str, follower: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + follower[:cut]
