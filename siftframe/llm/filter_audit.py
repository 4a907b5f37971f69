"""How quality filters interact: what each removes at each place of each order, from one count of failure combinations."""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, Scratch, add_columns, materialize, salted_groups, text_or_empty, with_salt
from .exact_dedup import _picked

#: The filters, by the bit that each has in a failure combination: few words, few distinct words, capitals, symbols, copy.
FILTERS = "ABCDE"
#: A: fewer words; B: a smaller percentage of distinct words; C: a larger percentage of capitals; D: any of the symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: What rows have in common that fail the same filters.
SAME = ["doc_id", "part", "digest"]


def word_counts(text: str) -> tuple[int, int]:
    """(words, distinct words) of a text, read in pieces that end between words; the distinct words alone are held."""
    data, seen, n, at = text.encode("utf-8", "surrogatepass"), set(), 0, 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        found = data[at:end].split()
        n, at = n + len(found), end
        seen.update(found)
    return n, len(seen)


def _words():
    def work(batch):
        counts = [word_counts(t) for t in batch.column("text").to_pylist()]
        return {"n_words": [c[0] for c in counts], "n_distinct": [c[1] for c in counts]}

    return work


def own_failures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and `mask`: the bits of the filters A to D that each row's `text` fails. Texts are not null here."""
    length, capitals = F.length("text"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    rows = docs.withColumns({"_c": 100 * capitals.cast("long") > MOST_CAPITALS * length.cast("long"), "_d": F.col("text").rlike(SYMBOLS)})
    fields = {"n_words": ("long", pa.int64), "n_distinct": ("long", pa.int64)}
    rows = add_columns(rows.select(*keep, "_c", "_d", "text"), [*keep, "_c", "_d"], _words, fields)
    fails = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), F.col("_c"), F.col("_d")]
    return rows.select(*keep, sum(F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)).alias("mask"))


def copies(rows: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, digest), distinct: those of the rows (with hash and text) whose text some smaller id has as well.

    A left-semi join on hash, exact text and a smaller id. Its right side has one row a text, the smallest id: any
    smaller id that has the text implies that one. Only texts whose hash occurs more than once (in `own`, which has the
    hashes without the texts) are shuffled; they are picked by a bit map of bounded size. The rows of one text meet the
    right side's row in parts, so that a hot text is dealt to many tasks."""
    hashes = scratch.write(own.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("rid")), "hashes")
    suspects = _picked(rows.select(*SAME, "text", F.col("hash").alias("rid")), hashes).withColumnRenamed("rid", "hash")
    suspects = scratch.write(suspects, "suspects")
    salted = with_salt(suspects, "doc_id")
    least = salted_groups(salted, ["hash", "text"], [F.min("doc_id").alias("least")])
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("_salts", k) == 1)
    least = least.select("hash", "text", "least", F.explode(parts).alias("_salt"))
    on = [salted[c] == least[c] for c in ("hash", "text", "_salt")]
    return salted.join(least, [*on, least["least"] < salted["doc_id"]], "left_semi").select(*SAME).distinct()


def failures(docs: DataFrame, labels: DataFrame | None, part: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): rows by what they fail and how they are labelled."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "digest": F.sha2("text", 256)})
    own = scratch.write(own_failures(rows, [*SAME, "hash"]), "failures")
    # The ids that fail E are united with those that fail the rest. Rows of one id, part and text fail the same.
    e = copies(rows.select(*SAME, "hash", "text"), own, scratch).select(*SAME, F.lit(1 << FILTERS.index("E")).alias("mask"), F.lit(0).cast("long").alias("n"))
    both = own.select(*SAME, "mask", F.lit(1).cast("long").alias("n")).unionByName(e)
    by_part = both.groupBy(*SAME).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    if labels is None:
        marked = by_part.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
        of = of.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        marked = by_part.join(of, "doc_id", "left").fillna(False, ["good", "toxic"])
    out = materialize(marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "combinations")
    scratch.clear()
    return out


def audit(combinations: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley).

    A part's combinations are 32 at most, so it is one row with an array of them; every count is a sum over those whose
    bits miss, or meet, a set of filters. A row that fails k filters is removed by each of them in 120 / k of the
    orders, which gives the sum over all orders without going through them."""
    n, orders = len(FILTERS), F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    good, toxic = F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0))
    masks = combinations.groupBy("part", "mask").agg(F.sum("n").alias("n"), good.alias("good"), toxic.alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("all"))
    rows = parts.select("part", "all", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    bits = F.transform(F.split("filter_order", ""), lambda f: F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(FILTERS) for x in (c, 1 << k)]), f))
    rows = rows.withColumn("_bits", bits)
    before = F.aggregate(F.slice("_bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(x))
    rows = rows.withColumns({"_here": F.get("_bits", F.col("step") - 1), "_before": before})
    h, b = F.col("_here"), F.col("_before")
    total = lambda when, what: F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["mask"]), what(x)).otherwise(0))
    fails, spared = lambda m: m.bitwiseAND(h) != 0, lambda m: m.bitwiseAND(b) == 0
    lost = lambda m: fails(m) & spared(m)
    share = lambda x: x["n"] * F.lit(factorial(n)).cast("long") / F.bit_count(x["mask"])
    count = lambda x: x["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: spared(m) & ~fails(m), count).alias("kept"), total(lost, count).alias("removed"),
        total(lambda m: fails(m) & ~spared(m), count).alias("redundant"), total(lambda m: m == h, count).alias("unique_fails"),
        total(lost, lambda x: x["good"]).alias("good_lost"), total(lost, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: share(x).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, part: str = "source", **kw) -> DataFrame:
    """The audit of docs by the column `part` (null: empty string); labels (doc_id, quality, toxic) mark good and toxic
    documents, a document being either if any label row of its id says so.

    A null text is empty and fails A alone (and E, if a smaller id is empty too). A row whose id is null fails E never
    and makes no other row fail it, since it is not smaller than any; it has no labels. Rows that are equal in id and
    text are counted as often as they occur. An empty table has no parts and gives an empty result; other columns are
    not read. A long text's words are counted in pieces; its distinct words are held in one task."""
    return audit(failures(docs, labels, F.col(part), **kw))
