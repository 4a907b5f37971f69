"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Scratch, add_columns, fresh, join_groups, join_salted, materialize, salted_groups, text_or_empty, with_row_id, with_salt
from .components import connected, extended
from .jaccard_join import blocked_product, sets_of
from .textvec import LOWER, U64, groups_of, hash_spans, mix, shingle_sets, shingles_of, words

#: Components of a signature, and rows of a band. A pair at similarity 0.75 shares one of the 32 bands of 4 with
#: probability 1 - (1 - 0.75 ** 4) ** 32, all but 5 in a million.
M, ROWS = 128, 4
#: Elements whose permutations are held at once.
BLOCK = 100_000
#: Pairs of one first node that are confirmed in one task.
PART = 256


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Signatures (n x m, uint64) of n sets; owner[i] is the set of elements[i].

    Each element walks a random permutation of the m components, built by swaps as the walk goes on; at step j it
    offers j + r, r uniform in [0, 1), to the component it is at, and the smallest offer wins. Ranks of an element
    over the components are therefore distinct, which lowers the variance against independent hashes. A set stops as
    soon as every component has an offer below j + 1, since later steps offer more."""
    sig = np.full((n, m), U64(0xFFFFFFFFFFFFFFFF))
    flat = sig.reshape(-1)

    def draws(x, j):
        z = mix(x + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = U64(j) + (((z & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32))
        return k.astype(np.int64), (U64(j) << U64(32)) | (z >> U64(32))

    k, value = draws(elements, 0)
    np.minimum.at(flat, owner * m + k, value)
    open_ = sig.max(axis=1) >= U64(1 << 32)
    rest = np.flatnonzero(open_[owner])
    cuts = [0]
    if len(rest):  # blocks of whole sets
        edges = np.flatnonzero(np.diff(owner[rest])) + 1
        for e in [*edges, len(rest)]:
            if e - cuts[-1] >= BLOCK or e == len(rest):
                cuts.append(int(e))
    for a, b in zip(cuts, cuts[1:], strict=False):
        live, first = rest[a:b], k[rest[a:b]]
        place = np.tile(np.arange(m, dtype=np.uint8), (len(live), 1))
        at = np.arange(len(live))
        place[at, first], place[at, 0] = 0, first.astype(np.uint8)
        for j in range(1, m):
            kj, value = draws(elements[live], j)
            there = place[at, kj]
            place[at, kj], place[at, j] = place[at, j], there
            np.minimum.at(flat, owner[live] * m + there, value)
            sets = np.unique(owner[live])
            still = np.zeros(n, dtype=bool)
            still[sets] = sig[sets].max(axis=1) >= U64((j + 1) << 32)
            keep = still[owner[live]]
            if not keep.any():
                break
            if keep.mean() < 0.7:
                live, place = live[keep], place[keep]
                at = np.arange(len(live))
    return sig


def _bands(sig: np.ndarray) -> np.ndarray:
    b = sig.shape[1] // ROWS
    h = np.tile(np.arange(1, b + 1, dtype=U64) * U64(0xA0761D6478BD642F), (len(sig), 1))
    for r in range(ROWS):
        h = mix(h * U64(0x100000001B3) + sig[:, r::ROWS][:, :b])
    return h.view(np.int64)


def _signatures(size: int):
    def work(batch):
        texts = batch.column("text").to_pylist()
        digests, sizes, bands = [], [], []
        for a, b in groups_of(texts, 1 << 19):
            buf, starts, lens, counts = words(texts[a:b], LOWER)
            h, at, sets = hash_spans(buf, starts, lens), 0, []
            for n in counts:
                sets.append(shingles_of(h[at : at + n], size))
                own = buf[starts[at] : starts[at + n - 1] + lens[at + n - 1]] if n else None
                digests.append(hashlib.blake2b(own, digest_size=16).hexdigest() if n else None)
                at += n
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            sig = superminhash(np.concatenate(sets), owner, len(sets))
            sizes += [len(s) for s in sets]
            bands += [x if len(s) else None for x, s in zip(_bands(sig), sets, strict=True)]
        return {"digest": digests, "n_shingles": sizes, "bands": bands}

    return lambda: work


SIG_FIELDS = {
    "digest": ("string", pa.string),
    "n_shingles": ("long", pa.int64),
    "bands": ("array<long>", lambda: pa.list_(pa.int64())),
}


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch, keep = whole.slice(at, SLICE), []
                for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                    if a != last:
                        last, mine = a, shingle_sets([ta.as_py()], size)[0]
                    other = shingle_sets([tb.as_py()], size)[0]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(mine) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full shingle sets are similar enough. The text of a node with many pairs goes to
    one task for each PART of them."""
    part = lambda n: F.floor(F.col(n) / PART).cast("int")
    sized = join_groups(pairs, ["a"], "b", [F.count("*").alias("n")])
    sized = sized.select("a", "b", F.pmod(F.xxhash64("b"), part("n") + 1).cast("int").alias("part"))
    firsts = pairs.groupBy("a").agg(F.count("*").alias("n")).join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    firsts = firsts.select("a", "ta", F.explode(F.sequence(F.lit(0), part("n"))).alias("part"))
    both = sized.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b").join(firsts, ["a", "part"])
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(size, percent), "a long, b long")


def _open_buckets(members: DataFrame, labels: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes of buckets that hold several components, with their component, set size and number of links."""
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = join_groups(placed, ["key"], "node", [F.min("component").alias("_lo"), F.max("component").alias("_hi")], where="_lo < _hi").drop("_lo", "_hi")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return mixed.join(facts, "node").join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _fit(x: str, y: str, percent: int) -> Column:
    """Whether the sizes of two sets leave room for a link."""
    return F.expr(f"100 * least({x}n_shingles, {y}n_shingles) >= {percent} * greatest({x}n_shingles, {y}n_shingles)")


def _last_links(rest: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(a, b): edges that join the components of buckets that are still open, as a forest; `rest` has key, node,
    component and n_shingles of their nodes.

    Nodes of one bucket are candidates, and buckets that share a node are looked at together. Of such a group, all pairs
    are verified in the tasks by the blocked product of their sets (see jaccard_join), but for the pairs within the
    group's largest component, which are together already. No pair is made as a row, so a large group whose members all
    fall just short of the threshold costs arithmetic and nothing else."""
    tied = join_groups(rest, ["key"], "node", [F.min("node").alias("leader")], where="leader is not null").where("leader < node")
    tied = scratch.write(tied.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
    groups = connected(tied).withColumnRenamed("component", "candidate")
    nodes = scratch.write(rest.select("node", "component", F.col("n_shingles").alias("n")).distinct().join(groups, "node"), "open-nodes")
    sizes = nodes.groupBy("candidate", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("candidate").agg(F.max(F.struct("m", "component"))["component"].alias("component")).withColumn("settled", F.lit(True))
    placed = nodes.join(largest, ["candidate", "component"], "left").select("node", "n", F.lit(1).alias("copies"), F.col("candidate").alias("component"), F.coalesce("settled", F.lit(False)).alias("settled"))
    placed = scratch.write(placed, "placed")
    sets = sets_of(texts.join(placed.select(F.col("node").alias("rid")), "rid"), size).withColumnRenamed("rid", "node")
    product = scratch.write(blocked_product(placed, scratch.write(sets, "sets"), percent), "product")
    return product.where("b is not null").select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, row_id: str | None = None) -> DataFrame:
    """Group documents whose sets of `shingle`-word shingles link: 100 * intersection >= percent * union.

    Words are runs of anything but ASCII white space after lower-casing A-Z; a text with fewer words has its whole
    sequence as its one shingle. Returns (rid, doc_id, n_shingles, component, component_id, kept): rid is the row's
    number, from the column `row_id` of docs as they were written, or given here; component is a number of the group,
    component_id the smallest id that links reach.
    Null and empty texts have no shingles and link with nothing; their component_id is their own id. Rows of equal word
    sequences are one node, so copies are never paired with each other; repeated rows with the smallest id of a
    component are all `kept`, and so is a row whose id is null when no row of its component has one (then component_id
    is null). Empty tables give empty results; other columns are not read.

    1. One pass hashes words and shingles and builds SuperMinHash signatures and 32 band keys.
    2. Nodes of one band bucket are compared with the bucket's smallest node only, on full sets; links are grouped.
    3. A link between nodes that are already together says nothing new, so only buckets that still hold several
       components are looked at again. Their nodes are compared with the bucket's node that has most links.
    4. The nodes of buckets that are still open are compared with each other across components (see _last_links). So no
       bucket is capped, no pair that shares a band goes unverified, and a large group whose members all fall just short
       of the threshold does not make a pair of every two. What banding may lose: a pair at exactly 0.75 that shares no
       band (5 in a million), and only if no chain of other links joins the two.

    Rows of one digest, bucket or group are joined in parts (join_groups), so a hot one is dealt to many tasks."""
    scratch = Scratch(docs.sparkSession)
    rows = [F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")]
    rows = docs.select(*rows, F.col(row_id).alias("rid")) if row_id else scratch.write(with_row_id(docs.select(*rows), "rid"), "rows")
    sig = scratch.write(add_columns(rows, ["doc_id", "rid"], _signatures(shingle), SIG_FIELDS), "signatures")
    salted = with_salt(sig, "rid")
    classes = scratch.write(salted_groups(salted.where("digest is not null"), ["digest"], [F.min("rid").alias("node")]), "classes")
    nodes = join_salted(salted.select("rid", "digest", "n_shingles", "bands", "_salt"), classes, ["digest"]).where("rid = node")
    nodes = scratch.write(nodes.select("node", "n_shingles", "bands"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    members = join_groups(banded, ["key"], "node", [F.min("node").alias("leader"), F.count("*").alias("n")], where="n > 1")
    members = scratch.write(members.select("key", "node", "leader"), "members")
    pairs = scratch.write(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = members.select(F.col("node").alias("rid")).distinct()
    texts = scratch.write(rows.join(wanted, "rid").select("rid", "text"), "texts")
    links = scratch.write(_links(pairs, texts, shingle, percent), "links")
    labels = connected(links)
    facts = nodes.select("node", "n_shingles")
    open_ = scratch.write(_open_buckets(members, labels, facts, links), "open")
    if not open_.isEmpty():
        head = F.max_by(F.struct("node", "component", "n_shingles"), F.struct("degree", F.xxhash64("node"))).alias("y")
        across = join_groups(open_, ["key"], "node", [head]).where((F.col("component") != F.col("y.component")) & _fit("", "y.", percent))
        again = across.select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct()
        more = scratch.write(_links(scratch.write(again, "pairs"), texts, shingle, percent), "links")
        labels, links = extended(labels, more), links.unionByName(more)
        rest = scratch.write(_open_buckets(members, labels, facts, links).select("key", "node", "component", "n_shingles"), "rest")
        if not rest.isEmpty():
            labels = extended(labels, _last_links(rest, texts, scratch, shingle, percent))

    member = classes.join(labels, "node", "left").select("digest", "_salts", F.coalesce("component", "node").alias("component"))
    out = join_salted(salted.select("rid", "doc_id", "digest", "n_shingles", "_salt"), member, ["digest"], "left")
    out = materialize(out.withColumn("component", F.coalesce("component", "rid")).drop("digest"), "grouped")
    scratch.clear()
    out = join_groups(out, ["component"], "rid", [F.min("doc_id").alias("component_id")])
    return out.select("rid", "doc_id", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest id, then the first in the scan. Columns and
    texts stay as they are, whatever their names; rows without words all stay."""
    rid = fresh(docs, "_siftframe_rid")
    docs = materialize(with_row_id(docs, rid), "rows")
    groups = materialize(near_duplicates(docs, row_id=rid, **kw).select("rid", "n_shingles", "component", "kept"), "groups")
    # Repeated rows with the kept id: the first of them stays.
    first = groups.where("kept and n_shingles > 0").groupBy("component").agg(F.min("rid").alias("rid"))
    gone = groups.where("n_shingles > 0").select("rid").join(first.select("rid"), "rid", "left_anti")
    return docs.join(gone.withColumnRenamed("rid", rid), rid, "left_anti").drop(rid)
