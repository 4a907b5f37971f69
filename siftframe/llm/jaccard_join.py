"""N-gram Jaccard join: a blocked product of the document by n-gram incidence matrix with itself, pruned by set sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, add_columns, join_groups, join_salted, materialize, salted_groups, text_or_empty, with_row_id, with_salt
from .components import connected
from .exact_dedup import _picked
from .textvec import U64, mix, shingle_sets

#: Words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 3, 90
#: A column block of fewer shingles says little; a set with too many such blocks is cut anew, at most so many times.
LEAST_BLOCK, CUTS = 3, 4
#: Rows, and n-grams of rows, of one row block of the product; columns that are multiplied at once.
MOST_ROWS, MOST_CELLS, COLUMNS = 1_024, 1 << 20, 2_048


@lru_cache(maxsize=4)
def size_classes(percent: int) -> np.ndarray:
    """Ascending first sizes of the size classes. A class is so wide that the partners of its sets, whose sizes differ
    by the factor 100 / percent at most, are in it or in one of its two neighbours."""
    edges, step = [1], (100 / percent) ** 2
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * step) + 1))
    return np.array(edges, dtype=np.int64)


def blocks_of_class(k: int, percent: int) -> tuple[int, int]:
    """(column blocks, how many of them may be weak) for pairs whose smaller set is in class k.

    Two linked sets of x <= y elements differ in at most (x + y) * (100 - percent) / (100 + percent) elements. With one
    column block more than that, they agree in a whole block; with as many more as a set may have weak blocks, they
    agree in a block that is not weak."""
    most = int(size_classes(percent)[k + 1]) - 1
    differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    spare = differ // 16
    return differ + 1 + spare, spare


def block_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys (uint64) of the column blocks of one set: two sets that link have a key in common.

    The n-grams, the columns of the incidence matrix, are dealt to blocks by hash; a key names the class, the cut, the
    block and all that the set has in it. A set that has too many weak blocks (under LEAST_BLOCK n-grams) is also cut
    by another hash; weak blocks have no key, but for the last cut. So two linked sets meet: they agree in a block of
    the first cut, or only in weak ones, and then both are cut anew."""
    n, edges = len(s), size_classes(percent)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    below = int(np.searchsorted(edges, -(-percent * n // 100), side="right")) - 1
    out = []
    for k in range(below, own + 1):
        blocks, spare = blocks_of_class(k, percent)
        for cut in range(CUTS):
            seed = U64((k * CUTS + cut + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = mix(s ^ seed)
            at = (h % U64(blocks)).astype(np.int64)
            held = np.bincount(at, minlength=blocks)
            content = np.zeros(blocks, dtype=U64)
            np.add.at(content, at, mix(h))
            keys = mix(content ^ mix(np.arange(blocks, dtype=U64) + seed))
            strong = held >= LEAST_BLOCK
            last = cut == CUTS - 1 or blocks == 1 or (~strong).sum() <= spare
            out.append(keys if cut == CUTS - 1 or blocks == 1 else keys[strong])
            if last:
                break
    return np.concatenate(out)


def _described(size: int, percent: int):
    def work(batch):
        sets = shingle_sets(batch.column("text").to_pylist(), size)
        return {
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets],
            "n_shingles": [len(s) for s in sets],
            "keys": [block_keys(s, percent).view(np.int64) if len(s) else [] for s in sets],
        }

    return lambda: work


DESCRIBED = {"digest": ("string", pa.string), "n_shingles": ("long", pa.int64), "keys": ("array<long>", lambda: pa.list_(pa.int64()))}


def overlaps(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows of a link with which of b: the product of their incidence matrices, COLUMNS at a time.

    Pairs whose sizes rule a link out are discarded first; after each block of columns, so are those that fall short
    even if all that is left of the smaller set overlaps. It ends when no pair is left."""
    na, nb = (np.array([len(s) for s in x], dtype=np.int64) for x in (a, b))
    least = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    alive = 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    if not alive.any():
        return alive
    columns = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (a, b)), assume_unique=True)

    def cells(sets, sizes):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(columns, flat), max(len(columns) - 1, 0))
        there = columns[at] == flat if len(columns) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[there], kind="stable")
        return row[there][order], at[there][order]

    (ra, ca), (rb, cb) = cells(a, na), cells(b, nb)
    rest_a, rest_b = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(b))
    over = np.zeros(alive.shape, dtype=np.int64)
    alive &= np.minimum(rest_a[:, None], rest_b[None, :]) >= least
    for first in range(0, len(columns), COLUMNS):
        if not alive.any():
            return alive
        dense, rests = [], []
        for row, col, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            lo, hi = np.searchsorted(col, [first, first + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(columns) - first)), dtype=np.float32)
            m[row[lo:hi], col[lo:hi] - first] = 1
            dense.append(m)
            rests.append(np.bincount(row[lo:hi], minlength=n))
        over += (dense[0] @ dense[1].T).astype(np.int64)
        rest_a, rest_b = rest_a - rests[0], rest_b - rests[1]
        alive &= over + np.minimum(rest_a[:, None], rest_b[None, :]) >= least
    return alive


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what `link` (rows x cols, of nodes) joins: each node with the smallest that it reaches."""
    up, down = np.arange(len(rows)), np.full(len(cols), len(rows))
    while True:
        new = np.where(link, up[:, None], len(rows)).min(axis=0, initial=len(rows))
        back = np.minimum(up, np.where(link, new[None, :], len(rows)).min(axis=1, initial=len(rows)))
        if (new == down).all() and (back == up).all():
            break
        up, down = back, new
    a = [(rows[i], rows[r]) for i, r in enumerate(up.tolist()) if r != i]
    return a + [(cols[j], rows[r]) for j, r in enumerate(down.tolist()) if r < len(rows) and cols[j] != rows[r]]


BLOCK = ["component", "c1", "p1", "c2", "p2"]


def _product(percent: int):
    """The rows of a task, sorted by BLOCK and side, to (a, b, links): a forest edge (links null), or a node (b null) with
    the documents that it links with in this block."""

    def solve(rows):
        one = [r for r in rows if r[0] == 0]
        two = [r for r in rows if r[0] == 1]
        diagonal = not two
        other = one if diagonal else two
        if not one or (diagonal and len(one) < 2):
            return []
        link = overlaps([r[3] for r in one], [r[3] for r in other], percent)
        if diagonal:
            np.fill_diagonal(link, False)
        na, nb = np.array([r[1] for r in one]), np.array([r[1] for r in other])
        copies_a, copies_b = np.array([r[2] for r in one]), np.array([r[2] for r in other])
        out = [(int(a), int(b), None) for a, b in _forest(link, na, nb)]
        ends = [(na, link @ copies_b)] + ([] if diagonal else [(nb, link.T @ copies_a)])
        return out + [(int(node), None, int(k)) for nodes, counts in ends for node, k in zip(nodes, counts, strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done():
            found = solve(rows)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in BLOCK), strict=True))
            for i, k in enumerate(keys):
                if k != key:
                    if rows:
                        yield done()
                    key, rows = k, []
                s = batch.column("s")[i].values.to_numpy().view(np.uint64)
                rows.append((batch.column("side")[i].as_py(), batch.column("node")[i].as_py(), batch.column("copies")[i].as_py(), s))
        if rows:
            yield done()

    return run


def _homes(nodes: DataFrame, percent: int, most_rows: int, most_cells: int) -> DataFrame:
    """(node, copies, BLOCK, side): the blocks of the product that each node (with n, copies, component and perhaps
    settled) is part of.

    A component of candidates is a diagonal piece of the product. One that is small enough is one block. In a larger
    one, the rows of each size class are dealt to row blocks by hash; a row block meets those of its own class and of
    its neighbours, since sets of other classes are too unlike in size. Rows that are `settled` are linked with each
    other already, and only meet those that are not: they are classes of their own (odd numbers)."""
    edges = F.split(F.lit(",".join(map(str, size_classes(percent).tolist()))), ",").cast("array<long>")
    cls = 2 * (F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1)
    if "settled" in nodes.columns:
        cls = cls + F.when(F.col("settled"), 1).otherwise(0)
    salted = with_salt(nodes.withColumn("cls", cls), "node")
    sums = salted_groups(salted, ["component", "cls"], [F.count("*").alias("rows"), F.sum("n").alias("cells")])
    need = F.ceil(F.greatest(F.col("rows") / most_rows, F.col("cells") / most_cells)).cast("int")
    small = (F.sum("rows") <= most_rows) & (F.sum("cells") <= most_cells)
    parts = sums.groupBy("component").agg(small.alias("small"), F.map_from_entries(F.collect_list(F.struct("cls", need.alias("parts")))).alias("parts"), F.bit_or("_salts").alias("_salts"))
    placed = join_salted(salted, parts, ["component"])

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    c, zero = F.col("cls"), F.lit(0)
    p = F.pmod(F.xxhash64("node"), F.element_at("parts", c)).cast("int")
    home = lambda c1, p1, c2, p2, side: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"), side.alias("side"))
    inside = F.transform(upto(F.element_at("parts", c)), lambda q: home(c, F.least(p, q), c, F.greatest(p, q), F.when(q < p, 1).otherwise(0)))
    inside = F.when(c % 2 == 0, inside).otherwise(F.slice(inside, 1, 0))
    near = F.filter(F.map_keys("parts"), lambda d: (F.abs(F.shiftright(d, 1) - F.shiftright(c, 1)) <= 1) & (d != c) & ((d % 2 == 0) | (c % 2 == 0)))
    meet = lambda d: F.transform(upto(F.element_at("parts", d)), lambda q: F.when(d < c, home(d, q, c, p, F.lit(1))).otherwise(home(c, p, d, q, zero)))
    whole = F.array(home(zero, zero, zero, zero, zero))
    homes = F.when(F.col("small"), whole).otherwise(F.concat(inside, F.flatten(F.transform(near, meet))))
    return placed.select("node", "copies", "component", F.explode(homes).alias("home")).select("node", "copies", "component", "home.*")


def blocked_product(nodes: DataFrame, sets: DataFrame, percent: int, most_rows: int = MOST_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(a, b, links) of nodes (node, n, copies, component, perhaps settled) with their sets (node, s): links within each
    component as a forest of edges (a, b), and for each node (b null) how many documents it links with, block by block.
    No pair leaves a task."""
    homes = _homes(nodes, percent, most_rows, most_cells)
    dealt = homes.join(sets.hint("merge"), "node").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side")
    return dealt.select(*BLOCK, "side", "node", "copies", "s").mapInArrow(_product(percent), "a long, b long, links long")


def sets_of(rows: DataFrame, shingle: int, id_col: str = "rid") -> DataFrame:
    """(id, s) of rows with a text: its sorted shingle hashes."""

    def work(batch):
        return {"s": [x.view(np.int64) for x in shingle_sets(batch.column("text").to_pylist(), shingle)]}

    return add_columns(rows.select(id_col, "text"), [id_col], lambda: work, {"s": ("array<long>", lambda: pa.list_(pa.int64()))})


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, most_rows: int = MOST_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row: documents link when 100 * intersection >= percent *
    union of their sets of `shingle`-word shingles; component_id is the smallest id that links reach, n_links the number
    of other documents that the row links with.

    Words are runs of anything but ASCII white space after lower-casing A-Z; a text with fewer words has its whole
    sequence as its one shingle. Null and empty texts have no shingles and link with nothing: component_id is their own
    id. An id that is null is smaller than none; repeated rows and equal texts link with each other; empty tables give
    empty results; other columns are not read. Nothing is capped, and no link is left out.

    1. One pass makes the sets. Rows of equal sets are one node, so copies are never paired with each other.
    2. The sets are cut into blocks of columns (see block_keys); nodes with a block in common are candidates. A block's
       nodes are tied to the smallest of them, which gives the components of candidates: the product of the incidence
       matrix with its transpose is zero, or too small, outside of these.
    3. The product of each component is made block by block in the tasks (see _homes and overlaps), and only what it
       comes to leaves them: a forest of its links, and how many links a node has. A family of m texts that are all
       alike costs the arithmetic of m * m pairs, but no row for a pair.

    Row and key groups are joined in parts, so that a hot one is dealt to many tasks. What a task holds is one block:
    most_rows rows or most_cells n-grams about, or one set that is larger."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = scratch.write(with_row_id(rows, "rid"), "rows")
    described = scratch.write(add_columns(rows, ["doc_id", "rid"], _described(shingle, percent), DESCRIBED), "described")
    salted = with_salt(described.where("digest is not null"), "rid")
    classes = scratch.write(salted_groups(salted, ["digest"], [F.min("rid").alias("node"), F.count("*").alias("copies")]), "classes")
    nodes = join_salted(salted, classes, ["digest"]).where("rid = node").select("node", "copies", F.col("n_shingles").alias("n"), "keys")
    nodes = scratch.write(nodes, "nodes")

    keyed = nodes.select("node", F.explode("keys").alias("rid"))
    shared = scratch.write(keyed.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"), "keys")
    near = _picked(keyed, shared)  # of the keys that only one node has, few are left
    tied = join_groups(near, ["rid"], "node", [F.min("node").alias("leader")]).where("leader < node")
    tied = scratch.write(tied.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
    candidates = connected(tied).withColumnRenamed("component", "candidate")

    placed = scratch.write(nodes.select("node", "copies", "n").join(candidates, "node").withColumnRenamed("candidate", "component"), "placed")
    wanted = placed.select(F.col("node").alias("rid"))
    texts = _picked(rows.select("rid", "text"), wanted).join(wanted.hint("merge"), "rid")
    sets = scratch.write(sets_of(texts, shingle), "sets").withColumnRenamed("rid", "node")
    product = scratch.write(blocked_product(placed, sets, percent, most_rows, most_cells), "product")
    labels = connected(product.where("b is not null").select("a", "b"))
    degrees = product.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    member = classes.join(labels, "node", "left").join(degrees, "node", "left")
    member = member.select("digest", "_salts", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_salted(with_salt(described.select("rid", "doc_id", "digest", "n_shingles"), "rid"), member, ["digest"], "left")
    out = out.select("rid", "doc_id", "n_shingles", F.coalesce("component", "rid").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = materialize(out, "joined")
    scratch.clear()
    out = join_groups(out, ["component"], "rid", [F.min("doc_id").alias("component_id")])
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
