"""Centroid clustering of integer vectors by bit planes: distances are weighted popcounts of planes that are and-ed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components of a vector: bits of a packed plane.
DIM = 64
#: Clusters, rounds that move centroids, and what a component is multiplied by before it is cut to an integer.
CLUSTERS, ROUNDS, SCALE = 16, 3, 64
#: Components are under 2 ** MOST_BITS in size, so that every distance fits a long.
MOST_BITS = 27
#: Vectors that are compared with all centroids at once.
BLOCK = 4_096


class Centroids(NamedTuple):
    """The final centroids, `planes` wide, and the packed vectors (vec_id, planes, norm) that they come from."""

    values: np.ndarray
    packed: DataFrame
    planes: int


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """Integers (n x 64) to n x planes uint64: bit d of plane p is bit p of component d in two's complement."""
    bits = (x.astype(np.int64)[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(packed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(packed)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return (bits.astype(np.int64) * weights(packed.shape[1])[None, :, None]).sum(axis=1)


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane is worth; the last plane is the sign."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def distances(packed: np.ndarray, norms: np.ndarray, centroids: np.ndarray, planes: int) -> np.ndarray:
    """Exact squared distances (n x k): the two norms less twice the dot product, which is the sum over all pairs of a
    vector's plane and a centroid's plane of the popcount of both, times the worth of both planes."""
    own, w = pack(centroids, planes), weights(planes)
    dot = np.zeros((len(packed), len(centroids)), dtype=np.int64)
    for i in range(planes):
        part = np.zeros_like(dot)
        for j in range(planes):
            part += w[j] * np.bitwise_count(packed[:, i, None] & own[None, :, j]).astype(np.int64)
        dot += w[i] * part
    return norms[:, None] + (centroids.astype(np.int64) ** 2).sum(axis=1)[None, :] - 2 * dot


def nearest(packed: np.ndarray, norms: np.ndarray, centroids: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, distance) of each vector; of equally near ones the smaller number."""
    d = distances(packed, norms, centroids, planes)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the components of those vectors that have DIM of them, all finite."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIM) & finite)
    # Beyond long, floor saturates, which the check of sizes then refuses.
    big = lambda c: F.greatest(F.least(F.floor(c * float(scale)).cast("double"), F.lit(2.0**62)), F.lit(-(2.0**62)))
    return rows.select("vec_id", F.transform("x", lambda c: big(c).cast("long")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], planes: int):
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            flat = batch.column("planes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch, flat.reshape(-1, planes), batch.column("norm").to_numpy(zero_copy_only=False)


def packed_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, planes array<long>, norm), written, and how many planes the largest component needs."""
    size = vectors.select(F.array_max("v").alias("hi"), F.array_min("v").alias("lo")).agg(F.max("hi"), F.min("lo")).first()
    hi, lo = max(0, size[0] or 0), min(0, size[1] or 0)
    if max(hi, -lo - 1) >= 1 << MOST_BITS:
        raise ValueError(f"a scaled component is {max(hi, -lo)}; from 2 ** {MOST_BITS} on, distances do not fit a long")
    planes = max(hi.bit_length(), (-lo - 1).bit_length() if lo else 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
                flat = pa.array(pack(v, planes).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, planes, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists, pa.array((v * v).sum(axis=1))], names=["vec_id", "planes", "norm"])

    return materialize(vectors.mapInArrow(run, "vec_id long, planes array<long>, norm long"), "planes"), planes


def _sums(centroids: np.ndarray, planes: int):
    """One task's vectors to one row for each cluster and component: the sum of the cluster's vectors, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, n = np.zeros((k, DIM), dtype=object), np.zeros(k, dtype=np.int64)
        for _, packed, norms in _blocks(batches, planes):
            at, _ = nearest(packed, norms, centroids, planes)
            part = np.zeros((k, DIM), dtype=np.int64)
            np.add.at(part, at, unpack(packed))
            total, n = total + part, n + np.bincount(at, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, DIM)), pa.array(np.tile(np.arange(DIM), len(used))), pa.array([str(x) for x in total[used].reshape(-1)], pa.string()), pa.array(np.repeat(n[used], DIM))],
            names=["cluster", "place", "total", "n"],
        )

    return run


def fit(df: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """Centroids after `rounds` of assigning every vector and moving each centroid to the floor of its vectors' mean.

    They start as the vectors with the smallest sha256 of "1:<id>"; ids that are null come last, equal ids by their
    components. The driver gets `clusters` vectors, and after each round one row for each cluster and component."""
    vectors = integer_vectors(df, id_col, vector_col)
    packed, planes = packed_vectors(vectors)
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    values = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, DIM)
    for _ in range(rounds if len(values) else 0):
        sums = packed.mapInArrow(_sums(values, planes), "cluster long, place long, total string, n long")
        moved = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        values = values.copy()
        for r in moved:
            values[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return Centroids(values, packed, planes)


def assign(model: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every packed vector."""
    values, _, planes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, packed, norms in _blocks(batches, planes):
            at, d = nearest(packed, norms, values, planes)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    rows = model.packed if len(values) else model.packed.limit(0)
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(df: DataFrame, **kw) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that has DIM components,
    none null, NaN or infinite; others do not appear.

    Components become floor(SCALE * x) and are packed once: bit plane p of the 64 components is one 64-bit number. Dot
    products, and so distances, are exact sums of popcounts. What is scaled to 2 ** 27 or more raises an error, since
    its distances do not fit a long. Rows with a null id, and repeated rows, are vectors of their own; equally near
    centroids: the smaller number. Fewer vectors than clusters give as many clusters as there are; an empty table gives
    an empty result; other columns are not read. Inertias are summed as decimals, and are null where they do not fit a
    long. Broadcast is one row a cluster."""
    model = fit(df, **kw)
    spark = df.sparkSession
    out = materialize(assign(model), "assigned")
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(model.values)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    by = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = by.agg(F.sum("own").alias("all"))
    whole = by.join(F.broadcast(names), "cluster").join(F.broadcast(total))
    fitted = lambda c: F.expr(f"try_cast({c} as bigint)")
    sums = whole.select("cluster", fitted("own").alias("cluster_inertia"), fitted("`all`").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
