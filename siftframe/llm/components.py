"""Connected components by union-find inside partitions and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one batch of edges at a time: each node that is not a root goes out once, with its root."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        out = [(x, find(x)) for x in parent]
        yield pd.DataFrame([(x, r) for x, r in out if x != r], columns=["a", "b"], dtype="int64")


def connected(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node long, component long): the smallest node that each node reaches.

    Each round runs union-find on the edges of every batch, which leaves at most one edge a node and batch, then
    moves each node to its smallest neighbour (an aggregate that combines before the shuffle) and renames the ends of
    the edges. Edges inside one component vanish; it ends when none is left, after a number of rounds that grows with
    the logarithm of the longest path. Nodes without edges do not appear. Nothing is collected: the driver only learns
    whether edges are left."""
    scratch = Scratch(edges.sparkSession)
    left = scratch.write(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a long, b long").distinct(), "edges")
    steps = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        up = scratch.write(up.select("a", "p"), "parents")
        steps.append(up)
        moved = left.join(up.select("a", F.col("p").alias("pa")), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        moved = moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        left = scratch.write(moved.mapInPandas(_forest, "a long, b long").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = steps[0].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for up in steps[1:]:
        up = up.select(F.col("a").alias("component"), F.col("p").alias("_next"))
        out = out.join(up, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    out = materialize(out, "components")
    scratch.clear()
    return out


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels, as connected gives them, after more edges: only the components that the new edges touch are grouped."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = connected(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    up = moved.select(F.col("node").alias("component"), F.col("component").alias("_next"))
    old = labels.join(up, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    return materialize(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "components")
