"""Near-duplicates by an inverted index, without Spark: what op3 and op11 are held against.

python tests/llm/inverted_index.py [folder, default /root/testdata/sf0.1] compares both with all documents of a folder."""

from __future__ import annotations

import os
import sys
from collections import defaultdict

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def links_of(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """The sets that each set links with, by the rarest shingles first: two that link share one of the first
    n - ceil(n * percent / 100) + 1 of each."""
    values, df = np.unique(np.concatenate(sets), return_counts=True)
    links, lists = [[] for _ in sets], defaultdict(list)
    for k, s in enumerate(sets):
        n = len(s)
        if not n:
            continue
        order = np.lexsort((s, df[np.searchsorted(values, s)]))
        first = s[order][: n + (-percent * n // 100) + 1].tolist()
        for j in {j for x in first for j in lists[x]}:
            m, both = len(sets[j]), len(np.intersect1d(sets[j], s, assume_unique=True))
            if 100 * both >= percent * (n + m - both):
                links[j].append(k)
                links[k].append(j)
        for x in first:
            lists[x].append(k)
    return links


def grouped(ids: list, links: list[list[int]]) -> dict:
    """{id: (smallest id that links reach, number of links)}; ids are distinct."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, near in enumerate(links):
        for j in near:
            a, b = find(j), find(k)
            parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(i, least.get(r, i))
    return {i: (least[find(k)], len(links[k])) for k, i in enumerate(ids)}


def main(folder: str) -> int:
    import tempfile

    from pyspark.sql import SparkSession

    from siftframe.llm import jaccard_join, minhash
    from siftframe.llm.textvec import shingle_sets

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "10g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs, bad = spark.read.parquet(f"{folder}/documents.parquet"), 0
    rows = docs.select("doc_id", "text").collect()
    for name, size, percent, got in (
        ("op3", 5, 75, {r.doc_id: (r.component_id, None) for r in minhash.near_duplicates(docs).collect()}),
        ("op11", 3, 90, {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}),
    ):
        links = links_of(shingle_sets([r.text or "" for r in rows], size), percent)
        want = grouped([r.doc_id for r in rows], links)
        wrong = [i for i, (c, n) in want.items() if got[i][0] != c or got[i][1] not in (None, n)]
        print(f"{name}: {len(rows)} documents, {sum(map(len, links)) // 2} links, {len(wrong)} documents wrong")
        bad += len(wrong)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(*(sys.argv[1:] or ["/root/testdata/sf0.1"])))
