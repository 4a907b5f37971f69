"""The pipeline stage by stage against plain versions, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from oracle import SF
from pyspark.sql import functions as F
from test_operators import CLASH, brute_components, odd_rows

from siftframe.llm import mixing, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "bpe"]


def plain_lines(rows, ratio, least, words=50, carriers=3):
    """{doc_id: text} without frequent lines of the source, then without passages of unlike texts."""
    trim = lambda t: [x.strip(" ") for x in (t or "").split("\n")]

    def without(text, gone):
        rest = [x for x in (text or "").split("\n") if x.strip(" ") not in gone]
        return "\n".join(rest) if any(x.strip(" ") for x in rest) else text

    pages = {}
    for r in rows:
        pages.setdefault(r.source, set()).add(r.text or "")
    freq = {s: Counter(line for t in ts for line in {x for x in trim(t) if x}) for s, ts in pages.items()}
    texts = {r.doc_id: without(r.text, {x for x, n in freq[r.source].items() if n >= least and n > ratio * len(pages[r.source])}) for r in rows}
    on, spark = {}, rows[0]._spark_hash
    for t in {t or "" for t in texts.values()}:
        low = sorted({spark[x] for x in trim(t) if x})[:2] + [0]
        for x in {x for x in trim(t) if len(re.split(" +", x)) >= words}:
            on.setdefault(x, []).append((t, low[0] if low[0] != spark[x] else low[1]))
    bad = {x for x, at in on.items() if len({r for _, r in at}) >= carriers and 2 * len({r for _, r in at}) > len({t for t, _ in at})}
    return {d: without(t, bad) for d, t in texts.items()}


class Row:
    def __init__(self, row, hashes):
        self.doc_id, self.source, self.text, self._spark_hash = row.doc_id, row.source, row.text, hashes


def with_hashes(spark, rows, texts):
    """Rows that know Spark's hash of each line, which decides what counts as unlike."""
    every = {x.strip(" ") for t in texts for x in (t or "").split("\n")}
    hashes = {r.x: r.h for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    return [Row(r, hashes) for r in rows]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, out = docs.columns, [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(out.count())
        if k < 4:
            assert out.columns == columns
        if k == 0:
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in before.collect() if plain_score(model, r.text or "") < toxicity.THRESHOLD}
            assert {r.doc_id for r in out.collect()} == want
        if k == 1:
            rows = before.collect()
            # Lines that are cut in the first pass are hashed from the texts it leaves; all lines are among the first ones.
            want = plain_lines(with_hashes(spark, rows, [r.text for r in rows]), corpus_pipeline.LINE_RATIO, corpus_pipeline.LINE_LEAST)
            got = {r.doc_id: r for r in out.collect()}
            assert {d: r.text for d, r in got.items()} == want
            assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None and r.text != {x.doc_id: x.text for x in rows}[r.doc_id])
        if k == 2:
            groups = brute_components({r.doc_id: r.text for r in before.collect()})
            assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in groups.items() if d == c}
        if k == 3:
            want = plain_mix(before.collect())
            assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for d, n in want.items() if n})
        if k == 4:
            texts = {r.doc_id: r.text or "" for r in before.collect()}
            assert out.count() == before.count()
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out.collect())
    assert 0.8 * docs.count() < kept[0] < docs.count() and kept[2] < kept[1]


def plain_score(model, text):
    """The score of one text by its words and their beginnings, one at a time."""
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + math.exp(-(sum(weights.get(int(f), 0.0) for f in toxicity.feature_sets([text])[0]) + model.bias)))


def plain_mix(rows):
    """{doc_id: copies}: targets by exact fractions, then one draw a document."""
    sizes, by = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}, {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + sizes[r.doc_id]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(by.values()) - sum(3 * by[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * left > 3 * by[s] * share}
        if not over:
            break
        capped |= over
    rate = {s: 0.0 if not by[s] else (3.0 * by[s] if s in capped else float(weight[s] * left) / float(share)) / by[s] for s in order}
    draw = lambda d: float(int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:12], 16)) / float(1 << 48)
    return {r.doc_id: int(rate[r.source]) + (draw(r.doc_id) < rate[r.source] - int(rate[r.source])) for r in rows}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and set(out.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, 1, 2, 3, "c", "d", "i", "t", "c", "p", 4, 77, 5) for r in odd_rows()], CLASH).write.parquet(path)
    for table in (spark.read.parquet(path), spark.read.parquet(path).limit(0)):
        out = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, SF)
            target = str(tmp_path / f"{table.isEmpty()}-{k}")
            out.write.parquet(target)
            out = spark.read.parquet(target)
            if k < 4:
                assert out.columns == table.columns
                assert out.where("n_dropped_lines <> 77 or slot <> 3 or size <> 2").isEmpty()
