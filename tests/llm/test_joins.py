"""The n-gram join, clustering by bit planes and the filter audit against brute force, and on odd rows; families of pages
that fall just short of a threshold."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from inverted_index import grouped, links_of
from oracle import SF
from pyspark.sql import functions as F
from test_operators import docs, empty, odd_rows, sf, texts_of  # noqa: F401

from siftframe.llm import bitplanes, common, filter_audit, jaccard_join, minhash, queries
from siftframe.llm.textvec import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 n-gram join


def brute_join(texts: dict, size=3, percent=90) -> dict:
    """{id: (set size, component, links)} by comparing all pairs of word sets."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = list(texts)
    links = [[] for _ in ids]
    for a, b in itertools.combinations(range(len(ids)), 2):
        x, y = sets[ids[a]], sets[ids[b]]
        both = len(x & y)
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            links[a].append(b)
            links[b].append(a)
    return {d: (len(sets[d]), *got) for d, got in grouped(ids, links).items()}


def joined(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df, **kw).collect()}


def family(n, edits, words=150, seed=7, copies=0):
    """Texts of one template in which some words are other ones; the last ones are copies of the first."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(words)], []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), edits(rng)):
            w[at] = word()
        rows.append((k, " ".join(w)))
    return rows + [(n + k, rows[k][1].upper()) for k in range(copies)]


@pytest.fixture
def written(spark, tmp_path):
    def write(rows):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
        return spark.read.parquet(path)

    return write


def test_join(spark):
    want = brute_join(texts_of(spark))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in queries.op11_jaccard_join(spark, SF).collect()}
    assert got == want and sum(n for _, _, n in want.values()) > 0


@pytest.mark.parametrize("most_rows", [1_024, 7])
def test_join_of_a_family(written, most_rows):
    """Many pairs at and around the threshold, in one block and in many; copies are links of their own."""
    rows = family(90, lambda rng: rng.randint(0, 4), copies=5)
    want = brute_join(dict(rows))
    assert joined(written(rows), most_rows=most_rows) == want
    assert 10 < sum(n for _, _, n in want.values()) / len(rows) < 94


def test_join_across_size_classes(written):
    """Texts that grow word by word, so that links cross the classes of sizes; and short ones, whose blocks are weak."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:n])) for k, n in enumerate([*range(1, 60), *range(60, 400, 7)])]
    want = brute_join(dict(rows))
    assert joined(written(rows), most_rows=5) == joined(written(rows)) == want
    assert joined(written(rows), percent=70) == brute_join(dict(rows), percent=70)


def test_join_odd_rows(docs, empty):  # noqa: F811
    got = defaultdict(list)
    for r in jaccard_join.jaccard_join(docs).collect():
        got[r.doc_id].append(r)
    plain = [(k, r[0], r[1]) for k, r in enumerate(odd_rows())]
    want = brute_join({k: t for k, _, t in plain})
    for k, d, _ in plain:
        n, component, links = want[k]
        ids = [x for j, x, _ in plain if want[j][1] == component and x is not None]
        assert (n, min(ids, default=None), links) in {(r.n_shingles, r.component_id, r.n_links) for r in got[d]}
    assert len(got[6]) == 2 and got[0][0].n_shingles == 0 and got[0][0].n_links == 0
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (90, 75):
        for n in [*range(1, 40), 77, 150, 400, 3_000]:
            for _ in range(20 if n < 400 else 4):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                out = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
                b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, int(rng.integers(0, out + 2))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    keys = [set(jaccard_join.block_keys(x, percent).tolist()) for x in (a, b)]
                    assert keys[0] & keys[1]


def test_product_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(100, 10_000, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    got = jaccard_join.overlaps(sets, sets[::2], 75)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[::2]):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 75 * (len(a) + len(b) - both))


def counted(monkeypatch):
    """Rows of every table that an operator writes for itself, by its tag."""
    rows, real = Counter(), common._write

    def write(df, tag):
        path = real(df, tag)
        rows[tag] += df.sparkSession.read.schema(df.schema).parquet(path).count()
        return path

    monkeypatch.setattr(common, "_write", write)
    return rows


def test_a_family_just_short_of_the_threshold_makes_no_pairs(written, monkeypatch):
    """Pages of a template of 104 words with two words edited each: similarity two thirds. What op3 writes grows with the
    family and not with its square."""
    made = {}
    for n in (60, 120, 240):
        rows = counted(monkeypatch)
        out = {r.doc_id: r.component_id for r in minhash.near_duplicates(written(family(n, lambda rng: 2, words=104, seed=n))).collect()}
        made[n] = sum(rows.values())
        monkeypatch.undo()
        if n == 60:
            assert out == {d: c for d, (_, c, _) in brute_join(dict(family(n, lambda rng: 2, words=104, seed=n)), 5, 75).items()}
    assert made[240] < 2.6 * made[120] < 2.6 * 2.6 * made[60]


@pytest.mark.parametrize("seed", [1, 2])
def test_open_buckets_are_verified_exactly(written, seed, monkeypatch):
    """Two families that meet in a few members, with blocks of a few rows: rows that are settled and others."""
    monkeypatch.setattr(jaccard_join, "MOST_ROWS", 4)
    monkeypatch.setattr(jaccard_join.blocked_product, "__defaults__", (4, 1 << 20))
    rows = family(120, lambda rng: rng.choice([0, 1, 3, 5, 6, 7]), seed=seed)
    sets = shingle_sets([t for _, t in rows], 5)
    want = grouped([d for d, _ in rows], links_of(sets, 75))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(written(rows)).collect()} == {d: c for d, (c, _) in want.items()}


# --- 12 bit planes


def brute_clusters(rows, k=16, rounds=3):
    vectors = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(vectors, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in first]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in vectors:
            of[near(v)[1]].append(v)
        centres = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in vectors]
    own = Counter()
    for _, j, d in found:
        own[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, own[j], sum(own.values()), name[j]) for i, j, d in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, v int, planes string, norm int, cluster string"


def clusters(df, **kw):
    return sorted((tuple(r) for r in bitplanes.cluster_vectors(df, **kw).collect()), key=repr)


def test_clusters(spark):
    rows = [(r.vec_id, r.embedding) for r in sf(spark, "embeddings").collect()]
    assert sorted((tuple(r) for r in queries.op12_bit_planes(spark, SF).collect()), key=repr) == brute_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(6)
    some = lambda s=1.0: [rng.uniform(-s, s) for _ in range(64)]
    good = [(k, some(rng.choice([0.01, 1.0, 900.0]))) for k in range(40)] + [(None, some()), (None, some()), (7, some()), (3, [0.5] * 64), (3, [0.5] * 64), (50, [0.0] * 64), (51, [-1.0] * 64)]
    bad = [(60, None), (61, []), (62, [0.1] * 63), (63, [0.1] * 65), (64, [None] + [0.1] * 63), (65, [float("nan")] + [0.1] * 63), (66, [float("inf")] * 64), (67, [float("-inf")] + [0.0] * 63)]
    frame = lambda rows: spark.createDataFrame([(i, v, 1, 2, "p", 3, "c") for i, v in rows], VECTORS).repartition(3)
    want = brute_clusters(good)
    assert clusters(frame(good + bad)) == want
    assert clusters(frame(bad)) == [] and clusters(frame([])) == []
    assert clusters(frame(good[:3])) == brute_clusters(good[:3])  # fewer than there are clusters
    assert {r[2] for r in clusters(frame([(1, [0.25] * 64)] * 9))} == {0}
    with pytest.raises(ValueError):
        clusters(frame([*good, (99, [3e30] * 64)]))


def test_planes_give_exact_distances():
    rng = np.random.default_rng(8)
    for most in (1, 3, 100, 2**26):
        x, c = rng.integers(-most, most, (50, 64)), rng.integers(-most, most, (5, 64))
        planes = int(most).bit_length() + 1
        packed = bitplanes.pack(x, planes)
        assert (bitplanes.unpack(packed) == x).all()
        got = bitplanes.distances(packed, (x * x).sum(axis=1), c, planes)
        assert (got == ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)).all()


# --- 13 filter audit


def brute_audit(rows, labels):
    """rows of (doc_id, text, source), labels of (doc_id, quality, toxic)."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = {}
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d,
        }
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                row = out.setdefault((s or "", "".join(order), k + 1), Counter())
                if fails[f]:
                    row["redundant" if gone else "removed"] += 1
                    row["unique_fails"] += sum(fails.values()) == 1
                    row["good_lost"] += not gone and d in good
                    row["toxic_lost"] += not gone and d in toxic
                gone = gone or fails[f]
                row["kept"] += not gone
    sums = Counter()
    for (s, order, k), row in out.items():
        sums[s, order[k - 1]] += row["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {key: (*(row[n] for n in names), sums[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def audited(df, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filter_audit.filter_audit(df, labels).collect()}


def test_audit(spark):
    rows = [(r.doc_id, r.text, r.source) for r in sf(spark, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in sf(spark, "labels").collect()]
    want = brute_audit(rows, labels)
    out = queries.op13_filter_audit(spark, SF)
    assert {(r["part"], r["filter_order"], r["step"]): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()} == want
    assert len(want) == 600 * len({s or "" for _, _, s in rows}) and dict(out.dtypes)["step"] == "int"


def test_audit_odd_rows(spark, docs, empty):  # noqa: F811
    rows = [(d, t, s) for d, t, _, s, _ in odd_rows()]
    labels = [(6, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (3, None, None), (10, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs, frame) == brute_audit(rows, labels)
    assert audited(docs, None) == brute_audit(rows, [])
    assert audited(docs, frame.limit(0)) == brute_audit(rows, [])
    assert audited(empty, frame) == {}


def test_words_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "B", "é", "\x0b", " ", "\n", "\x1c", "　", "😀"]) for _ in range(4_000))
    monkeypatch.setattr(filter_audit, "PIECE", 17)
    w = WORD.findall(text)
    assert filter_audit.word_counts(text) == (len(w), len(set(w))) and filter_audit.word_counts("") == (0, 0)
