"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import SF, agree
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftframe.llm import bpe, common, components, exact_dedup, line_dedup, minhash, mixing, queries, secrets, sharding, spotsigs, textvec, token_count, toxicity
from siftframe.llm.common import global_rank

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators also use inside.
CLASH = SCHEMA + ", rid long, size long, slot int, component string, digest string, ids string, target string, copies string, page string, run int, n_dropped_lines int, _slot int"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    long = " ".join(word() for _ in range(12_000))
    texts = [None, "", "   ", "one two", "one  two", "ONE\ttwo", " ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(), long, long + " tail", "x" * 40_000, " " * 20_000 + "a" + "\n" * 20_000, "été 中文 😀 l'été don't I'll <|endoftext|> x", "a" + " " * 17_000 + "b'll" + "s" * 20_000]
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, None) for k, t in enumerate(texts)]
    return rows + [(6, " ".join(base), "en", "s1", 1), (None, "one two", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(*r, 1, 2, 3, "c", "d", "i", "t", "c", "p", 4, 77, 5) for r in odd_rows()], CLASH).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sf(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in sf(spark, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    agree(spark, queries.queries()[name], queries.oracle_sql()[name])


# --- helpers


def test_pretokens_are_those_of_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    pieces = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "  ", "\n", "\t", "1", "²", "é", "中", "!", "#", " ", "　", "😀", "\x1c", "\x85"]
    for _ in range(5_000):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert textvec.pretoken_starts(textvec.code_points(s)).tolist() == [m.start() for m in pattern.finditer(s)]


def test_shingle_sets_are_exact():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd EF".split()) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " \t", "w" * 500 + " x"]
    for t, s in zip(texts, textvec.shingle_sets(texts, 5), strict=True):
        w = t.encode().lower().split()
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_components(spark):
    rng, n = random.Random(5), 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
    half = components.connected(spark.createDataFrame(pairs[::2], "a long, b long"))
    assert {r.node: r.component for r in components.extended(half, spark.createDataFrame(pairs[1::2], "a long, b long")).collect()} == got
    assert {r.node: r.component for r in components.extended(half.limit(0), spark.createDataFrame(pairs, "a long, b long")).collect()} == got


def test_global_rank(spark):
    df = spark.createDataFrame([(f"k{k:03d}",) for k in range(100)], "key string").repartition(5)
    assert [r["rank"] for r in global_rank(df, "key", "rank").orderBy("key").collect()] == list(range(100))


# --- 1 sharding


def test_lookup_table():
    names = [f"n{k}" for k in range(10)]
    table = sharding.fill_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.1 * 1009  # slots of the shards that stay hardly move
    # Brute force: turns by preference lists that are written out.
    prefs = {k: [(sharding._number(n, "offset", 101) + j * (sharding._number(n, "skip", 100) + 1)) % 101 for j in range(101)] for k, n in enumerate(names)}
    own = [None] * 101
    while None in own:
        for k in range(10):
            free = next((s for s in prefs[k] if own[s] is None), None)
            if free is not None:
                own[free] = k
    assert own == sharding.fill_table(names, 101)
    for bad in ((names, 100), ([], 11), (["a", "a"], 11)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding_keeps_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "x", "old"), (2, 6, "y", "old")], "doc_id long, _slot int, _SLOT_ string, shard string")
    rows = sharding.assign_shards(df, F.col("doc_id"), ["a", "b"], 101)
    assert [(r._slot, r._SLOT_) for r in rows.orderBy("doc_id").collect()] == [(5, "x"), (6, "y")]
    for _ in range(2):
        sharding.write_shards(rows, str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted((r.doc_id, r.shard) for r in rows.collect())


def test_sharding(spark, docs, empty):
    shards = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(shards, 1009)
    rows = sharding.assign_shards(docs, F.col("doc_id"), shards, 1009).collect()
    assert len(rows) == docs.count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.assign_shards(empty, F.col("doc_id"), shards, 1009).count() == 0
    counts = [r["count"] for r in queries.op1_sharding(spark, SF).groupBy("shard").count().collect()]
    assert sum(counts) == sf(spark, "documents").count()


# --- 2 line dedup


def test_line_dedup(spark, docs, empty):
    rows = [(k, "h", f"menu\nbody {k}\n menu \nfoot{k % 2}") for k in range(10)] + [(10, "h", "menu"), (11, "h", None), (12, "h", ""), (13, "one", "menu\nx"), (14, None, "menu\ny")]
    df = spark.createDataFrame(rows, "id int, site string, text string")
    got = {r.id: (r.text, r.n_dropped_lines) for r in line_dedup.drop_boilerplate(df, F.col("site"), ratio=0.6, least=5).collect()}
    assert got[3] == ("body 3\nfoot1", 2)
    assert got[10] == ("menu", 0)  # a page is never emptied
    assert got[11] == (None, 0) and got[12] == ("", 0)
    assert got[13] == ("menu\nx", 0) and got[14] == ("menu\ny", 0)
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert line_dedup.drop_boilerplate(empty, F.col("source")).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(k, f"h{k % 2}", f"menu\nbody {k}\nfoot{k % 3}", 77) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, site string, text string, n_dropped_lines int")
    want = sorted(map(tuple, line_dedup.drop_boilerplate(df, F.col("site"), dropped="gone").collect()))
    assert all(r[3] == 77 for r in want) and {r[4] for r in want} == {2}
    monkeypatch.setattr(line_dedup, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df, F.col("site"), dropped="gone").collect())) == want


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_CHARS, 0])
def test_passages(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_CHARS", most)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(55)
    rows = [(k, "\n".join([text(20), passage, text(70)])) for k in range(6)]  # carried by unlike texts
    base = [text(60) for _ in range(12)]
    for k in range(40):  # near-duplicates: their own long lines stay
        lines = list(base)
        lines[rng.randrange(12)] += " edit" + str(k)
        rows.append((100 + k, "\n".join(lines)))
    rows += [(200, other + "\n" + text(9)), (201, other + "\n" + text(9)), (300, passage), (301, None), (302, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.text, r.gone) for r in line_dedup.drop_passages(df, dropped="gone").collect()}
    for k, t in rows:
        want = ("\n".join(x for x in t.split("\n") if x != passage), 1) if k < 6 else (t, 0)
        assert got[k] == want  # two carriers are too few, and no text is emptied
    out = line_dedup.drop_passages(docs)
    assert out.count() == docs.count() and out.columns == docs.columns
    assert line_dedup.drop_passages(empty).count() == 0


def test_copies_do_not_make_boilerplate(spark):
    df = spark.createDataFrame([(k, "h", "same line\nother") for k in range(50)], "id int, site string, text string")
    assert line_dedup.drop_boilerplate(df, F.col("site")).where("n_dropped_lines > 0").count() == 0


# --- 3 near duplicates


def brute_components(texts: dict):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for d in sorted(texts):
        shared = Counter(x for s in sets[d] for x in where.get(s, ()))
        for x, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[x]) - n):
                a, b = find(d), find(x)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_minhash(spark):
    want = brute_components(texts_of(spark))
    got = {r.doc_id: r for r in queries.op3_minhash(spark, SF).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_near_the_threshold(spark, tmp_path):
    """A large group whose members differ from its base by up to a third: many pairs fall just short."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    path = str(tmp_path / "g")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == brute_components(dict(rows))


def test_minhash_odd_rows(spark, docs, empty):
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[6]) == 2 and len(got[None]) == 2
    assert {got[k][0].component_id for k in (6, 7, 8, 9)} == {6}
    assert {got[k][0].component_id for k in (3, 4, 5)} == {3}
    assert got[10][0].component_id == got[11][0].component_id == 10
    assert [got[k][0].component_id for k in (0, 1, 2)] == [0, 1, 2] and got[0][0].n_shingles == 0
    assert {r.component_id for r in got[None]} == {3, None}
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and not {7, 8, 9, 4, 5, 11} & set(ids) and {0, 1, 2, 3, 10} <= set(ids) and ids[None] == 1
    assert minhash.keep_one(empty).count() == 0


def split_otherwise(spark, monkeypatch):
    """Once a table has been written, files are split otherwise, as when executors come or go."""
    key, real = "spark.sql.files.maxPartitionBytes", common._write

    def write(df, tag):
        out = real(df, tag)
        spark.conf.set(key, "256k")
        return out

    monkeypatch.setattr(common, "_write", write)
    return lambda: spark.conf.unset(key)


@pytest.fixture
def many_files(spark, tmp_path):
    path = str(tmp_path / "files")
    sf(spark, "documents").repartition(16, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_minhash_when_files_are_split_otherwise(spark, many_files, monkeypatch):
    want = brute_components(texts_of(spark))
    undo = split_otherwise(spark, monkeypatch)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(many_files).collect()}
        undo()
        kept = Counter(r.doc_id for r in minhash.keep_one(many_files).collect())
    finally:
        undo()
    assert got == want
    assert kept == Counter(d for d, (_, c) in want.items() if d == c)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(300 * share)).astype(np.uint64)
            x, y = (rng.integers(0, 2**63, 300 - len(both)).astype(np.uint64) for _ in range(2))
            a, b = np.concatenate([both, x]), np.concatenate([both, y])
            sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            errors.append((sig[0] == sig[1]).mean() - len(both) / (600 - len(both)))
        assert abs(np.mean(errors)) < 0.02
    one = minhash.superminhash(np.array([5], dtype=np.uint64), np.array([0]), 1)
    assert sorted(one[0] >> np.uint64(32)) == list(range(minhash.M))  # a single element takes each rank once


# --- 4 encoding


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark, library):
    got = {r.doc_id: r for r in queries.op4_bpe(spark, SF).collect()}
    for d, t in texts_of(spark).items():
        ids = library.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (64, 16), (50, 7)])
def test_stitching(spark, docs, empty, library, chunk, overlap):
    rows = bpe.decode(bpe.encode(docs.where("length(text) < 30000 or text is null" if chunk < 100 else "true"), RANKS, chunk=chunk, overlap=overlap), RANKS).collect()
    want = Counter()
    for d, t, *_ in odd_rows():
        if chunk >= 100 or len(t or "") < 30_000:
            want[(d, tuple(library.encode_ordinary(t or "")), (t or "").encode())] += 1
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.encode(empty, RANKS, chunk=chunk, overlap=overlap).count() == 0


def test_runs_that_the_pattern_engine_refuses(library):
    text = "a" + " " * 1_200_000 + "b"
    assert library.decode(bpe.encode_text(bpe.encoding(RANKS), text).tolist()) == text


# --- 5 secrets


def test_base_spans():
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "x", "é", ".", "\n"]
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for _ in range(3_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in p.finditer(t) if len(m.group(g)) >= n]
        assert sorted(secrets.base_spans(t)) == sorted(want)


def test_random_strings():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(9)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(50)]
    assert sum(bool(secrets.random_spans(f"é key {k} end", enc)) for k in keys) >= 48
    clean = ["d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_2", "internationalization2024now", "1" * 30, "averyveryverylongwordwithoutdigits", "https://example.com/path/to/page"]
    assert not any(secrets.random_spans(f"x {c} y", enc) for c in clean)
    ((start, _, end),) = secrets.random_spans(f"é key {keys[0]} end", enc)
    assert (start, end) == (6, 46)


def test_random_strings_of_letters():
    enc, rng = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["qWzXkPvTmLbRnSdFgHjKyUiO", *("".join(rng.choice(letters) for _ in range(rng.randint(20, 48))) for _ in range(50))]
    found = [secrets.random_spans(f"key {k} end", enc) for k in keys]
    assert found[0] == [(4, len(secrets.BASE), 4 + len(keys[0]))] and sum(map(bool, found)) >= 49
    clean = ["getElementsByClassName", "InternationalizationSupport", "thisIsAVeryLongVariableName", "=" * 40, "-_" * 12, "1234567890" * 3]
    assert not any(secrets.random_spans(f"x {c} y", enc) for c in clean)


def test_planted_keys(spark):
    """Precision and recall over documents of prose with one planted string each: keys of letters, of letters and digits, in
    base64, and strings that are no secrets."""
    import uuid

    rng, path = random.Random(21), public_tokenizers.path("byte_bpe_50k.tiktoken")
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    words = [w for t in texts_of(spark).values() for w in t.split()[:200] if w.isalpha() and w.isascii()]
    plants = [(True, pick(letters, rng.randint(20, 48))) for _ in range(100)] + [(True, pick(letters + digits, rng.randint(20, 48))) for _ in range(100)]
    plants += [(True, base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode()) for _ in range(100)]
    plants += [(False, pick("0123456789abcdef", n)) for n in (32, 40, 56, 64, 96, 128) * 10] + [(False, str(uuid.UUID(int=rng.getrandbits(128)))) for _ in range(60)]
    names = ["get", "user", "account", "name", "value", "list", "index", "config", "path", "buffer", "manager", "handler", "request", "response"]
    plants += [(False, "_".join(rng.choices(names, k=5))) for _ in range(60)] + [(False, "".join(w.title() for w in rng.choices(names, k=5))) for _ in range(60)] + [(False, pick(digits, 24)) for _ in range(60)]
    rows = [(k, " ".join([*rng.choices(words, k=30), plant, *rng.choices(words, k=30)])) for k, (_, plant) in enumerate(plants)]
    found = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "random"} for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    where = lambda k, plant: (rows[k][1].index(plant), rows[k][1].index(plant) + len(plant))
    hit = [k for k, (secret, plant) in enumerate(plants) if secret and any(a <= where(k, plant)[0] + 2 and b >= where(k, plant)[1] - 2 for a, b in found[k])]
    wrong = sum(len(v) for v in found.values()) - len(hit)
    assert len(hit) >= 0.98 * 300 and wrong <= 0.02 * 300, (len(hit), wrong)


def test_secret_rows(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert secrets.scan_secrets(docs, path).count() == docs.count()
    assert secrets.scan_secrets(empty, path).count() == 0
    (r,) = secrets.scan_secrets(spark.createDataFrame([(1, 'token = "0123456789abcdef0123456789abcdef"')], "doc_id long, text string"), path).withColumn("s", secrets.spans_text(F.col("spans"))).collect()
    assert r.s == "assign:0:41,hex:9:41"


# --- 6 exact duplicates


def test_fingerprints_compose():
    rng = random.Random(6)
    for n in (0, 1, 5, 70_000, 200_000):
        data = bytes(rng.randrange(256) for _ in range(n))
        cut = rng.randint(0, n)
        assert exact_dedup.combine(exact_dedup.hash_bytes(data[:cut]), exact_dedup.hash_bytes(data[cut:])) == exact_dedup.hash_bytes(data)
    p, b = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    h = 0
    for c in b"some text":
        h = (h * b + c + 1) % p
    assert exact_dedup.hash_bytes(b"some text")[0] == h


def test_exact_odd_rows(spark, docs, empty):
    rows = exact_dedup.exact_duplicates(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, *_ in odd_rows():
        groups.setdefault(norm(t), []).append(d)
    want = Counter((d, min((x for x in g if x is not None), default=None), len(g), sha(t.encode())) for t, g in groups.items() for d in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_when_files_are_split_otherwise(spark, many_files, monkeypatch):
    rows = [r for k in range(3) for r in many_files.withColumn("doc_id", F.col("doc_id") + 1_000_000 * k).select("doc_id", "text").collect()]
    path = f"{many_files.inputFiles()[0].rpartition('/')[0]}-3"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id").write.parquet(path)
    undo = split_otherwise(spark, monkeypatch)
    try:
        got = Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark.read.parquet(path)).collect())
    finally:
        undo()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    assert got == Counter((d, min(g), len(g)) for g in groups.values() for d in g)


def test_colliding_fingerprints_are_told_apart(spark, docs, monkeypatch):
    real = exact_dedup.fingerprints

    def weak(rows):
        return real(rows).withColumns({"n_bytes": F.lit(0).cast("long"), "h0": F.lit(0).cast("long"), "h1": F.lit(0).cast("long")})

    want = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect())
    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()) == want


# --- 7 toxicity


def test_toxicity_on_held_out_rows(spark):
    path = SF.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, path).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    pos = [rows[d].score for d, y in labels.items() if y == 1 and rows[d].held_out]
    neg = [rows[d].score for d, y in labels.items() if y == 0 and rows[d].held_out]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.8


def plain_features(text):
    """Words, and their first 4, 5 and 6 bytes, as marked strings."""
    out = set()
    for w in "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in re.sub("[A-Z]", lambda m: m.group().lower(), text)).split(" "):
        b = w.encode()
        if b:
            out |= {(0, b)} | {(k, b[:k]) if len(b) >= k else (0, b) for k in toxicity.STEMS}
    return out


def test_toxicity_refitted_by_brute_force(spark):
    """The same scores from dictionaries, an own choice of features and plain gradient steps to the same minimum."""
    path = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    model = toxicity.train(docs, labels, features=60)
    counts = {y: Counter(f for d, v in known.items() if v == y for f in plain_features(texts[d])) for y in (0, 1)}
    n1, n0 = sum(known.values()), len(known) - sum(known.values())
    gains = {}
    for f, c in counts[1].items():
        p1, p0 = (c + 0.5) / (n1 + 1), (counts[0][f] + 0.5) / (n0 + 1)
        if c >= toxicity.LEAST and p1 > 2 * p0:
            gains[f] = c * math.log(p1 / p0) + (n1 - c) * math.log((1 - p1 + 1e-9) / (1 - p0 + 1e-9))
    names = {(0, w.encode()) for pair in toxicity.IDENTITY for w in pair}
    by_gain = sorted(gains.values(), reverse=True)
    assert len(model.features) <= 60 + len(names)
    least = by_gain[59] if len(by_gain) > 59 else -1e9
    sure = {f for f, g in gains.items() if g > least + 1e-9}
    have = {x for x in model.features.tolist()}
    hashed = lambda f: int(toxicity.feature_sets([f[1].decode("utf-8", "replace")])[0][0]) if f[0] == 0 and len(f[1]) < 4 else None
    assert all(hashed(f) in have for f in sure if hashed(f) is not None)
    # The minimum of the loss on the model's own features, by another route: gradient steps on a matrix made text by text.
    place = {x: k for k, x in enumerate(model.features.tolist())}

    def vector(t):
        have = toxicity.feature_sets([t])[0].tolist()
        v = np.zeros(len(place))
        v[[place[f] for f in have if f in place]] = 1
        return v

    rows = [(y, *map(vector, toxicity.counterfactual(texts[d]))) for d, y in known.items()]
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=float)
    d = np.array([r[k] - r[2] for r in rows for k in (3, 4) if not np.array_equal(r[2], r[k])])

    def gradient(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return x.T @ (p - y) / len(y) + 2 * toxicity.RIDGE * w + 2 * toxicity.COUNTERFACTUAL * d.T @ (d @ w) / len(d), (p - y).mean()

    gw, gb = gradient(model.weights, model.bias)
    assert np.abs(gw).max() < 1e-5 and abs(gb) < 1e-5
    for t in list(texts.values())[:50]:
        assert abs(model.scores([t])[0] - 1 / (1 + math.exp(-(vector(t) @ model.weights + model.bias)))) < 1e-9


def test_counterfactuals():
    assert toxicity.counterfactual("The Woman is gay.") == ("The Woman is gay.", "The Woman is gay.", "the man is straight", "the is")
    swaps, learned = toxicity._swaps(), 0
    for k in range(300):
        text = f"Words, {k} of no group"
        one, a, b, bare = toxicity.counterfactual(text)
        x, y = (set(t.encode().split()) - {w.encode() for w in ("words", str(k), "of", "no", "group")} for t in (a, b))
        assert len(x) == len(y) == 1 and swaps[x.pop()] in y
        assert one in (text, a) and bare == text and len(a.split()) == len(b.split()) == 6
        learned += one == a
    assert 100 < learned < 200 and toxicity.counterfactual("")[1] in {w for pair in toxicity.IDENTITY for w in pair}


def test_penalty_acts_end_to_end(spark):
    """Insults that mostly name one group: without the penalty a neutral mention of it is taken for toxic."""
    rng = random.Random(13)
    plain = "we met at the market and spoke about the weather then walked home to cook dinner for our friends".split()
    rows, labels = [], []
    for k in range(1_600):
        w, toxic = [rng.choice(plain) for _ in range(12)], k % 4 == 0
        if toxic:
            w[3] = "scumbag" if rng.random() < 0.8 else w[3]
        if rng.random() < (0.9 if toxic else 0.02):
            w[6] = "muslim"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    change, mention = {}, {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(docs, marks, penalty=penalty)
        neutral = [" ".join([*[rng.choice(plain) for _ in range(8)]]) for _ in range(50)]
        a, b = model.scores([t + " muslim" for t in neutral]), model.scores([t + " christian" for t in neutral])
        change[penalty], mention[penalty] = np.abs(a - b).mean(), (a >= toxicity.THRESHOLD).mean()
        assert model.scores(["you scumbag"])[0] > 0.5
    assert change[toxicity.COUNTERFACTUAL] < 0.1 * change[0.0] and change[0.0] > 0.2
    assert mention[0.0] > 0.9 and mention[toxicity.COUNTERFACTUAL] == 0


def test_counterfactual_penalty():
    """A word that only stands for an identity loses its weight."""
    rng = np.random.default_rng(2)
    insult, group = rng.random(2000) < 0.3, rng.random(2000) < 0.3
    group |= insult & (rng.random(2000) < 0.8)  # insults name the group more often than not
    x, y = np.stack([insult, group], axis=1).astype(np.float32), (insult & (rng.random(2000) < 0.95)).astype(float)
    d = np.tile([[0.0, -1.0]], (int(group.sum()), 1))
    plain, _ = toxicity.fit_weights(x, y, np.zeros((0, 2)), ridge=1e-3)
    fair, bias = toxicity.fit_weights(x, y, d, ridge=1e-3, penalty=50)
    assert abs(fair[1]) < 0.2 * max(0.2, abs(plain[1])) and fair[0] > 2
    assert 1 / (1 + np.exp(-(bias + fair[1]))) < 0.3  # a neutral mention is not toxic
    assert toxicity.swap_identities("The Woman is gay.") == "the man is straight"


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([(k, "you idiot fool" if k % 2 else "nice day today") for k in range(40)], "doc_id long, text string")
    model = toxicity.train(train, labels)
    s = model.scores(["an IDIOT, a fool!", "a nice day", ""])
    assert s[0] > 0.5 > s[1] and s[2] == model.scores([""])[0]
    out = toxicity.reject_toxic(docs, model)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert toxicity.score(empty, model, keep=["doc_id"]).count() == 0
    none = toxicity.train(train, labels.limit(0))
    assert not len(none.features) and none.scores(["x"])[0] <= 0.5


# --- 8 mixing


def test_mixing_odd_rows(spark, docs, empty):
    out = mixing.mix_counts(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_reaches_its_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), (F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 5)).cast("string")).alias("source"))
    rows = mixing.mix_counts(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    for r in rows:
        assert abs(r.taken - r.target) < 0.05 * r.target and r.target <= 3 * r["size"]


# --- 9 token counts


def test_token_counts(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, SF).collect()}
    for d, text in texts_of(spark).items():
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(text.encode()), want(text), want(text) > 512)
    rows = token_count.count_tokens(docs, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter((d, len((x or "").encode()), want(x or "")) for d, x, *_ in odd_rows())
    assert token_count.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("long", [0, 400])
def test_token_counts_by_pieces(spark, docs, empty, long):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    word = lambda: rng.choice(["don't", " ", "\n\n  ", "<|endoftext|>", "<|endof", "text|>", "été", "中文", "😀", "12345", "hello", "  x", "!!", "'ll", "w" * 30])
    texts = ["".join(word() for _ in range(rng.randint(0, 900))) for _ in range(25)] + ["<|endoftext|>" * 90, "z" * 3_000]
    more = spark.createDataFrame([(100 + k, x) for k, x in enumerate(texts)] * 2, "doc_id long, text string")
    rows = token_count.count_tokens(docs.select("doc_id", "text").unionByName(more), path, long=long, chunk=120, overlap=40).collect()
    every = [(d, x or "") for d, x, *_ in odd_rows()] + [(100 + k, x) for k, x in enumerate(texts)] * 2
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter((d, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for d, x in every)
    assert token_count.count_tokens(empty, path, long=long).count() == 0


# --- 10 fingerprints


def test_spotsigs(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op10_spotsigs(spark, SF).collect()}
    prints = {}
    for k, d in enumerate(ids):
        t, follower = texts[d], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        assert got[d].edited_sha256 == sha((t[: len(t) - cut] + follower[:cut]).encode()) and got[d].n_chars == len(t)
        prints.setdefault(t, set()).add(got[d].fingerprint)
        a, b, c = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (got[d].fingerprint, got[d].edited_fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(got[d].near_edited - jaccard(a, b)) < 1e-9 and abs(got[d].near_next - jaccard(a, c)) < 1e-9
    assert all(len(p) == 1 for p in prints.values())
    mean = lambda c: np.mean([getattr(r, c) for r in got.values()])
    assert mean("near_edited") > 0.45 and mean("near_next") < 0.1


def plain_signatures(text):
    """Chains written out word by word: an anchor (or any word that is a multiple of GAP words after the last anchor) and
    the content words that follow it."""
    common = {w for ws in spotsigs.ANCHORS.values() for w in ws.split()}
    w = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")).split(" ")
    w, out, last = [x for x in w if x], set(), -1
    for k, x in enumerate(w):
        last = k if x in common else last
        if x in common or (k - last) % spotsigs.GAP == 0:
            chain = [y for y in w[k + 1 :] if y not in common][: spotsigs.CHAIN]
            if chain:
                out.add((x, *chain))
    return out or ({tuple(w)} if w else set())


def test_signatures_are_the_chains(spark):
    texts = [t for _, t in sorted(texts_of(spark).items())] + ["the of a", "", "of the table", "one two three"]
    sets, plain = spotsigs._signature_sets(texts), [plain_signatures(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for k in range(len(texts) - 1):
        assert len(np.intersect1d(sets[k], sets[k + 1])) == len(plain[k] & plain[k + 1])


def test_the_driver_gets_a_bounded_number_of_keys(spark, docs, monkeypatch):
    want = Counter((r.doc_id, r.text, r.edited) for r in spotsigs.compare_neighbours(docs, run_bytes=1).collect())
    monkeypatch.setattr(spotsigs, "MOST_RUNS", 3)
    found, real = [], spotsigs._cut_keys
    monkeypatch.setattr(spotsigs, "_cut_keys", lambda *a: found.append(real(*a)) or found[-1])
    assert Counter((r.doc_id, r.text, r.edited) for r in spotsigs.compare_neighbours(docs, run_bytes=1).collect()) == want
    assert 1 < len(found[0]) <= 3


@pytest.mark.parametrize("overlap", [0, 3, 10, 25])
def test_chunks_of_a_text(spark, overlap):
    rng = random.Random(9)
    texts = ["", "a", "x" * 10, "y" * 11, *("".join(rng.choice("aé中😀\n \r") for _ in range(rng.randint(1, 90))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for k, got in df.select("k", common.cut_text(F.col("t"), 10, overlap)).collect():
        assert got == [texts[k][i : i + 10 + overlap] for i in range(0, max(1, len(texts[k])), 10)]


@pytest.mark.parametrize("run", [spotsigs.RUN_BYTES, 5_000, 1])
def test_neighbours(spark, docs, empty, run):
    edit = lambda t, f: t[: len(t) - len(t) // 4] + f[: len(t) // 4]
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in spotsigs.compare_neighbours(one, run_bytes=run).collect()}
    ids = sorted(rows)
    assert len(ids) == one.count()
    for k, d in enumerate(ids):
        after = rows[ids[(k + 1) % len(ids)]]
        assert rows[d].edited == edit(rows[d].text, after.text) and rows[d].follower == after.own
    got = Counter((r.doc_id, r.text) for r in spotsigs.compare_neighbours(docs, run_bytes=run).collect())
    assert got == Counter((d, t or "") for d, t, *_ in odd_rows())
    assert spotsigs.compare_neighbours(empty, run_bytes=run).count() == 0
    (alone,) = spotsigs.compare_neighbours(spark.createDataFrame([(7, "of the big table")], "doc_id long, text string"), run_bytes=run).collect()
    assert alone.edited == edit("of the big table", "of the big table") and alone.follower == alone.own


def test_equal_rows_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "COPIES", 7)
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice(["the", "of", "and", "house", "river", "tree", "stone"]) for _ in range(rng.randint(0, 30)))
    rows = [(k // 2, sentence()) for k in range(60)] + [(9, "the old house of stone")] * 61 + [(None, None)] * 30 + [(0, "")] * 8 + [(70, sentence())] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    edit = lambda t, f: t[: len(t) - len(t) // 4] + f[: len(t) // 4]
    want = Counter((d, t, edit(t, f)) for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True))
    for run in (spotsigs.RUN_BYTES, 200):
        got = spotsigs.compare_neighbours(frame, run_bytes=run)
        assert got.columns == ["doc_id", "text", "edited", "own", "other", "follower"]
        assert Counter((r.doc_id, r.text, r.edited) for r in got.collect()) == want


def test_word_hashes_of_long_texts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", "-", " ", "\n", "\x1c", "　", "😀"]) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["", " ", "x" * 90]
    for table in (textvec.LOWER, textvec.LOWER_ALNUM):
        monkeypatch.setattr(textvec, "PIECE", 1 << 20)
        h, n = textvec.word_hashes(texts, table)
        monkeypatch.setattr(textvec, "PIECE", 13)
        h2, n2 = textvec.word_hashes(texts, table)
        assert h.tolist() == h2.tolist() and n.tolist() == n2.tolist()


def test_alike_is_jaccard_at_the_threshold(spark):
    rng = random.Random(12)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 50))) for _ in range(60)] + [list(range(n)) for n in (3, 4, 40, 30, 8, 6)]
    pairs = [(x, y) for x in sets for y in sets]
    rows = spark.createDataFrame(pairs, "x array<long>, y array<long>").select("x", "y", spotsigs.alike(F.col("x"), F.col("y")).alias("a")).collect()
    for r in rows:
        x, y = set(r.x), set(r.y)
        assert r.a == (4 * len(x & y) >= 3 * len(x | y))


def test_similar_pairs(spark):
    rng = random.Random(8)
    names = spotsigs.ANCHORS["en"].split()
    word = lambda: rng.choice(names) if rng.random() < 0.4 else "".join(rng.choice("abcdefg") for _ in range(6))
    rows = []
    for k in range(12):
        base = [word() for _ in range(100)]
        for j in range(4):
            w = list(base)
            for _ in range(j * 3):
                w[rng.randrange(100)] = word()
            rows.append((k * 10 + j, " ".join(w)))
    sets = dict(zip([d for d, _ in rows], [set(s.tolist()) for s in spotsigs._signature_sets([t for _, t in rows])], strict=True))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()}
    assert want and got == want
