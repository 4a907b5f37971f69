"""Streams: late rows, restarts, reruns, state that expires, and what a batch would give."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftframe.streaming import streams

START = datetime.datetime(2026, 1, 1)
SCHEMA = "event_id long, ts timestamp, key string, ok boolean, kind string, duration_ms double"


def at(seconds: int) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def source(spark, tmp_path):
    """(add rows as a new file, a stream of them that takes a file at a time)."""
    path = str(tmp_path / "in")

    def add(*rows):
        full = [(k, at(s), key, ok, kind, ms) for k, s, key, ok, kind, ms in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return add, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def fail(k, s, key="a"):
    return (k, s, key, False, "dead", 1.0)


def test_breaker_over_restarts_with_late_rows(source, tmp_path):
    add, stream = source
    path, metrics = str(tmp_path / "out"), {}
    add(fail(1, 0), fail(2, 10))
    assert streams.run_available(streams.stream_breaker(stream()), path).count() == 0
    add(fail(3, 20))
    first = streams.run_available(streams.stream_breaker(stream()), path).collect()
    assert [(r.state, r.streak, r.ts) for r in first] == [("open", 3, at(20))]
    add((4, 5, "a", True, "x", 1.0), (5, 30, "a", True, "x", 1.0))  # one late row, one that closes
    out = streams.run_available(streams.stream_breaker(stream()), path, metrics=metrics).orderBy("ts", "state").collect()
    assert [(r.state, r.dropped_late) for r in out] == [("open", 0), ("closed", 1)]
    add((6, 100_000, "b", True, "x", 1.0))
    streams.run_available(streams.stream_breaker(stream()), path, metrics=metrics)
    add(fail(7, 200, "b"), (8, 100_001, "b", True, "x", 1.0))  # far behind the watermark
    streams.run_available(streams.stream_breaker(stream()), path, metrics=metrics)
    assert metrics["dropped_late"] == 1


def test_breaker_closes_when_its_time_runs_out(source, tmp_path):
    """By the watermark alone, over a restart, once; and by a later row before the watermark is there."""
    add, stream = source
    path = str(tmp_path / "out")
    events = lambda: [(r.key, r.state, r.ts, r.streak) for r in streams.run_available(streams.stream_breaker(stream()), path).orderBy("_batch", "key", "ts").collect()]
    add(*[fail(k, 10 * k) for k in range(3)], *[fail(k, 10 * k, "b") for k in range(3, 6)])
    opened = [("a", "open", at(20), 3), ("b", "open", at(50), 3)]
    assert events() == opened
    add(fail(6, 300, "b"))  # b had run out at 170; its streak went on, so this opens again
    again = [*opened, ("b", "closed", at(170), 3), ("b", "open", at(300), 4)]
    assert events() == again
    add((7, 3_600 + 250, "c", True, "x", 1.0))  # the watermark is at 250: past a's end, before b's second one
    passed = [*again, ("a", "closed", at(140), 3)]
    assert events() == passed
    add(fail(8, 310, "a"))  # behind no watermark; a's streak was kept
    assert events() == [*passed, ("a", "open", at(310), 4)]
    add((9, 100_000, "c", True, "x", 1.0))
    assert events() == [*passed, ("a", "open", at(310), 4), ("a", "closed", at(430), 4), ("b", "closed", at(420), 4)]
    assert len(events()) == 8  # nothing is said twice


def test_breaker_stream_gives_the_intervals_of_a_batch(source, tmp_path, spark):
    """In files of a few rows, out of order within a file: what opens and closes is what the window form gives."""
    import random

    from siftframe.operators.windows import breaker_intervals

    rng, rows, t = random.Random(4), [], 0
    for k in range(160):
        t += rng.choice([1, 20, 90, 150, 400])
        rows.append((k, t, rng.choice("ab"), rng.random() < 0.2, "x", 1.0))
    add, stream = source
    for i in range(0, len(rows), 40):
        add(*rng.sample(rows[i : i + 40], 40))
    add((999, 1_000_000, "z", True, "x", 1.0))
    out = streams.run_available(streams.stream_breaker(stream()), str(tmp_path / "out")).orderBy("key", "ts", F.col("state").desc()).collect()
    got, start = [], {}
    for r in out:
        if r.state == "open":
            start.setdefault(r.key, r.ts)
        else:
            got.append((r.key, start.pop(r.key), r.ts))
    log = spark.createDataFrame([(k, at(s), key, ok, kind, ms) for k, s, key, ok, kind, ms in rows], SCHEMA)
    want = sorted((r.key, r.open_from, r.open_until) for r in breaker_intervals(log).collect())
    assert sorted(got) == want and len(want) > 5 and not start


def test_a_batch_that_runs_again_doubles_nothing(source, tmp_path, spark):
    add, stream = source
    path = str(tmp_path / "out")
    add(fail(1, 0), fail(2, 10), fail(3, 20))
    want = streams.run_available(streams.stream_breaker(stream()), path).count()
    # As after a failure between the write and the commit: the last batch is taken back and runs again.
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for f in commits.iterdir():
        if f.name.strip(".").split(".")[0] == "0":
            f.unlink()
    again = streams.run_available(streams.stream_breaker(stream()), path)
    assert again.count() == want == 1


def test_answers_are_reused_by_age(source, tmp_path):
    add, stream = source
    path = str(tmp_path / "out")
    add(fail(1, 0), fail(2, 299), fail(3, 300), fail(4, 301), fail(5, 601), fail(6, 3_700, "b"))
    run = lambda: {(r.key, r.ts) for r in streams.run_available(streams.stream_dedupe(stream(), 300), path).collect()}
    assert run() == {("a", at(0)), ("a", at(301)), ("b", at(3_700))}
    add(fail(7, 3_600), fail(8, 3_900, "b"), fail(9, 4_001, "b"))
    assert run() == {("a", at(0)), ("a", at(301)), ("b", at(3_700)), ("a", at(3_600)), ("b", at(4_001))}


def test_status_expires(source, tmp_path):
    add, stream = source
    path = str(tmp_path / "out")
    run = lambda: streams.run_available(streams.stream_status(stream()), path, "update")
    add((1, 0, "a", True, "dead", 1.0), (2, 5, "a", True, "plain", 1.0), (3, 0, "b", True, "dead", 1.0))
    add((4, 3, "a", True, "tunnel", 1.0))  # older than the status that is known
    first = {(r.key, r.kind, r.expires, r.usable, r.dropped_late) for r in run().collect()}
    assert first == {("a", "plain", at(605), False, 0), ("b", "dead", at(300), False, 0), ("a", "plain", at(605), False, 1)}
    add((5, 3_600 + 400, "c", True, "gated", 1.0))  # the watermark passes b's expiry, over a restart
    gone = lambda: [(r.key, r.ts, r.usable) for r in run().where("kind is null").orderBy("ts").collect()]
    assert gone() == [("b", at(300), True)]
    add((6, 500, "a", True, "tunnel", 1.0))  # a new status moves the expiry
    add((7, 3_600 + 700, "c", True, "gated", 1.0))
    assert gone() == [("b", at(300), True)]
    add((8, 100_000, "d", True, "gated", 1.0))
    assert gone() == [("b", at(300), True), ("a", at(1_100), True), ("c", at(3_600 + 700 + 600), True)]
    use = {(r.key, r.kind): r.usable for r in streams.usable(run().where("ts > '2026-01-01'").drop("_batch", "usable"), F.lit(at(400))).collect()}
    assert not use["a", "plain"] and use["c", "gated"]


def test_rows_behind_the_watermark_are_counted_over_the_whole_run(source, tmp_path, spark):
    """More micro-batches than a query's recent progress holds, each with a late row."""
    add, stream = source
    n, metrics = 110, {}
    add(fail(0, 1_000_000))
    for k in range(1, n):
        add(fail(k, k))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        streams.run_available(streams.stream_outcomes(stream().withColumn("source", F.lit("lite"))), str(tmp_path / "out"), "update", metrics=metrics)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert n - 2 <= metrics["dropped_late"] <= n - 1 and metrics["dropped_late"] > 100


def test_latency_sample_with_late_rows_is_that_of_a_batch(source, tmp_path, spark):
    import random

    from siftframe.operators.aggregates import latency_percentiles

    rng, add, stream = random.Random(5), *source
    rows = [(k, 100 * k + rng.randint(-900, 900), "ab"[k % 2], True, "x", rng.choice([float(rng.randint(0, 99)), -1.0, float("nan")])) for k in range(90)]
    for i in range(0, 90, 18):
        add(*rows[i : i + 18])
    add((200, 100, "a", True, "x", 5.0))  # older than a full sample
    out = streams.run_available(streams.stream_latency(stream(), 8, watermark="1 day"), str(tmp_path / "out"), "update")
    last = {r.key: tuple(r.s) for r in out.groupBy("key").agg(F.max_by(F.struct("n", "p50", "p95", "max", "dropped_late"), "_batch").alias("s")).collect()}
    log = spark.createDataFrame([(k, at(s), key, ok, kind, ms) for k, s, key, ok, kind, ms in rows], SCHEMA)
    for key in "ab":
        r = latency_percentiles(log.where(F.col("key") == key), 8).first()
        assert last[key][:4] == (r.n, r.p50, r.p95, r.max)
    assert last["a"][4] == 1 and last["b"][4] == 0


def test_latency_state_goes_after_idle_time(source, tmp_path):
    add, stream = source
    path = str(tmp_path / "out")
    add(*[(k, k, "a", True, "x", float(k)) for k in range(10)])
    add((20, 90_000, "b", True, "x", 7.0))
    add((21, 90_001, "b", True, "x", 9.0))
    add((22, 90_002, "a", True, "x", 5.0))
    out = streams.run_available(streams.stream_latency(stream(), 3, idle_ms=1_000), path, "update").orderBy("_batch", "key").collect()
    a = [(r.n, r.p50, r.max) for r in out if r.key == "a"]
    assert a[0] == (3, 8, 9) and a[-1] == (1, 5, 5)


def test_an_empty_stream(source, tmp_path, spark):
    add, stream = source
    add()
    assert streams.run_available(streams.stream_dedupe(stream()), str(tmp_path / "out")).count() == 0
