"""Structured Streaming forms of extraction, breakers, dedupe, status and statistics."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.extract import extract_page, extract_results
from ..operators.filters import classify_pages

#: State of a key without rows goes when the watermark is so far past its last one.
IDLE_MS = 7 * 86_400_000


def stream_extract(pages: DataFrame) -> DataFrame:
    """Each page as it arrives: its label and reason, title, description and text. Stateless, so a stream gives what a
    batch gives."""
    return extract_page(classify_pages(pages), keep=("label", "reason"))


def stream_results(pages: DataFrame, rules=None) -> DataFrame:
    """The result rows of pages (page_id, engine, url, html) as they arrive, block pages left out: (page_id, engine, title,
    url, snippet, rank). First-wins and ranks are found inside a page's row, so the stream is stateless, appends, and
    gives what a batch gives."""
    good = classify_pages(pages).where("label = 'ok'").select("page_id", "engine", "html")
    return extract_results(good, rules)


def _expire(state: GroupState, at_ms: int) -> None:
    state.setTimeoutTimestamp(max(int(at_ms), state.getCurrentWatermarkMs() + 1))


def _columns(batches: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """Columns of all batches as arrays, times in nanoseconds: what of a key's rows in a micro-batch has to be sorted."""
    parts = [[b[n].astype("datetime64[ns]").astype("int64").to_numpy() if n == "ts" else b[n].to_numpy() for n in names] for b in batches]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]


BREAKER = "key string, ts timestamp, state string, open_until timestamp, streak long, dropped_late long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us * 1000)


def _ms_after(us: int) -> int:
    """The first full millisecond at or after a time: what a timer can be set to."""
    return -(-us // 1000)


class _Keyed(StatefulProcessor):
    """A processor with one value state and event-time timers. A timer that is set for a time that the watermark has
    passed fires with the next micro-batch."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.state_schema)

    def timers(self, *wanted: int) -> None:
        """The key's timers are these and no others."""
        have = set(self.handle.listTimers())
        for t in have - set(wanted):
            self.handle.deleteTimer(t)
        for t in set(wanted) - have:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


class _Breaker(_Keyed):
    state_schema = "streak long, last long, late long, open_until long"

    def __init__(self, fails: int, span_us: int, idle_ms: int):
        self.fails, self.span, self.idle = fails, span_us, idle_ms

    def _keep(self, streak: int, last: int, late: int, until: int) -> None:
        self.state.update((streak, last, late, until))
        self.timers(*([_ms_after(until)] if until else []), last // 1000 + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, last, late, until = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        times, ids, oks = _columns(rows, "ts", "event_id", "ok")
        times, out = times // 1000, []
        late += int((times < last).sum())
        for k in np.lexsort((ids, times)):
            t = int(times[k])
            if t < last:
                continue
            if until and t > until:  # it had run out before this row
                out.append((key[0], _time(until), "closed", _time(until), streak, late))
                until = 0
            if oks[k]:
                if until:
                    out.append((key[0], _time(t), "closed", _time(t), 0, late))
                streak, until = 0, 0
            else:
                streak += 1
                if streak >= self.fails:
                    until = t + self.span
                    out.append((key[0], _time(t), "open", _time(until), streak, late))
        self._keep(streak, max(last, int(times.max())), late, until)
        yield _frame(out, BREAKER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            streak, last, late, until = self.state.get()
            at = expiredTimerInfo.getExpiryTimeInMs()
            if until and at >= _ms_after(until):
                out.append((key[0], _time(until), "closed", _time(until), streak, late))
                self.state.update((streak, last, late, 0))
            if at >= last // 1000 + self.idle:
                self.state.clear()
        yield _frame(out, BREAKER)


def stream_breaker(outcomes: DataFrame, fails: int = 3, open_ms: int = 120_000, *, watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Breaker changes (key, ts, state, open_until, streak, dropped_late): "open" for each failure that makes or extends
    an open breaker; "closed" for the success that ends one, or at open_until when its time runs out. The latter comes
    from a timer as soon as the watermark has passed it, whether the key has further rows or not; the streak goes on, so
    that the next failure opens again.

    Rows of a key are taken by time within a micro-batch; rows that are older than the key's last one of an earlier
    micro-batch change nothing and are counted in dropped_late; those older than the watermark are dropped before (see
    run_available). Engines use 3 failures and two minutes, hosts windows.HOST_PRESET.

    The state is a streak, two times and a count, and goes after idle_ms without rows. A task holds 17 bytes a row of one
    key and micro-batch; the source's maxFilesPerTrigger or maxBytesPerTrigger bounds that."""
    step = _Breaker(max(2, fails), 1000 * max(5_000, open_ms), max(idle_ms, open_ms))
    rows = outcomes.select("key", "ts", "event_id", "ok").withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(step, BREAKER, "append", "EventTime")


def stream_dedupe(requests: DataFrame, ttl_s: int = 300, key: str = "key", ts: str = "ts", *, watermark: str = "1 hour") -> DataFrame:
    """(key, ts): the requests that are answered anew. An answer is reused by requests of its key that are at most ttl_s
    seconds younger; the next one is answered anew, and its answer reused in turn. Requests that are older than their
    key's last answer (late ones) count as answered. The state is the time of the last answer, and goes with it."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            (times,) = _columns(batches, "ts")
            for t in np.sort(times).tolist():
                if last is None or t - last > ttl_s * 1_000_000_000:
                    last = t
                    out.append((k[0], pd.Timestamp(t)))
            state.update((last,))
            _expire(state, last // 1_000_000 + 1000 * ttl_s)
        yield pd.DataFrame(out, columns=["key", "ts"])

    rows = requests.select(F.col(key).alias("key"), F.col(ts).alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


STATUS = "key string, kind string, ts timestamp, expires timestamp, usable boolean, dropped_late long"
#: How long a status holds, in seconds; others for OTHER_S.
HOLDS_S, OTHER_S = {"dead": 300}, 600
#: A key with one of these may be used.
USABLE = ("tunnel", "gated")


class _Status(_Keyed):
    state_schema = "kind string, last long, late long"

    @staticmethod
    def _expires(kind: str, last: int) -> int:
        return last + 1_000_000 * HOLDS_S.get(kind, OTHER_S)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, last, late = self.state.get() if self.state.exists() else ("", -1, 0)
        before = last
        for pdf in rows:  # a running best: one batch is held at a time
            times = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            late += int((times < before).sum())
            best = max(zip(times.tolist(), pdf["kind"], strict=True))
            if best > (last, kind):
                last, kind = best
        expires = self._expires(kind, last)
        self.state.update((kind, last, late))
        self.timers(_ms_after(expires))
        yield _frame([(key[0], kind, _time(last), _time(expires), kind in USABLE, late)], STATUS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            kind, last, late = self.state.get()
            expires = self._expires(kind, last)
            if expiredTimerInfo.getExpiryTimeInMs() >= _ms_after(expires):
                out.append((key[0], None, _time(expires), _time(expires), True, late))
                self.state.clear()
        yield _frame(out, STATUS)


def stream_status(events: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """(key, kind, ts, expires, usable, dropped_late): the last status of each key whenever rows come, and a row without
    a kind that says usable at `expires`, by a timer, when the watermark has passed that: a key whose status is not known
    may be used. `dead` holds for 5 minutes, the others for 10; tunnel and gated are usable, plain and dead are not.

    Rows older than the key's status change nothing and are counted in dropped_late. The state is that status, and goes
    when it expires."""
    rows = events.select("key", "ts", "kind").withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(_Status(), STATUS, "update", "EventTime")


def usable(status: DataFrame, now) -> DataFrame:
    """status with `usable` at a time: expired ones are usable, tunnel and gated are, plain and dead are not."""
    gone = F.col("expires") < now
    return status.withColumn("usable", gone | F.coalesce(F.col("kind").isin(*USABLE), F.lit(True)))


def stream_outcomes(outcomes: DataFrame, window: str = "1 hour", *, watermark: str = "10 minutes") -> DataFrame:
    """Outcome counts of each key and window; rows older than the watermark are dropped."""
    w = outcomes.withWatermark("ts", watermark).groupBy(F.window("ts", window), "key")
    ok, source = F.col("ok"), F.col("source")
    counts = w.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"), F.count_if(source == "lite").alias("lite"), F.count_if(source == "render").alias("render"))
    return counts.select(F.col("window.start").alias("start"), "key", "ok", "fail", "lite", "render")


LATENCY = "key string, n long, p50 long, p95 long, max long, dropped_late long"


class _Latency(_Keyed):
    state_schema = "late long"

    def __init__(self, last: int, idle_ms: int):
        self.last, self.idle = last, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sample = handle.getMapState("sample", "ts long, id long", "ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): v[0] for k, v in self.sample.iterator()}
        late = self.state.get()[0] if self.state.exists() else 0
        oldest = min(held) if len(held) >= self.last else None
        new: dict[tuple, float] = {}
        for pdf in rows:  # one batch and the newest rows are held at a time
            pdf = pdf[(pdf["duration_ms"] >= 0) & np.isfinite(pdf["duration_ms"])]
            times = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
            for place, ms in zip(zip(times, pdf["event_id"].tolist(), strict=True), pdf["duration_ms"].tolist(), strict=True):
                if oldest is not None and place < oldest:
                    late += 1
                else:
                    new[place] = ms
            if len(new) > self.last:
                new = {k: new[k] for k in sorted(new)[-self.last :]}
        kept = set(sorted({*held, *new})[-self.last :])
        for place in held.keys() - kept:
            self.sample.removeKey(place)
        for place in new.keys() & kept:
            self.sample.updateValue(place, (new[place],))
        if held.keys() - kept or new:
            self.state.update((late,))
        values = sorted((held | new)[k] for k in kept)
        n = len(values)
        self.timers(((max(kept)[0] // 1000) if kept else timerValues.getCurrentWatermarkInMs()) + self.idle)
        p = lambda q: int(values[max(0, -int(-q * n // 1) - 1)] + 0.5) if n else 0
        yield _frame([(key[0], n, p(0.5), p(0.95), int(values[-1] + 0.5) if n else 0, late)], LATENCY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sample.clear()
        self.state.clear()
        yield _frame([], LATENCY)


def stream_latency(outcomes: DataFrame, last: int = 500, *, watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Updates (key, n, p50, p95, max, dropped_late) over the last durations of each key; durations that are negative or
    not finite do not count. The state is a map with one entry a duration: a micro-batch writes the entries that are new
    and removes those that they push out, and leaves the others alone. It goes after idle_ms without rows. A late row
    takes its place by time; one that is older than a full sample is counted in dropped_late."""
    rows = outcomes.select("key", "ts", "event_id", "duration_ms").withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(_Latency(last, idle_ms), LATENCY, "update", "EventTime")


class _Dropped(StreamingQueryListener):
    """Adds up, over all micro-batches of a query's run, the rows that were older than the watermark."""

    def __init__(self):
        self.rows, self.ended = Counter(), defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


#: Keeps state in files of each executor's disk and in the checkpoint, beyond memory; processors with timers need it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run_available(stream: DataFrame, path: str, mode: str = "append", *, each: Callable[[DataFrame], DataFrame] | None = None, metrics: dict | None = None) -> DataFrame:
    """Run a stream over what there is, into a table at `path` with the micro-batch as `_batch`; `each` is applied to
    every micro-batch. Update mode keeps every batch; readers take the newest row of each key.

    A micro-batch has a folder of its own, which is overwritten when it runs again after a failure, so nothing is
    doubled; a later call with the same path goes on where the last one ended. State is kept by RocksDB. metrics gets
    dropped_late, the rows that this run dropped because they were older than the watermark: a listener adds them up over
    all micro-batches, however many there are."""
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)
    schema = (each(empty) if each else empty).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/out/_batch=-1")

    def write(df: DataFrame, batch: int) -> None:
        (each(df) if each else df).write.mode("overwrite").parquet(f"{path}/out/_batch={batch}")

    dropped = _Dropped()
    if metrics is not None:
        spark.streams.addListener(dropped)
    try:
        with _setting(spark, "spark.sql.streaming.stateStore.providerClass", STATE_STORE):
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        if metrics is not None:
            run = str(query.runId)
            if not dropped.ended[run].wait(60):  # events come in order, so the last progress is in by then
                raise RuntimeError("the stream's listener did not hear of its end")
            metrics["dropped_late"] = dropped.rows[run]
    finally:
        if metrics is not None:
            spark.streams.removeListener(dropped)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{names}, _batch long").parquet(f"{path}/out")
