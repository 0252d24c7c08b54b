"""The job feed as streams.

A feed is JSON lines of snapshots or of requests. Stateless steps are the batch
functions; keyed state is ``transformWithStateInPandas`` (RocksDB state store).
Event-time windows and watermarks are additions that the plain feed has not.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rayloom.functions import timing as tm
from rayloom.operators import jobs as batch

SNAPSHOT = (
    "job_id long, seq long, ts timestamp, state string, percent int, stage string, message string, fingerprint string, from_cache boolean, result string, error string"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_feed(spark: SparkSession, path: str, schema: str = SNAPSHOT, files_per_batch: int | None = None) -> DataFrame:
    """Snapshots from text files of ``data: {...}`` lines or bare JSON lines; lines that don't parse are dropped."""
    reader = spark.readStream
    lines = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(path)
    body = F.regexp_replace("value", "^data: ", "")
    parsed = F.from_json(body, schema)
    return lines.select(parsed.alias("s")).filter("s.job_id is not null").select("s.*")


def state_counts(snapshots: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Snapshots per state and tumbling window of event time; late ones count within the watermark."""
    return snapshots.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n"))


def deduplicated(snapshots: DataFrame, key: str = "fingerprint", within: str = "1 hour") -> DataFrame:
    """The first snapshot of each key within the watermark."""
    return snapshots.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


class _JobProcessor(StatefulProcessor):
    """Keeps one row of state per job and hands each job's new rows over in order."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        out = []
        new = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for row in new.itertuples(index=False):
            state, shown = self.step(state, row)
            if shown is not None:
                out.append((key[0], row.seq, *shown))
        if state is not None:
            self.held.update(tuple(state))
        elif self.held.exists():
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["job_id", "seq", *self.OUT])

    def close(self) -> None:
        pass


class ChangesOnly(_JobProcessor):
    """Shows a snapshot only if one of the compared fields has changed."""

    STATE = "state string, percent int, stage string, message string, from_cache boolean, no_result boolean, no_error boolean"
    OUT = ("state", "percent", "stage", "message", "from_cache")

    def step(self, state, row):
        own = lambda x: None if pd.isna(x) else x
        percent, cached = own(row.percent), own(row.from_cache)
        now = (
            own(row.state), None if percent is None else int(percent), own(row.stage), own(row.message),
            None if cached is None else bool(cached), bool(pd.isna(row.result)), bool(pd.isna(row.error)),
        )
        return now, None if state is not None and tuple(map(own, state)) == now else now[:5]


class StateMachine(_JobProcessor):
    """Applies the job's requests (``state`` holds the action) and shows where it stands after each; progress without a percent moves nothing."""

    STATE, OUT = "state string, percent int", ("state", "percent")

    def step(self, state, row):
        at, percent = state if state is not None else ("queued", 0)
        action = row.state
        if at in tm.TERMINAL:
            return (at, percent), (at, percent)
        if at in ("queued", "running") and action in ("progress", "complete"):
            percent = 100 if action == "complete" else percent if pd.isna(row.percent) else int(row.percent)
        if action == "cancel":
            at = "cancelled" if at == "queued" else "cancelling"
        elif action in ("complete", "fail"):
            at = "cancelled" if at == "cancelling" else {"complete": "completed", "fail": "failed"}[action]
        elif at == "queued" and action in ("start", "progress"):
            at = "running"
        return (at, percent), (at, percent)


def _cached(row) -> bool:
    return not pd.isna(row.from_cache) and bool(row.from_cache)


def _clamped(row) -> float:
    return 0.0 if pd.isna(row.percent) else float(min(100, max(0, row.percent)))


def _millis(row) -> int:
    return row.ts.value // 1_000_000


class Timing(_JobProcessor):
    """Progress timing per job: accepted samples, smoothed rate, resets.

    A cached snapshot clears what is held and shows nothing; a terminal one shows
    what is held and moves nothing. ``stalled`` says whether the last progress was
    12 s ago or more when the row came.
    """

    STATE = "last_ms long, last_percent double, first_ms long, first_percent double, measured int, rate double, moved_ms long"
    OUT = ("percent", "measured", "rate", "stalled")

    def step(self, state, row):
        if _cached(row):
            return None, None
        ms, percent = _millis(row), _clamped(row)
        if row.state not in tm.PENDING:
            return state, None if state is None else (state[1], int(state[4]), None if state[5] < 0 else float(state[5]), False)
        if state is None or percent + tm.LEAST_STEP < state[1]:
            first = (ms, percent) if percent > 0 else (-1, -1.0)
            state = (ms, percent, *first, int(percent > 0), -1.0, ms)
        elif abs(state[1] - percent) >= tm.LEAST_STEP:
            last_ms, last, first_ms, first, measured, rate, _ = state
            gap, moved = ms - last_ms, percent - last
            if last > 0 and gap >= tm.LEAST_GAP_MS and moved / gap:
                rate = moved / gap if rate < 0 else rate + (moved / gap - rate) * tm.EMA_ALPHA
            if first_ms < 0 and percent > 0:
                first_ms, first = ms, percent
            state = (ms, percent, first_ms, first, measured + (percent > 0), rate, ms)
        shown: tuple[Any, ...] = (percent, int(state[4]), None if state[5] < 0 else float(state[5]), ms - state[6] >= tm.STALL_MS)
        return state, shown


def changes_only(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ from the job's one before in state, percent, stage, message, from_cache or in having a result or an error."""
    compared = ("stage", "message", "from_cache", "result", "error")
    return _stateful(snapshots, ChangesOnly(), "state string, percent int, stage string, message string, from_cache boolean", compared)


def state_machine(requests: DataFrame) -> DataFrame:
    return _stateful(requests, StateMachine(), "state string, percent int")


def timing(snapshots: DataFrame) -> DataFrame:
    return _stateful(snapshots, Timing(), "percent double, measured int, rate double, stalled boolean", ("from_cache",))


class Stalls(StatefulProcessor):
    """A row when a job has stood still for 12 s, by a timer that each progress sets anew.

    The timer goes off without another snapshot, once the watermark has passed it.
    Terminal and cached snapshots take it away. Where a later snapshot of the same
    batch shows that the time had passed, the row comes at once, so that batches may
    be cut anywhere.
    """

    OUT = ["job_id", "seq", "percent", "stalled_ms"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seq long, percent double, timer_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        running = timer = state[2] if state is not None else -1
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            ms, pending, cached = _millis(row), row.state in tm.PENDING, _cached(row)
            moved = pending and not cached and (state is None or abs(state[1] - _clamped(row)) >= tm.LEAST_STEP)
            if (moved or not pending or cached) and timer >= 0:
                if ms >= timer:
                    out.append((key[0], state[0], state[1], timer))
                timer = -1
            if cached:
                state = None
            elif moved:
                timer = ms + tm.STALL_MS
                state = (row.seq, _clamped(row), timer)
        if running >= 0 and running != timer:
            self.handle.deleteTimer(running)
        if timer >= 0 and running != timer:
            self.handle.registerTimer(timer)
        if state is not None:
            self.held.update((int(state[0]), float(state[1]), int(timer)))
        elif self.held.exists():
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        if state is not None and state[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((state[0], state[1], -1))
            yield pd.DataFrame([(key[0], *state)], columns=self.OUT)

    def close(self) -> None:
        pass


def stalls(snapshots: DataFrame, late: str = "5 seconds") -> DataFrame:
    """(job_id, seq, percent, stalled_ms) as ``operators.jobs.stalls``, as time passes; ``late`` is how long snapshots may be late."""
    keyed = snapshots.withWatermark("ts", late).select("job_id", "seq", "ts", "state", "percent", "from_cache").groupBy("job_id")
    return keyed.transformWithStateInPandas(Stalls(), "job_id long, seq long, percent double, stalled_ms long", outputMode="Append", timeMode="EventTime")


class InFlight(StatefulProcessor):
    """Which job a start runs as: that of its fingerprint while it is running, else its own.

    A key is a bucket of many fingerprints, as handing a key over takes longer than its
    rows. One job id is held per fingerprint, until the end of that job comes, or for
    ``ttl_ms`` of processing time, so that a job whose end is lost doesn't block its
    fingerprint for ever. What is held is looked up for the fingerprints of a batch only.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getMapState("running", "fingerprint string", "job_id long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, before, held, out = self.running.exists(), {}, {}, []
        new = pd.concat(list(rows)).sort_values(["at", "start", "seq"], kind="stable")
        alone = new["fingerprint"].isna().tolist()
        for own, null, job, start in zip(new["fingerprint"].tolist(), alone, new["job_id"].tolist(), new["start"].tolist()):
            if null:
                if start:
                    out.append((None, job, job))
                continue
            if own not in held:
                found = self.running.getValue((own,)) if known else None
                before[own] = held[own] = found[0] if found is not None else None
            if not start:
                held[own] = None if held[own] == job else held[own]
            else:
                held[own] = job if held[own] is None else held[own]
                out.append((own, job, held[own]))
        for own, job in held.items():
            if job is not None and job != before[own]:
                self.running.updateValue((own,), (int(job),))
            elif job is None and before[own] is not None:
                self.running.removeKey((own,))
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", "job_id", "ran_as"])

    def close(self) -> None:
        pass


def in_flight(starts_and_ends: DataFrame, ttl_ms: int | None = None, buckets: int = 2048) -> DataFrame:
    """(fingerprint, job_id, ran_as) for every start of a feed (fingerprint, job_id, ts, seq, start boolean).

    A start gets the id of the job of its fingerprint that runs, as in
    ``operators.jobs.deduplicated_starts``; ends of other jobs change nothing, and at one moment
    ends come before starts, so a job that ends at the very moment of its start holds
    its fingerprint (until ``ttl_ms``), unlike there. A null fingerprint is like no other.

    Fingerprints share ``buckets`` keys of state; a task holds the rows that a batch has for one
    bucket. A checkpoint keeps the count of buckets it began with.
    """
    # nulls are spread by their jobs; numbers pass to Python faster than times
    bucket = F.pmod(F.coalesce(F.when(F.col("fingerprint").isNotNull(), F.xxhash64("fingerprint")), F.xxhash64("job_id")), F.lit(buckets))
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(2**63 - 1))
    keyed = starts_and_ends.select(bucket.cast("int").alias("bucket"), "fingerprint", "job_id", at.alias("at"), "seq", F.coalesce("start", F.lit(False)).alias("start")).groupBy("bucket")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.transformWithStateInPandas(InFlight(ttl_ms), "fingerprint string, job_id long, ran_as long", outputMode="Append", timeMode=mode)


def coalesced(snapshots: DataFrame, quiet: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """The last snapshot of each burst, once ``quiet`` has passed without another; snapshots behind the watermark are dropped."""
    return batch.coalesced(snapshots.withWatermark("ts", late), quiet)


def _stateful(snapshots: DataFrame, processor: StatefulProcessor, out: str, more: tuple[str, ...] = ()) -> DataFrame:
    keyed = snapshots.select("job_id", "seq", "ts", "state", "percent", *more).groupBy("job_id")
    return keyed.transformWithStateInPandas(processor, f"job_id long, seq long, {out}", outputMode="Append", timeMode="None")


def fan_out(snapshots: DataFrame, sinks: list[str], checkpoint: str):
    """Every micro-batch, written once per sink folder as JSON lines.

    A batch has a folder of its own in each sink and replaces it, so that a batch
    that is run again after a failure is not there twice.
    """

    def write(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        for sink in sinks:
            held.write.mode("overwrite").json(f"{sink}/batch={number}")
        held.unpersist()

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
