"""Batch analytics over job snapshots.

A snapshot is ``job_id, ts, seq, state, percent``; ``(ts, seq)`` orders the
snapshots of a job and is unique in it. Everything per job is a window or an
aggregate keyed by ``job_id``: one shuffle, shared by all windows of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.functions import timing as tm
from rayloom.operators.ranges import running

_ORDER = ("ts", "seq")


def _job(*order) -> Window:
    return Window.partitionBy("job_id").orderBy(*(order or _ORDER))


def millis(ts: Column) -> Column:
    """Whole milliseconds of a time, as a clock of that step shows them."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


#: What makes two snapshots of a job differ; of result and error only whether they are there.
COMPARED, COMPARED_PRESENCE = ("state", "percent", "stage", "message", "from_cache"), ("result", "error")


def changed_only(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ, null-safely, from the one before in any compared field that they have."""
    has = set(snapshots.columns)
    now = F.struct(*[c for c in COMPARED if c in has], *[F.col(c).isNull().alias(c) for c in COMPARED_PRESENCE if c in has])
    before = F.lag(now).over(_job())
    return snapshots.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each job: a partially aggregated maximum, no sort."""
    last = F.max_by(F.struct("*"), F.struct(*_ORDER))
    return snapshots.groupBy("job_id").agg(last.alias("last")).select("last.*")


def job_order(snapshots: DataFrame) -> DataFrame:
    """Jobs by their last change, latest first, as a ranked table, ranked in ranges of time."""
    ranked = running(latest(snapshots), _ORDER, descending=True)
    return ranked.withColumn("place", F.col("place").cast("int"))


def panel(snapshots: DataFrame, dismissed: DataFrame, size: int = 6) -> DataFrame:
    """The ``size`` jobs that changed last and aren't dismissed: a top-k, not a sort."""
    return latest(snapshots).join(dismissed, "job_id", "left_anti").orderBy(F.desc("ts"), F.desc("seq")).limit(size)


def pending_counts(snapshots: DataFrame) -> DataFrame:
    last = latest(snapshots)
    return last.agg(
        F.count(F.when(tm.is_pending(F.col("state")), 1)).alias("pending"), F.count(F.when(tm.is_terminal(F.col("state")), 1)).alias("terminal")
    )


def poll_flags(snapshots: DataFrame) -> DataFrame:
    """Per job, over the step from each snapshot to the next: did any move, are all queued, is any above 80 %."""
    moved = snapshots.withColumn("before", F.lag("percent").over(_job()))
    return moved.groupBy("job_id").agg(
        F.bool_or(F.coalesce(F.col("percent") > F.col("before"), F.lit(False))).alias("any_progress"),
        F.bool_and(F.col("state") == "queued").alias("all_queued"),
        F.bool_or(F.col("percent") > 80).alias("any_near_end"),
    )


def sessions(snapshots: DataFrame) -> DataFrame:
    """The snapshots that timing looks at, with ``session``.

    Those are the ones of pending jobs that are not from a cache, with percent
    clamped (null is 0). Timing starts anew where percent falls by more than half a
    point, and behind a cached snapshot, which clears it; terminal snapshots change nothing.
    """
    cached = F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in snapshots.columns else F.lit(False)
    seen = snapshots.withColumn("_cached", F.count(F.when(cached, 1)).over(_job()))
    looked = seen.filter(tm.is_pending(F.col("state")) & ~cached).withColumn("percent", tm.clamp_percent(F.col("percent")))
    fell = F.col("percent") + tm.LEAST_STEP < F.lag("percent").over(_job())
    cleared = F.col("_cached") != F.lag("_cached").over(_job())
    anew = looked.withColumn("_anew", F.when(fell | cleared, 1).otherwise(0))
    return anew.withColumn("session", F.sum("_anew").over(_job()).cast("int")).drop("_anew", "_cached")


def accepted(snapshots: DataFrame) -> DataFrame:
    """Per job and session, snapshots whose percent moved; exact for whole percents."""
    inside = Window.partitionBy("job_id", "session").orderBy(*_ORDER)
    before = F.lag("percent").over(inside)
    return sessions(snapshots).withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("percent"))).drop("_before")


def rates(snapshots: DataFrame) -> DataFrame:
    """Accepted samples with the rate since the one before, where it can be measured."""
    inside = Window.partitionBy("job_id", "session").orderBy(*_ORDER)
    gap = millis(F.col("ts")) - F.lag(millis(F.col("ts"))).over(inside)
    samples = accepted(snapshots).withColumns({"gap_ms": gap, "previous": F.lag("percent").over(inside)})
    return samples.withColumn("rate", tm.measured_rate(F.col("percent").cast("double"), F.col("previous").cast("double"), F.col("gap_ms")))


def overall_rates(snapshots: DataFrame) -> DataFrame:
    """Accepted samples with the rate since the session's first one above zero."""
    inside = Window.partitionBy("job_id", "session").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.col("percent") > 0
    first_ts = F.first(F.when(begun, F.col("ts")), True).over(inside)
    first_percent = F.first(F.when(begun, F.col("percent")), True).over(inside)
    samples = accepted(snapshots).withColumns(
        {"since_first_ms": millis(F.col("ts")) - millis(first_ts), "first_percent": first_percent, "measured": F.count(F.when(begun, 1)).over(inside)}
    )
    return samples.withColumn("overall", tm.overall_rate(F.col("percent").cast("double"), F.col("first_percent").cast("double"), F.col("since_first_ms")))


def rolling_samples(snapshots: DataFrame) -> DataFrame:
    """Accepted samples with the buffer after each: ``held``, of the session's newest eight samples, oldest first,
    those within 20 s and always the own one, and ``samples``, their number.

    What the buffer drops for its age is too old for every later sample too, so the
    newest eight in a window are all that it can hold.
    """
    newest = Window.partitionBy("job_id", "session").orderBy(*_ORDER).rowsBetween(1 - tm.ROLLING_SAMPLES, Window.currentRow)
    listed = F.collect_list(F.struct("ts", "seq", "percent")).over(newest)
    near = lambda x: (millis(F.col("ts")) - millis(x["ts"]) <= tm.ROLLING_MS) | (x["seq"] == F.col("seq"))
    held = accepted(snapshots).withColumn("_newest", listed).withColumn("held", F.filter("_newest", near)).drop("_newest")
    return held.withColumn("samples", F.size("held"))


def smoothed_rates(snapshots: DataFrame) -> DataFrame:
    """Per job and session, the exponential average of the measured rates in order.

    A fold is no window function: the rates of one session are collected in order
    and folded by ``aggregate``. Whole percents only rise inside a session, so its
    list has a hundred rates at the most, however long the job.
    """
    listed = rates(snapshots).filter("rate is not null and rate <> 0").groupBy("job_id", "session").agg(
        F.array_sort(F.collect_list(F.struct("ts", "seq", "rate"))).alias("rates")
    )
    fold = F.aggregate(
        "rates", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["rate"]).otherwise(acc + (x["rate"] - acc) * tm.EMA_ALPHA)
    )
    return listed.select("job_id", "session", fold.alias("smoothed"))


def state_machine(events: DataFrame) -> DataFrame:
    """Final state and percent of each job from its requests, in order.

    ``action`` is start, progress (with percent), complete, fail or cancel. A
    queued job that is cancelled is cancelled at once; a running one is
    cancelling until it completes or fails, which then means cancelled. Terminal
    states stay; progress counts only while a job is queued or running.

    The fold has a closed form: the first cancel, end and start decide the state,
    and progress counts until the first cancel or end. One shuffle; the running
    window holds no job in memory and the aggregate keeps a few values for each.
    """
    action, at = F.col("action"), F.struct("ts", "seq")
    closing = F.max(action.isin("cancel", "complete", "fail")).over(_job().rowsBetween(Window.unboundedPreceding, -1))
    open_ = events.withColumn("_open", ~F.coalesce(closing, F.lit(False)))
    first = lambda *kinds: F.min(F.when(action.isin(*kinds), at))
    moved = F.when(F.col("_open") & (action == "progress"), F.col("percent"))
    facts = open_.groupBy("job_id").agg(
        first("start", "progress").alias("ran"), first("cancel").alias("cancel"), first("complete", "fail").alias("end"),
        F.min_by(F.when(action.isin("complete", "fail"), action), F.when(action.isin("complete", "fail"), at)).alias("how"),
        F.max_by(moved, F.when(moved.isNotNull(), at)).alias("moved"),
    )
    before = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))
    first_cancel = before("cancel", "end")
    state = (
        F.when(first_cancel & (~before("ran", "cancel") | F.col("end").isNotNull()), "cancelled")
        .when(first_cancel, "cancelling")
        .when(F.col("how") == "complete", "completed")
        .when(F.col("how") == "fail", "failed")
        .when(F.col("ran").isNotNull(), "running")
        .otherwise("queued")
    )
    return facts.select("job_id", state.alias("state"), F.when(state == "completed", 100).otherwise(F.coalesce("moved", F.lit(0))).cast("int").alias("percent"))


def stalls(snapshots: DataFrame) -> DataFrame:
    """(job_id, seq, percent, stalled_ms): samples behind which a job stood still for 12 s, and when it had.

    A sample is followed by the next accepted one, or by a terminal or cached
    snapshot; one that nothing follows has stalled too.
    """
    cached = F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in snapshots.columns else F.lit(False)
    moved = accepted(snapshots).select("job_id", "ts", "seq", F.col("percent").cast("double").alias("percent"))
    closed = snapshots.filter(cached | tm.is_terminal(F.col("state"))).select("job_id", "ts", "seq", F.lit(None).cast("double").alias("percent"))
    marks = moved.union(closed).withColumn("quiet", F.lead(millis(F.col("ts"))).over(_job()) - millis(F.col("ts")))
    still = marks.filter("percent is not null").filter(F.col("quiet").isNull() | (F.col("quiet") >= tm.STALL_MS))
    return still.select("job_id", "seq", "percent", (millis(F.col("ts")) + tm.STALL_MS).alias("stalled_ms"))


def deduplicated_starts(starts: DataFrame) -> DataFrame:
    """In-flight dedupe: a start with the fingerprint of a job still running gets that job's id (``ran_as``).

    ``starts`` has fingerprint, job_id, ts, seq and end_ts (when the job would
    end). A start is a duplicate if it comes before the running job's end; a null
    ``end_ts`` ends at once, and a null fingerprint is like no other. Each start
    depends on those before, so the rows of a fingerprint are sorted and streamed
    past one held job; none are collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job, end = None, None, None
        for batch in batches:
            ran = []
            for own, started, ts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != key or end is None or ts >= end:
                    key, job, end = own, started, ends
                ran.append(job)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ran, pa.int64())], ["fingerprint", "job_id", "ran_as"])

    rows = starts.select("fingerprint", F.col("job_id").cast("long").alias("job_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "seq")
    ordered = rows.filter("fingerprint is not null").repartition("fingerprint").sortWithinPartitions("fingerprint", "ts", "seq")
    alone = rows.filter("fingerprint is null").select("fingerprint", "job_id", F.col("job_id").alias("ran_as"))
    return ordered.mapInArrow(run, "fingerprint string, job_id long, ran_as long").union(alone)


def coalesced(updates: DataFrame, quiet: str, key: str = "job_id") -> DataFrame:
    """One row per burst of updates of a key: its last update (``update``), when the burst began and ended, and how many it had.

    A burst ends where the next update comes more than ``quiet`` later. The same plan serves streams:
    with a watermark on ``ts`` a burst is shown once it can't grow any more.
    """
    burst = updates.groupBy(key, F.session_window("ts", quiet).alias("_burst"))
    rest = [c for c in updates.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("ts", "seq"))
    return burst.agg(last.alias("update"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("updates")).drop("_burst")


def batch_get(requested: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots for (place, job_id), in request order, without unknown and blank ids; repeats stay."""
    return requested.filter("job_id is not null").join(latest(snapshots), "job_id").orderBy("place")


#: Fixed values: (kind, percent, stage) in order.
STAGES = (
    ("renderStudy", 10, "validating"), ("renderStudy", 35, "loadingStudy"), ("renderStudy", 75, "renderingPreview"),
    ("renderStudy", 90, "writingPreview"), ("renderStudy", 100, "completed"),
    ("processStudy", 10, "validating"), ("processStudy", 30, "loadingStudy"), ("processStudy", 65, "processingPixels"),
    ("processStudy", 84, "writingPreview"), ("processStudy", 95, "writingDicom"), ("processStudy", 100, "completed"),
)


def stage_of(kind: Column, percent: Column) -> Column:
    """The stage that a job of this kind has reached."""
    out = F.lit("queued")
    for k, p, stage in STAGES:
        out = F.when((kind == k) & (percent >= p), stage).otherwise(out)
    return out


def schedule_errors(reports: DataFrame) -> DataFrame:
    """Reports (job_id, kind, ts, seq, stage, percent) that don't follow their kind's schedule, with ``error``.

    A stage must be one of the kind's, come at its percent, and not before one
    that the job has reached.
    """
    place = F.lit(None).cast("int")
    wanted = F.lit(None).cast("int")
    for number, (kind, percent, stage) in enumerate(STAGES):
        own = (F.col("kind") == kind) & (F.col("stage") == stage)
        place, wanted = F.when(own, number).otherwise(place), F.when(own, percent).otherwise(wanted)
    reached = F.max("_place").over(_job().rowsBetween(Window.unboundedPreceding, -1))
    placed = reports.withColumns({"_place": place, "_wanted": wanted}).withColumn("_reached", reached)
    error = (
        F.when(F.col("_place").isNull(), "unknown stage")
        .when(F.col("percent") != F.col("_wanted"), F.concat(F.lit("expected percent "), F.col("_wanted").cast("string")))
        .when(F.col("_place") <= F.col("_reached"), "stage out of order")
    )
    return placed.withColumn("error", error).filter("error is not null").drop("_place", "_wanted", "_reached")
