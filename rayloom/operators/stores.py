"""Bounded stores as ranks and running sums: catalog, caches, evictions.

What a cache holds after a run of accesses needs no replay: an entry is still
there iff the distinct keys used since, itself included, fit the limits, and that
sum only grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.operators.ranges import running


def last_access(accesses: DataFrame, key: str = "key") -> DataFrame:
    """One row per key, with the time of its last use; partially aggregated."""
    size = F.coalesce("size", F.lit(0))
    return accesses.groupBy(key).agg(F.max(F.struct("ts", "seq")).alias("at"), F.max_by(size, F.struct("ts", "seq")).alias("size"))


def lru(accesses: DataFrame, capacity: int | None = None, max_bytes: int | None = None, keep_one: bool = False, key: str = "key") -> DataFrame:
    """(key, size, place, used_bytes) of the entries that an LRU cache holds at the end.

    An entry of null size takes 0 bytes. Distinct keys are first cut to the ``capacity`` used last (a top-k), which
    one task can sum; with a byte limit alone the sum runs in ranges of time.
    """
    entries = last_access(accesses, key).select(key, "size", F.col("at.ts").alias("ts"), F.col("at.seq").alias("seq"))
    if capacity is None:
        run = running(entries, ("ts", "seq"), "size", descending=True)
        ranked = run.select(key, "size", F.col("place").cast("int").alias("place"), (F.col("prior") + F.col("size")).alias("used_bytes"))
    else:
        newest = [F.desc("ts"), F.desc("seq")]
        order = Window.orderBy(*newest)
        used = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = entries.orderBy(*newest).limit(capacity).select(key, "size", F.row_number().over(order).alias("place"), used.alias("used_bytes"))
    if max_bytes is not None:
        fits = F.col("used_bytes") <= max_bytes
        ranked = ranked.filter(fits | (F.col("place") == 1) if keep_one else fits)
    return ranked


def evict_oldest(files: DataFrame, limit: int, groups: int | None = None, tracked: int | None = None) -> DataFrame:
    """``files`` (path, size, mod_time, ...) with ``evicted``: the oldest go until the rest fits ``limit``.

    ``tracked`` is a total known beforehand: within the limit nothing is read. The running total is taken in ``groups`` ranges of (mod_time, path), so that
    no task sees all files.
    """
    if tracked is not None and tracked <= limit:
        return files.withColumn("evicted", F.lit(False))
    run = running(files, ("mod_time", "path"), "size", ranges=groups)
    return run.withColumn("evicted", F.col("total") - F.col("prior") > limit).select(*files.columns, "evicted")


def recent(opened: DataFrame, size: int = 10) -> DataFrame:
    """The ``size`` paths opened last, newest first, one row per path."""
    newest = opened.groupBy("path").agg(F.max(F.struct("ts", "seq")).alias("at"))
    return newest.select("path", F.col("at.ts").alias("ts"), F.col("at.seq").alias("seq")).orderBy(F.desc("ts"), F.desc("seq")).limit(size)


def retain_newest(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """The ``size`` newest rows. The rule is fixed: newest first by ``order``."""
    return rows.orderBy(*order).limit(size)


#: How long a look at an artifact counts, and what a hit's snapshot says.
RECHECK_MS, HIT = 60_000, {"state": "completed", "stage": "cacheHit", "percent": 100}


def result_store(requests: DataFrame, results: DataFrame, artifacts: DataFrame, recheck_ms: int = RECHECK_MS) -> tuple[DataFrame, DataFrame]:
    """What each request finds in the store of results, and what the store holds at the end.

    ``requests`` (job_id, fingerprint, kind, at_ms, ...) look results up; ``results``
    (fingerprint, kind, path, at_ms) put them in, replacing one of the same
    fingerprint; ``artifacts`` (path, gone_ms) are files and when each went, null for
    never. A path that is not listed was never there. At one moment results come
    first, then requests by job_id.

    A lookup is a ``miss`` where nothing is held. If the last look at the artifact
    (or its storing) was ``recheck_ms`` ago or more, it is looked at again: gone, the
    lookup is ``stale``. Another kind than asked is a ``kindMismatch``. Both remove
    the entry, so later lookups miss until a new result is put in. Else it is a
    ``hit``: the completed snapshot of a new job, from the cache.

    A lookup depends on those before it, so the rows of a fingerprint are sorted and
    streamed past one held entry; none are collected. Null fingerprints find and
    keep nothing. Returns (requests with outcome, state, stage, percent, from_cache,
    path; entries with fingerprint, kind, path, checked_ms).
    """
    went = artifacts.groupBy("path").agg(F.max(F.coalesce("gone_ms", F.lit(2**62))).alias("gone_ms"))
    put = results.select("fingerprint", "kind", "path", F.col("at_ms").cast("long").alias("at_ms")).join(went, "path", "left")
    puts = put.select("fingerprint", "at_ms", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("job_id"), "kind", "path", F.coalesce("gone_ms", F.lit(-(2**62))).alias("gone_ms"))
    asks = requests.select("fingerprint", F.col("at_ms").cast("long").alias("at_ms"), F.lit(1).alias("turn"), F.col("job_id").cast("long").alias("job_id"), "kind", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("gone_ms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # held: kind, path, when its artifact went, when it was looked at
        for batch in batches:
            out = []
            for own, at, turn, job, kind, path, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if held:
                        out.append((None, key, "held", *held[:2], held[3]))
                    key, held = own, None
                if turn == 0:
                    held = (kind, path, gone, at)
                    continue
                outcome = "miss"
                if held:
                    outcome = "hit"
                    if at - held[3] >= recheck_ms:
                        outcome, held = ("stale", held) if held[2] <= at else ("hit", (*held[:3], at))
                    if outcome == "hit" and held[0] != kind:
                        outcome = "kindMismatch"
                out.append((job, own, outcome, kind, held[1] if outcome == "hit" else None, None))
                if outcome not in ("hit", "miss"):
                    held = None
            yield _rows(out)
        if held:
            yield _rows([(None, key, "held", *held[:2], held[3])])

    ordered = puts.union(asks).filter("fingerprint is not null").repartition("fingerprint").sortWithinPartitions("fingerprint", "at_ms", "turn", "job_id")
    told = ordered.mapInArrow(run, "job_id long, fingerprint string, outcome string, kind string, path string, checked_ms long")
    alone = asks.filter("fingerprint is null").select("job_id", "fingerprint", F.lit("miss").alias("outcome"), "kind", "path", F.lit(None).cast("long").alias("checked_ms"))
    found, hit = told.filter("outcome <> 'held'").union(alone), F.col("outcome") == "hit"
    snapshots = found.select(
        "job_id", "fingerprint", "kind", "outcome", F.when(hit, HIT["state"]).alias("state"), F.when(hit, HIT["stage"]).alias("stage"), F.when(hit, HIT["percent"]).alias("percent"), hit.alias("from_cache"), "path",
    )
    return snapshots, told.filter("outcome = 'held'").select("fingerprint", "kind", "path", "checked_ms")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["job_id", "fingerprint", "outcome", "kind", "path", "checked_ms"])
