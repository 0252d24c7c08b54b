import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.operators import jobs, requests, stores
from rayloom.operators.ranges import running
from rayloom.streaming import jobs as streams

T0 = datetime(2024, 1, 1)


def drain(frame, name, spark):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)

    def make(rows, files=1):
        """Rows (job, seq, seconds, state, percent) as files of JSON lines, one micro-batch each."""
        import json

        folder = tmp_path / "feed"
        folder.mkdir(exist_ok=True)
        for i in range(files):
            own = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
            lines = [json.dumps(dict(zip(("job_id", "seq", "ts", "state", "percent"), (j, s, (T0 + timedelta(seconds=t)).isoformat(), st, p)))) for j, s, t, st, p in own]
            (folder / f"{i}.json").write_text("\n".join([f"data: {x}" for x in lines] + ["not json", ""]))
        return streams.read_feed(spark, str(folder))

    return make


def snapshots(spark, rows):
    data = [(j, T0 + timedelta(seconds=t), s, st, p) for j, s, t, st, p in rows]
    return spark.createDataFrame(data, "job_id long, ts timestamp_ntz, seq long, state string, percent int")


def some_rows(n=80, seed=3):
    rng = random.Random(seed)
    return [(rng.randint(1, 4), i, i * 3, rng.choice(["queued", "running"]), rng.choice([0, 5, 5, 20, 40])) for i in range(n)]


def test_changes_as_stream_and_batch(spark, feed):
    rows = some_rows()
    got = drain(streams.changes_only(feed(rows)), "changes", spark)
    want = jobs.changed_only(snapshots(spark, rows)).collect()
    assert sorted((r.job_id, r.seq) for r in got) == sorted((r.job_id, r.seq) for r in want)


def test_every_compared_field_counts(spark, tmp_path):
    import json

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    base = {"state": "running", "percent": 5, "stage": "a", "message": "m", "from_cache": False, "result": None, "error": None}
    changes = [{}, {}, {"percent": 6}, {"stage": "b"}, {"message": None}, {}, {"from_cache": True}, {"result": "x"}, {"result": "y"}, {"error": "e"}, {"state": "failed"}]
    rows, now = [], dict(base)
    for i, change in enumerate(changes):
        now |= change
        rows.append({"job_id": 1, "seq": i, "ts": (T0 + timedelta(seconds=i)).isoformat()} | now)
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    want = [0, 2, 3, 4, 6, 7, 9, 10]
    assert sorted(r.seq for r in drain(streams.changes_only(streams.read_feed(spark, str(tmp_path / "feed"))), "seven", spark)) == want
    batch = spark.read.schema(streams.SNAPSHOT).json(str(tmp_path / "feed"))
    assert sorted(r.seq for r in jobs.changed_only(batch).collect()) == want


def test_fan_out_of_a_repeated_batch(spark, feed, tmp_path):
    """The first batch is run again after its first sink was written."""
    frame, sinks = feed(some_rows(20)), [str(tmp_path / "a"), str(tmp_path / "b")]
    spark.createDataFrame([(1,)], "job_id long").write.json(f"{sinks[0]}/batch=0")
    streams.fan_out(frame, sinks, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [spark.read.json(s).count() for s in sinks] == [20, 20]


CASES = [
    (["note", "cancel"], ("cancelled", 0)), (["start", "progress", "complete", "progress"], ("completed", 100)), (["cancel", "progress"], ("cancelled", 0)), (["start", "cancel", "progress", "complete"], ("cancelled", 0)),
    (["start", "progress", "cancel", "fail"], ("cancelled", 30)), (["start", "fail", "complete"], ("failed", 0)), (["start", "cancel"], ("cancelling", 0)),
]


def test_state_machine_as_stream_and_batch(spark, feed):
    rows = [(j, 100 * j + i, i, a, 30) for j, (actions, _) in enumerate(CASES) for i, a in enumerate(actions)]
    events = snapshots(spark, rows).withColumnRenamed("state", "action")
    assert {r.job_id: (r.state, r.percent) for r in jobs.state_machine(events).collect()} == {j: end for j, (_, end) in enumerate(CASES)}
    last = {}
    for r in sorted(drain(streams.state_machine(feed(rows)), "machine", spark), key=lambda r: r.seq):
        last[r.job_id] = (r.state, r.percent)
    assert last == {j: end for j, (_, end) in enumerate(CASES)}


def test_timing_stream_equals_batch_rates(spark, feed):
    rows = some_rows(60, 9)
    got = {}
    for r in sorted(drain(streams.timing(feed(rows)), "timing", spark), key=lambda r: r.seq):
        got[r.job_id] = r
    batch = jobs.smoothed_rates(snapshots(spark, rows)).collect()
    last = {r.job_id: r.session for r in jobs.sessions(snapshots(spark, rows)).orderBy("ts", "seq").collect()}
    want = {r.job_id: r.smoothed for r in batch if r.session == last[r.job_id]}
    assert {j: r.rate for j, r in got.items() if r.rate is not None} == pytest.approx(want)


def replay_timing(rows):
    """The rule for one snapshot after the other: samples of each job, trimmed, after every accepted one. rows: (job, seq, ms, state, percent, cached)."""
    held, out = {}, {}
    for job, seq, ms, state, percent, cached in rows:
        percent = min(100, max(0, percent or 0))
        if cached:
            held.pop(job, None)
        elif state in ("queued", "running", "cancelling"):
            samples = held.get(job, [])
            if samples and percent + 0.5 < samples[-1][1]:
                samples = []
            if samples and abs(samples[-1][1] - percent) < 0.5:
                continue
            samples = [s for s in samples if ms - s[0] <= 20_000] + [(ms, percent, seq)]
            held[job] = samples[-8:]
            out[job, seq] = [s[2] for s in held[job]]
    return out


def timed_rows(n, seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 9, 14])
        rows.append((rng.randint(1, 3), i, t * 1000, rng.choice(["queued", "running", "running", "running", "cancelling", "completed", "failed"]), rng.choice([None, 0, 5, 5, 6, 20, 40, 41, 150]), rng.random() < 0.06))
    return rows


def as_snapshots(spark, rows):
    data = [(j, T0 + timedelta(milliseconds=ms), s, st, p, c) for j, s, ms, st, p, c in rows]
    return spark.createDataFrame(data, "job_id long, ts timestamp_ntz, seq long, state string, percent int, from_cache boolean")


@pytest.fixture
def timed_feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)

    def make(rows, files):
        import json

        folder = tmp_path / "timed"
        folder.mkdir()
        for i in range(files):
            own = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
            lines = [json.dumps({"job_id": j, "seq": s, "ts": (T0 + timedelta(milliseconds=ms)).isoformat(), "state": st, "percent": p, "from_cache": c}) for j, s, ms, st, p, c in own]
            (folder / f"{i:03}.json").write_text("\n".join(lines))
            os.utime(folder / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        return streams.read_feed(spark, str(folder), files_per_batch=1)

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_terminal_and_cached_snapshots_add_no_samples(spark, seed):
    rows = timed_rows(150, seed)
    got = {(r.job_id, r.seq): [h.seq for h in r.held] for r in jobs.rolling_samples(as_snapshots(spark, rows)).collect()}
    assert got == replay_timing(rows) and any(len(x) == 8 for x in replay_timing([(1, i, i, "running", i, False) for i in range(20)]).values())


def test_timing_stream_ignores_terminal_and_cached_snapshots(spark, timed_feed):
    rows = timed_rows(120, 5)
    got = {(r.job_id, r.seq): r.measured for r in drain(streams.timing(timed_feed(rows, 3)), "timing2", spark)}
    batch = {(r.job_id, r.seq): r.measured for r in jobs.overall_rates(as_snapshots(spark, rows)).collect()}
    assert batch and all(got[k] == n for k, n in batch.items())
    assert all((r[0], r[1]) not in got for r in rows if r[5])


@pytest.mark.parametrize("files", [1, 4])
def test_stalls_by_timer_equal_the_batch_form(spark, timed_feed, files):
    rows = timed_rows(80, 7) + [(9, 900, 400_000, "running", 10, False), (8, 901, 400_000, "running", 10, False), (8, 902, 405_000, "completed", 100, False), (7, 903, 460_000, "running", 3, False)]
    want = sorted(tuple(r) for r in jobs.stalls(as_snapshots(spark, rows)).collect())
    got = sorted(tuple(r) for r in drain(streams.stalls(timed_feed(rows, files), "1 second"), f"stalls{files}", spark))
    # the last job's time has not come: the watermark stands at its only snapshot
    assert got == [r for r in want if r[1] != 903] and len(want) - len(got) == 1
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert (9, 900, 10.0, base + 412_000) in got and not any(r[0] == 8 for r in got)


def test_progress_without_a_percent_moves_nothing(spark, timed_feed):
    rows = [(1, 0, 0, "start", None, None), (1, 1, 1, "progress", 30, None), (1, 2, 2, "progress", None, None), (2, 3, 3, "progress", None, None)]
    got = {r.seq: (r.state, r.percent) for r in drain(streams.state_machine(timed_feed(rows, 2)), "nulls", spark)}
    assert got == {0: ("running", 0), 1: ("running", 30), 2: ("running", 30), 3: ("running", 0)}


def test_in_flight_stream_equals_the_batch_form_also_after_a_restart(spark, tmp_path):
    import json

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rng, folder, ck = random.Random(4), tmp_path / "starts", str(tmp_path / "ck")
    folder.mkdir()
    at = lambda m: T0 + timedelta(minutes=m)
    starts = [(rng.choice(["f", "f", "g", "h", None]), i, at(i), i, at(i + rng.randint(1, 9))) for i in range(60)]
    want = {r.job_id: r.ran_as for r in jobs.deduplicated_starts(spark.createDataFrame(starts, "fingerprint string, job_id long, ts timestamp_ntz, seq long, end_ts timestamp_ntz")).collect()}
    feed = sorted([(f, j, t, s, True) for f, j, t, s, _ in starts] + [(f, j, e, s, False) for f, j, _, s, e in starts], key=lambda r: (r[2], r[4], r[3]))
    got = {}
    for part in range(3):  # a query of its own each, from the checkpoint of the one before
        own = feed[len(feed) * part // 3 : len(feed) * (part + 1) // 3]
        (folder / f"{part}.json").write_text("\n".join(json.dumps({"fingerprint": f, "job_id": j, "ts": t.isoformat(), "seq": s, "start": b}) for f, j, t, s, b in own))
        rows = spark.readStream.schema("fingerprint string, job_id long, ts timestamp, seq long, start boolean").json(str(folder))
        query = streams.in_flight(rows).writeStream.format("json").option("checkpointLocation", ck).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    for r in spark.read.schema("fingerprint string, job_id long, ran_as long").json(str(tmp_path / "out")).collect():
        assert r.job_id not in got
        got[r.job_id] = r.ran_as
    assert got == want and len(set(want.values())) < 50


class HeldInMemory:
    """A map state, and how often it was asked."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def getMapState(self, name, key, value, ttl_ms):
        return self

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        self.asked += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_in_flight_takes_many_fingerprints_at_a_time():
    import pandas as pd

    rng, state = random.Random(8), HeldInMemory()
    own = streams.InFlight()
    own.init(state)
    feed = []
    for job in range(4000):
        fingerprint, at = rng.choice([None, *(f"f{n}" for n in range(300))]), rng.randrange(100_000)
        feed += [(fingerprint, job, at, job, True), (fingerprint, job, at + rng.randint(1, 9000), job, False)]
    feed.sort(key=lambda r: (r[2], r[4], r[3]))
    got, want, running = [], [], {}
    for rows in (feed[:3000], feed[3000:]):  # two batches, handed over in parts and out of order
        mixed = pd.DataFrame(rng.sample(rows, len(rows)), columns=["fingerprint", "job_id", "at", "seq", "start"])
        for out in own.handleInputRows((0,), iter([mixed[:1000], mixed[1000:]]), None):
            got += out.itertuples(index=False, name=None)
        for fingerprint, job, _, _, start in rows:
            if start:
                want.append((fingerprint, job, job if fingerprint is None else running.setdefault(fingerprint, job)))
            elif running.get(fingerprint) == job:
                del running[fingerprint]
        assert {k[0]: v[0] for k, v in state.rows.items()} == running
        assert bool(running) == (rows[-1] is not feed[-1])
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(want, key=key) and len({r[2] for r in want}) < 3500
    # once for each fingerprint of the second batch
    assert state.asked <= 300


def test_in_flight_stream_in_few_buckets(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    lines = lambda rows: "\n".join(f'{{"fingerprint": {f}, "job_id": {j}, "ts": "{(T0 + timedelta(minutes=m)).isoformat()}", "seq": {j}, "start": {b}}}' for f, j, m, b in rows)
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "0.json").write_text(lines([(f'"f{n % 40}"', n, n, "true") for n in range(50)] + [("null", 99, 1, "true"), ("null", 98, 2, "true")]))
    rows = streams.read_feed(spark, str(tmp_path / "feed"), "fingerprint string, job_id long, ts timestamp, seq long, start boolean")
    run = lambda: streams.in_flight(rows, buckets=3).writeStream.format("json").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    run()
    (tmp_path / "feed" / "1.json").write_text(lines([(f'"f{n}"', n, 60, "false") for n in range(20)] + [(f'"f{n}"', 100 + n, 61, "true") for n in range(40)]))
    run()
    got = {r.job_id: r.ran_as for r in spark.read.schema("fingerprint string, job_id long, ran_as long").json(str(tmp_path / "out")).collect()}
    assert got == {n: n % 40 for n in range(50)} | {99: 99, 98: 98} | {100 + n: 100 + n if n < 20 else n for n in range(40)}


def test_bursts_as_stream_and_batch(spark, timed_feed):
    rows = [(1, i, ms, "running", i, False) for i, ms in enumerate([0, 400, 900, 1900, 5000, 5001, 5999, 7001])] + [(2, 20, 8000, "running", 1, False), (3, 21, 60_000, "queued", 0, False), (1, 22, 100, "running", 99, False)]
    plain = lambda found: sorted((r.job_id, r.update.seq, r.updates) for r in found)
    # an update a second after the last one still belongs to the burst
    assert plain(jobs.coalesced(as_snapshots(spark, rows[:-1]), "1 second").collect()) == [(1, 3, 4), (1, 6, 3), (1, 7, 1), (2, 20, 1), (3, 21, 1)]
    # the last row comes behind the watermark; the burst at the watermark is still open
    got = drain(streams.coalesced(timed_feed(rows, len(rows)), "1 second", "2 seconds"), "bursts", spark)
    assert plain(got) == [(1, 3, 4), (1, 6, 3), (1, 7, 1), (2, 20, 1)]


def replay_store(puts, asks, went, recheck=60_000):
    held, out = {}, {}
    for at, turn, job, f, kind, path in sorted([(p[3], 0, 0, *p[:3]) for p in puts] + [(a[3], 1, a[0], a[1], a[2], None) for a in asks], key=lambda r: r[:3]):
        if f is None:
            if turn:
                out[job] = ("miss", None)
        elif turn == 0:
            held[f] = [kind, path, at]
        elif f not in held:
            out[job] = ("miss", None)
        else:
            own = held[f]
            if at - own[2] >= recheck:
                if went.get(own[1], -1) <= at:
                    del held[f]
                    out[job] = ("stale", None)
                    continue
                own[2] = at
            if own[0] != kind:
                del held[f]
                out[job] = ("kindMismatch", None)
            else:
                out[job] = ("hit", own[1])
    return out, sorted((f, *v) for f, v in held.items())


def test_result_store_against_a_replay(spark):
    rng = random.Random(11)
    went = {f"p{i}": rng.choice([10**9, 10**9, 400_000, 200_000]) for i in range(8)}
    puts = [(rng.choice(["a", "b", "c", None]), rng.choice(["r", "r", "s"]), f"p{rng.randint(0, 9)}", rng.randint(0, 500) * 1000) for _ in range(25)]
    puts = list({(p[0], p[3]): p for p in puts}.values())
    asks = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice(["r", "r", "r", "s"]), rng.randint(0, 900) * 1000) for i in range(150)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found, left = stores.result_store(
        frame(asks, "job_id long, fingerprint string, kind string, at_ms long"), frame(puts, "fingerprint string, kind string, path string, at_ms long"),
        frame([(p, None if g == 10**9 else g) for p, g in went.items()], "path string, gone_ms long"),
    )
    want, kept = replay_store(puts, asks, went)
    rows = found.collect()
    assert {r.job_id: (r.outcome, r.path) for r in rows} == want and len(rows) == 150
    assert sorted(tuple(r) for r in left.collect()) == kept and {o for o, _ in want.values()} == {"hit", "miss", "stale", "kindMismatch"}
    assert all((r.state, r.stage, r.percent, r.from_cache) == (("completed", "cacheHit", 100, True) if r.outcome == "hit" else (None, None, None, False)) for r in rows)


def test_null_fingerprints_and_sizes(spark):
    rows = [(None, 1, T0, 1, T0 + timedelta(minutes=9)), (None, 2, T0 + timedelta(minutes=1), 2, None)]
    starts = spark.createDataFrame(rows, "fingerprint string, job_id long, ts timestamp_ntz, seq long, end_ts timestamp_ntz")
    assert {r.job_id: r.ran_as for r in jobs.deduplicated_starts(starts).collect()} == {1: 1, 2: 2}
    used = spark.createDataFrame([("a", T0, 1, 5), ("b", T0, 2, None)], "key string, ts timestamp_ntz, seq long, size long")
    for limits in ({"max_bytes": 5}, {"max_bytes": 5, "capacity": 2}):
        assert sorted(tuple(r) for r in stores.lru(used, **limits).select("key", "size", "used_bytes").collect()) == [("a", 5, 5), ("b", 0, 0)]


def test_windowed_and_deduplicated_streams(spark, feed):
    rows = some_rows(40)
    counted = streams.state_counts(feed(rows), "1 minute", "1 minute")
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r.n for r in spark.table("counts").collect()) == 40
    assert len(drain(streams.deduplicated(feed(rows), "job_id", "1 hour"), "once", spark)) == 4


def test_fan_out(spark, feed, tmp_path):
    sinks = [str(tmp_path / "a"), str(tmp_path / "b")]
    query = streams.fan_out(feed(some_rows(20)), sinks, str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [spark.read.json(s).count() for s in sinks] == [20, 20]


def test_in_flight_dedupe(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("f", 1, at(0), 1, at(10)), ("f", 2, at(5), 2, at(30)), ("f", 3, at(12), 3, at(20)), ("g", 4, at(6), 4, at(7)), ("f", 5, at(19), 5, at(40))]
    starts = spark.createDataFrame(rows, "fingerprint string, job_id long, ts timestamp_ntz, seq long, end_ts timestamp_ntz")
    assert {r.job_id: r.ran_as for r in jobs.deduplicated_starts(starts).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def replay_lru(accesses, capacity, max_bytes, keep_one):
    held = {}
    for key, size in accesses:
        held.pop(key, None)
        held[key] = size
        while (capacity and len(held) > capacity) or (max_bytes and sum(held.values()) > max_bytes and len(held) > keep_one):
            held.pop(next(iter(held)))
    return sorted(held)


@pytest.mark.parametrize("capacity, max_bytes, keep_one", [(5, None, False), (None, 40, False), (None, 6, True), (4, 30, False)])
def test_lru_equals_replay(spark, capacity, max_bytes, keep_one):
    rng = random.Random(4)
    size = {k: rng.randint(1, 9) for k in range(15)}
    accesses = [(k, size[k]) for k in (rng.randrange(15) for _ in range(120))]
    df = spark.createDataFrame([(k, s, i, i) for i, (k, s) in enumerate(accesses)], "key long, size long, ts long, seq long")
    got = sorted(r.key for r in stores.lru(df, capacity, max_bytes, keep_one).collect())
    assert got == replay_lru(accesses, capacity, max_bytes, keep_one)


def test_state_machine_equals_a_fold(spark):
    rng = random.Random(12)
    kinds = ["start", "progress", "progress", "cancel", "complete", "fail", "note"]
    rows = [(rng.randint(1, 60), i, i, rng.choice(kinds), rng.randint(1, 99)) for i in range(300)]
    want = {}
    for job, _, _, action, percent in rows:
        state, done = want.get(job, ("queued", 0))
        if state in ("queued", "running", "cancelling"):
            if state != "cancelling" and action in ("progress", "complete"):
                done = 100 if action == "complete" else percent
            if action == "cancel":
                state = "cancelled" if state == "queued" else "cancelling"
            elif action in ("complete", "fail"):
                state = "cancelled" if state == "cancelling" else {"complete": "completed", "fail": "failed"}[action]
            elif state == "queued" and action in ("start", "progress"):
                state = "running"
        want[job] = (state, done)
    got = jobs.state_machine(snapshots(spark, rows).withColumnRenamed("state", "action")).collect()
    assert {r.job_id: (r.state, r.percent) for r in got} == want


def test_places_and_sums_in_ranges(spark):
    """Ties, nulls, one hot value and ranges without rows."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, rng.randint(0, 900)]), i, rng.choice([None, 0, 3, 9])) for i in range(700)]
    frame = spark.createDataFrame(rows, "t int, k long, size long").repartition(5)
    for descending in (False, True):
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=descending)
        want, before = {}, 0
        for place, (_, k, size) in enumerate(order, 1):
            want[k] = (place, before, sum(r[2] or 0 for r in rows))
            before += size or 0
        for groups in (1, 9, 300):
            got = running(frame, ("t", "k"), "size", descending, groups).collect()
            assert {r.k: (r.place, r.prior, r.total) for r in got} == want
    assert running(frame.limit(0), ("t", "k"), "size").count() == 0


@pytest.mark.parametrize("groups", [16, 200])
def test_eviction_of_two_million_files(spark, groups):
    """With a column more than the totals need, in many tasks and under adaptive execution."""
    n = 2_000_000
    files = spark.range(0, n, 1, 8).select(
        F.format_string("p%07d", "id").alias("path"), (F.col("id") * 7919 % 101 + 1).alias("size"), (F.col("id") * 104_729 % 5003).alias("mod_time"), F.sha1(F.col("id").cast("string")).alias("note")
    )
    ids = np.arange(n)
    size, time = ids * 7919 % 101 + 1, ids * 104_729 % 5003
    order = np.lexsort((ids, time))
    prior = np.concatenate([[0], np.cumsum(size[order])[:-1]])
    limit = int(size.sum() * 2 // 3)
    gone = order[size.sum() - prior > limit]
    got = stores.evict_oldest(files, limit, groups).agg(F.count(F.when(F.col("evicted"), 1)).alias("n"), F.sum(F.when(F.col("evicted"), F.substring("path", 2, 7).cast("long"))).alias("s")).first()
    assert (got.n, got.s) == (len(gone), int(gone.sum()))


def test_eviction_deletes_oldest_first(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", rng.randint(1, 50), rng.randint(0, 40)) for i in range(300)]
    left, gone = sum(r[1] for r in rows), set()
    for path, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if left > 2000:
            gone.add(path)
            left -= size
    got = stores.evict_oldest(spark.createDataFrame(rows, "path string, size long, mod_time long"), 2000, 7)
    assert {r.path for r in got.collect() if r.evicted} == gone


def test_manifest_counts_requests(spark):
    asked = [(" XRAY ", 3), ("xray", None), ("default", None), (None, 1), ("missing", 2)]
    found = requests.manifest_use(spark.createDataFrame(asked, "preset_id string, brightness int"))
    assert sorted((r.preset, r.asked, r.own_brightness) for r in found.collect()) == [("default", 1, 0), ("high-contrast", 0, 0), ("xray", 2, 1)]
    assert {(r.asked, r.own_brightness) for r in requests.manifest_use(spark.createDataFrame([], "preset_id string, brightness int")).collect()} == {(0, 0)}
