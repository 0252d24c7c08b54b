"""The event source against a local server that hangs up."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from rayloom.streaming import event_source, jobs
from rayloom.streaming.event_source import EventLog, EventReader, events_of


class Feed(ThreadingHTTPServer):
    """Serves ``events`` from the one after Last-Event-ID; hangs up in the middle of a line after every ``cut`` of them."""

    daemon_threads = True

    def __init__(self, ids=True, cut=3, overlap=1):
        super().__init__(("127.0.0.1", 0), Answer)
        self.events, self.ids, self.cut, self.overlap, self.asked = [], ids, cut, overlap, []
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}/api/v1/events"


class Answer(BaseHTTPRequestHandler):
    def do_GET(self):
        feed = self.server
        last = self.headers.get("Last-Event-ID")
        feed.asked.append((last, time.time()))
        at = max(0, int(last) + 1 - feed.overlap) if last else 0  # a careless server sends the last one again
        self.send_response(200)
        self.end_headers()
        for sent in range(feed.cut + feed.overlap):
            deadline = time.time() + 1
            while at >= len(feed.events) and time.time() < deadline:
                time.sleep(0.02)
            if at >= len(feed.events):
                return
            head = f"id: {at}\n" if feed.ids else ""
            self.wfile.write(f": a comment\n{head}data: {json.dumps(feed.events[at])}\n\ndata: no json\n\ndata: [1]\n\n".encode())
            self.wfile.flush()
            at += 1
        if at < len(feed.events):
            self.wfile.write(f"id: {at}\ndata: {json.dumps(feed.events[at])[:-9]}".encode())

    def log_message(self, *_):
        pass


def snapshot(n):
    return {"job_id": n % 4, "seq": n, "ts": "2024-01-01T00:00:00Z", "state": "running", "percent": n, "message": "ä b"}


@pytest.fixture
def feed():
    made = Feed()
    yield made
    made.shutdown()


def drained(query, sink, n, seconds=60):
    """What the folder holds once there are ``n`` rows."""
    deadline = time.time() + seconds
    while time.time() < deadline and query.isActive:
        rows = sink()
        if len(rows) >= n:
            return rows
        time.sleep(0.5)
    raise AssertionError(f"{len(sink())} of {n} rows, {query.exception()}")


def test_lines():
    lines = [b"id: 7\n", b'data: {"a": 1}\r\n', b"\n", b'data: {"b": "\xff"}\n', b'data:{"c": 1}\n', b"event: x\n", b"data: 3\n", b'data: {"d": 2}\n', b"data: {\n"]
    assert list(events_of(lines)) == [("7", '{"a": 1}'), (None, '{"d": 2}')]


def test_no_event_is_lost_or_taken_twice_also_after_a_restart(spark, tmp_path, feed):
    feed.events += [snapshot(n) for n in range(10)]
    out, checkpoint, log = (str(tmp_path / n) for n in ("out", "checkpoint", "log"))

    def rows():
        return sorted(r.seq for r in spark.read.schema("seq long, message string").json(out).collect()) if (tmp_path / "out").exists() else []

    def start():
        stream = event_source.read_events(spark, feed.url, log)
        return stream.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start(out)

    query = start()
    try:
        assert drained(query, rows, 10) == list(range(10))
        feed.events += [snapshot(n) for n in range(10, 13)]
        assert drained(query, rows, 13) == list(range(13))
    finally:
        query.stop()
    feed.events += [snapshot(n) for n in range(13, 20)]
    query = start()
    try:
        assert drained(query, rows, 20) == list(range(20))
        time.sleep(2)
        assert rows() == list(range(20))
    finally:
        query.stop()
    assert spark.read.schema("seq long, message string").json(out).filter("message = 'ä b'").count() == 20
    gaps = [b - a for (_, a), (_, b) in zip(feed.asked, feed.asked[1:])]
    assert min(gaps) >= 0.45 and feed.asked[0][0] is None and feed.asked[1][0] == "3"


def settled(reader, n):
    deadline = time.time() + 20
    while time.time() < deadline and (end := reader.latestOffset())["position"] < n:
        time.sleep(0.05)
    return end["position"]


def test_what_was_logged_before_spark_planned_it_is_read_after_a_restart(tmp_path, feed):
    """The reader is lost between writing a segment and telling Spark of it."""
    feed.events += [snapshot(n) for n in range(6)]
    options = {"url": feed.url, "log": str(tmp_path / "log"), "reconnectms": "50"}
    first = EventReader(options)
    assert settled(first, 6) == 6
    first.stop()
    feed.events += [snapshot(n) for n in range(6, 9)]
    second = EventReader(options)
    assert settled(second, 9) == 9
    texts = [t for s in second.partitions({"position": 0}, {"position": 9}) for b in second.read(s) for t in b.column("value").to_pylist()]
    assert [json.loads(t)["seq"] for t in texts] == list(range(9))
    second.commit({"position": 9})
    assert len(EventLog(options["log"]).segments()) == 1
    (*_, gone) = second.partitions({"position": 0}, {"position": 9})
    with pytest.raises(ValueError, match="no longer in the log"):
        list(second.read(gone))
    second.stop()


def test_room_is_bounded_and_feeds_without_ids(tmp_path):
    feed = Feed(ids=False, cut=50, overlap=0)
    feed.events += [snapshot(n) for n in range(40)]
    reader = EventReader({"url": feed.url, "log": str(tmp_path / "log"), "maxevents": "5", "keep": "true"})
    assert settled(reader, 40) >= 40
    sizes = [s.end - s.start for s in EventLog(str(tmp_path / "log")).segments()]
    assert max(sizes) <= 5 and len(sizes) >= 8
    reader.stop()
    feed.shutdown()
    with pytest.raises(ValueError, match="http"):
        EventReader({"url": "file:///etc/hosts", "log": str(tmp_path)})


def test_nobody_listens(spark, tmp_path):
    stream = event_source.read_events(spark, "http://127.0.0.1:9/none", str(tmp_path / "log"))
    assert stream.schema == jobs.read_feed(spark, str(tmp_path)).schema
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    time.sleep(3)
    assert query.isActive and query.exception() is None
    query.stop()
