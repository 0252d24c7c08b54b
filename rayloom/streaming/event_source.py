"""``spark.readStream.format("events")``: a feed of server-sent events over HTTP.

A connection is held open by the source's reader, which the query keeps beside the
driver. What arrives is written to ``log``, a folder that all executors share, in
segments of whole events, each moved into place before its end becomes an offset.
Tasks read the segments, so events don't pass through the plan, and a batch that is
run again reads the same files. An offset is a count of events in the log: after a
restart the log says what has been taken, whatever Spark had planned of it.

As the feed's other readers do, only lines ``data: {...}`` count; those that aren't
a JSON object are dropped, as is the rest of a line that a hang-up has cut. After a
hang-up or an error the connection is made anew 500 ms later. Where the server
gives ids, the last one is sent with the new request (``Last-Event-ID``), and an event
whose id and text are among the last ``remembered`` ones is not taken twice. Events that
a server without ids sends while nobody listens are lost: it has no way to ask for them.

Options: ``url``, ``log`` (of one query alone, as its checkpoint is), ``maxEvents``
(waiting and in one segment, default 10,000; the connection is not read on beyond them),
``remembered`` (default 10,000), ``reconnectMs`` (500), ``keep`` (default false: segments
behind a finished batch are deleted, but for the last).

No event gives no segment and no new offset. The folder may be empty or missing at first.
"""

from __future__ import annotations

import hashlib
import json
import queue
import threading
import time
import urllib.request
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from http.client import HTTPException

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rayloom.sources import stores
from rayloom.streaming.jobs import SNAPSHOT

EVENTS = "position long, arrived_ms long, id string, value string"
DATA, IDENTITY = b"data: ", b"id:"


@dataclass
class Segment(InputPartition):
    """A file of the log that holds the events of an offset range; None where it is gone."""

    path: str | None
    start: int
    end: int


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader(dict(self.options))


def events_of(lines) -> Iterator[tuple[str | None, str]]:
    """(id, JSON text) of the events in lines of bytes."""
    identity = None
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line.startswith(IDENTITY):
            identity = line[len(IDENTITY) :].decode("utf-8", "replace").strip() or None
        elif line.startswith(DATA):
            try:
                text = line[len(DATA) :].decode()
                if isinstance(json.loads(text), dict):
                    yield identity, text
            except ValueError:
                continue
        elif not line:
            identity = None


class EventLog:
    """Segments ``<start>-<end>.jsonl`` of a folder; each line is [arrived_ms, id, text]."""

    def __init__(self, folder: str):
        self.folder = folder

    def segments(self) -> list[Segment]:
        system, root = stores.opened(self.folder)
        found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        held = [tuple(map(int, info.base_name.removesuffix(".jsonl").split("-"))) for info in found if info.is_file and info.base_name.endswith(".jsonl") and info.base_name[0] != "."]
        return [Segment(f"{self.folder}/{self.name(start, end)}", start, end) for start, end in sorted(held)]

    def name(self, start: int, end: int) -> str:
        return f"{start:019d}-{end:019d}.jsonl"

    def append(self, start: int, events: list[tuple[int, str | None, str]]) -> int:
        end = start + len(events)
        stores.write_file(self.folder, self.name(start, end), "".join(json.dumps(e) + "\n" for e in events).encode())
        return end

    def read(self, segment: Segment) -> list[list]:
        system, path = stores.opened(segment.path)
        with system.open_input_stream(path) as file:
            return [json.loads(line) for line in file.read().splitlines()]

    def drop(self, upto: int) -> None:
        """Deletes segments that end at ``upto`` or before, but for the log's last."""
        system, _ = stores.opened(self.folder)
        for segment in self.segments()[:-1]:
            if segment.end <= upto:
                system.delete_file(stores.opened(segment.path)[1])


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.log = options["url"], EventLog(options["log"].rstrip("/"))
        if not self.url.startswith(("http://", "https://")):
            raise ValueError(f"events are read over http or https: {self.url}")
        number = lambda name, default: int(options.get(name, default))
        self.most, self.remembered, self.pause = number("maxevents", 10_000), number("remembered", 10_000), number("reconnectms", 500) / 1000
        self.keep = options.get("keep", "false").lower() == "true"
        self.thread: threading.Thread | None = None

    def initialOffset(self) -> dict:
        held = self.log.segments()
        return {"position": held[0].start if held else 0}

    def latestOffset(self) -> dict:
        """Writes what has arrived to the log, and says where that ends."""
        if self.thread is None:
            self._listen()
        events = []
        while len(events) < self.most:
            try:
                events.append(self.waiting.get_nowait())
            except queue.Empty:
                break
        if events:
            self.position = self.log.append(self.position, events)
        return {"position": self.position}

    def partitions(self, start: dict, end: dict) -> Sequence[Segment]:
        start, end = start["position"], end["position"]
        held = [s for s in self.log.segments() if start <= s.start and s.end <= end]
        # Spark plans the last finished batch once more after a restart, and doesn't run it
        missing = sum(s.end - s.start for s in held) < end - start
        return held + ([Segment(None, start, end)] if missing else [])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            raise ValueError(f"events {partition.start} to {partition.end} are no longer in the log {self.log.folder}")
        events = self.log.read(partition)
        arrived, identities, texts = zip(*events)
        positions = range(partition.start, partition.end)
        columns = [pa.array(positions, pa.int64()), pa.array(arrived, pa.int64()), pa.array(identities, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["position", "arrived_ms", "id", "value"])

    def commit(self, end: dict) -> None:
        if not self.keep:
            self.log.drop(end["position"])

    def stop(self) -> None:
        if self.thread is not None:
            self.ended.set()

    def __getstate__(self) -> dict:
        # tasks get the log and the options, not the connection
        return self.__dict__ | {"thread": None, "waiting": None, "ended": None, "seen": None}

    def _listen(self) -> None:
        self.waiting: queue.Queue = queue.Queue(self.most)
        self.ended = threading.Event()
        self.seen: OrderedDict[tuple[str, bytes], None] = OrderedDict()
        self.position, self.last = 0, None
        for segment in self.log.segments():
            self.position = segment.end
            for _, identity, text in self.log.read(segment):
                self._is_new(identity, text)
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _is_new(self, identity: str | None, text: str) -> bool:
        if identity is None:
            return True
        self.last = identity
        key = (identity, hashlib.sha256(text.encode()).digest())
        new = key not in self.seen
        self.seen[key] = None
        self.seen.move_to_end(key)
        while len(self.seen) > self.remembered:
            self.seen.popitem(last=False)
        return new

    def _run(self) -> None:
        while not self.ended.is_set():
            headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": self.last} if self.last else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers)) as answer:
                    for identity, text in events_of(answer):
                        if self._is_new(identity, text) and not self._hand_over((time.time_ns() // 1_000_000, identity, text)):
                            return
            except (OSError, ValueError, HTTPException):  # refused, hung up, cut off, or no answer that can be read
                pass
            self.ended.wait(self.pause)

    def _hand_over(self, event: tuple[int, str | None, str]) -> bool:
        """Waits for room; False where the query has ended meanwhile."""
        while not self.ended.is_set():
            try:
                self.waiting.put(event, timeout=0.2)
                return True
            except queue.Full:
                continue
        return False


def read_events(spark: SparkSession, url: str, log: str | None = None, schema: str = SNAPSHOT, **options) -> DataFrame:
    """The feed at ``url`` as a stream of ``schema``, as ``jobs.read_feed`` has it from files.

    Without ``log`` a new folder under the shared one is taken; name one to go on after a restart.
    """
    from rayloom.session import shared_folder, ship_package

    ship_package(spark)
    spark.dataSource.register(EventSource)
    reader = spark.readStream.format("events").option("url", url).option("log", log or f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(F.from_json("value", schema).alias("s")).filter("s.job_id is not null").select("s.*")
