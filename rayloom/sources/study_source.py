"""``spark.read.format("study")``: study files as a data source of their own.

The schema decides what is done: one with ``pixels`` decodes images, any other reads
headers by byte ranges. Files are dealt to partitions by the bytes that will be read,
largest first, so that neither many small files nor a few large ones make a long task,
and pushed conditions on ``path`` prune them before anything is opened.

``read`` lists the files once, when it is called, and deals them by tasks
(``listing``): a partition is a small table of files in the shared folder, and the
driver holds the names of these tables only. ``spark.read.format("study")`` alone has
no session where it plans: there the planning process lists the files, for each action
anew, and holds their names.

Options: ``path`` (or ``load(path)``; several as a JSON list), ``glob`` (on file
names), ``strict`` (default true: the first unreadable file fails the query; else
its row has an ``error``), ``partitionBytes`` (default 128 MB), ``partitionFiles``
(default 10,000), ``partitions`` (at least so many, where there are so many files).

Spark pushes conditions to Python sources where
``spark.sql.python.filterPushdown.enabled`` is true; ``register`` sets it. Paths and URIs are opened by Arrow's file systems;
``studies.read_pixels`` and ``read_metadata(ranged=False)`` serve stores that only
Spark can open. No file matching gives an empty result, a missing path an error.
"""

from __future__ import annotations

import fnmatch
import heapq
import json
import math
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from rayloom.operators import ranges
from rayloom.session import written
from rayloom.sources import listing, stores, studies

#: What opening a file and reading its header take, counted in bytes.
HEADER_BYTES = 1 << 17


@dataclass
class StudyFiles(InputPartition):
    """Files that one task reads: (URI, size) each, or the place of a table of them."""

    files: list[tuple[str, int]]
    table: str = ""


def listed(paths: Sequence[str], glob: str | None) -> list[tuple[str, int]]:
    """(URI, size) of the files at and below ``paths``; hidden ones (._) are left out, as Spark does."""
    found = []
    for uri in paths:
        system, root = stores.opened(uri)
        prefix = uri[: len(uri) - len(root)] if uri.endswith(root) else ""
        at = system.get_file_info(root.rstrip("/") or "/")
        if at.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"path does not exist: {uri}")
        inside = [at] if at.is_file else system.get_file_info(pafs.FileSelector(at.path, recursive=True))
        for info in inside:
            below = info.path[len(at.path) :].split("/")
            if info.is_file and not any(part[:1] in ("_", ".") for part in below) and (not glob or fnmatch.fnmatch(info.base_name, glob)):
                found.append((prefix + info.path, info.size))
    return sorted(set(found))


def keeps(condition: Filter, path: str) -> bool:
    """Whether a path meets a pushed condition."""
    value = condition.value
    if isinstance(condition, In):
        return path in value
    if isinstance(condition, EqualTo):
        return path == value
    if isinstance(condition, StringStartsWith):
        return path.startswith(value)
    if isinstance(condition, StringEndsWith):
        return path.endswith(value)
    return value in path


def dealt(files: list[tuple[str, int]], weight, most_bytes: int, most_files: int, least: int = 1) -> list[list[tuple[str, int]]]:
    """Files in partitions of near equal weight, and of ``most_files`` files at the most."""
    if not files:
        return []
    total = sum(weight(size) for _, size in files)
    count = max(math.ceil(total / most_bytes), math.ceil(len(files) / most_files), min(least, len(files)))
    emptiest = [(0, number) for number in range(count)]
    parts: list[list[tuple[str, int]]] = [[] for _ in range(count)]
    for file in sorted(files, key=lambda f: (-weight(f[1]), f[0])):
        held, number = heapq.heappop(emptiest)
        parts[number].append(file)
        if len(parts[number]) < most_files:
            heapq.heappush(emptiest, (held + weight(file[1]), number))
    return [sorted(part) for part in parts if part]


class StudySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study"

    def schema(self) -> str:
        return studies.METADATA

    def reader(self, schema: StructType) -> StudyReader:
        return StudyReader(schema, dict(self.options))


class StudyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.target, self.options = schema, options
        self.with_pixels = "pixels" in schema.names
        # the planning worker has no session that could parse the text of a schema
        known = dict(column.split(" ", 1) for column in (studies.PIXELS if self.with_pixels else studies.METADATA).split(", "))
        if unknown := [f.name for f in schema if f.dataType.simpleString() != known.get(f.name, "").replace("long", "bigint")]:
            raise ValueError(f"a study has no such columns, or of another type: {', '.join(unknown)}")
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if isinstance(condition, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and condition.attribute == ("path",):
                self.conditions.append(condition)
            else:
                yield condition

    def partitions(self) -> Sequence[StudyFiles]:
        if tables := self.options.get("tables"):
            return [StudyFiles([], uri) for uri, _, folder in listing.entries(tables) if not folder]
        path = self.options.get("path", "")
        paths = json.loads(path) if path.startswith("[") else [path]
        found = [f for f in listed(paths, self.options.get("glob")) if all(keeps(c, f[0]) for c in self.conditions)]
        weight = (lambda size: size + HEADER_BYTES) if self.with_pixels else (lambda size: min(size, HEADER_BYTES) + HEADER_BYTES)
        number = lambda name, default: int(self.options.get(name, default))
        parts = dealt(found, weight, number("partitionbytes", 128 << 20), number("partitionfiles", 10_000), number("partitions", 1))
        return [StudyFiles(part) for part in parts]

    def read(self, partition: StudyFiles) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, strict = to_arrow_schema(self.target), self.options.get("strict", "true").lower() == "true"
        for path, size in self._files(partition) if partition else ():
            data = stores.RangedBytes(path, size)
            try:
                row = studies.pixel_row(path, data[0:size]) if self.with_pixels else studies.metadata_row(path, data)
            except (ValueError, struct.error) as problem:
                if strict:
                    raise ValueError(f"{path}: {problem}") from None
                row = {"path": path, "error": str(problem)}
            finally:
                data.close()
            # a batch per file: the largest image bounds what is held
            yield pa.RecordBatch.from_pylist([{name: row.get(name) for name in self.target.names}], schema=arrow)


    def _files(self, partition: StudyFiles) -> Iterator[tuple[str, int]]:
        yield from partition.files
        if partition.table:
            system, place = stores.opened(partition.table)
            with system.open_input_file(place) as file:
                for batch in pq.ParquetFile(file).iter_batches():
                    for path, size in zip(*(batch.column(name).to_pylist() for name in ("path", "length"))):
                        if all(keeps(c, path) for c in self.conditions):
                            yield path, size


def dealt_tables(found: DataFrame, weight: Column, most_bytes: int, most_files: int, least: int = 1) -> str:
    """Writes ``found`` (path, length) as tables of near equal weight and ``most_files`` rows at the most; their folder.

    A file of at least an equal share of all gets a table of its own, the others are
    dealt in turn by falling weight.
    """
    weighed, _ = written(found.withColumn("weight", weight), "study-listing")
    n, total = weighed.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    count = max(1, math.ceil(total / most_bytes), math.ceil(n / most_files), min(least, n))
    large = weighed.filter(F.col("weight") * count >= total).count()
    rest = max(count - large, math.ceil((n - large) / most_files), 1)
    at = F.col("place") - 1
    part = F.when(at < large, at).otherwise(large + F.pmod(at - large, F.lit(rest))).cast("int")
    placed = ranges.running(weighed, ["weight", "path"], descending=True).select("path", "length", part.alias("part"))
    parts = placed.repartitionById(large + (rest if n > large else 0) or 1, F.col("part")).sortWithinPartitions("path")
    return written(parts.select("path", "length"), "study-files")[1]


def register(spark: SparkSession) -> None:
    """Makes ``study`` known to the session, and this package to its tasks."""
    from rayloom.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StudySource)


def read(spark: SparkSession, path: str | list[str], pixels: bool = False, **options) -> DataFrame:
    """The files at ``path`` as a DataFrame: headers, or decoded images."""
    register(spark)
    given = {name.lower(): value for name, value in options.items()}
    found = listing.files(spark, [path] if isinstance(path, str) else path, given.pop("glob", None))
    length, header = F.col("length"), F.lit(HEADER_BYTES)
    weight = (length if pixels else F.least(length, header)) + header
    tables = dealt_tables(found, weight, int(given.pop("partitionbytes", 128 << 20)), int(given.pop("partitionfiles", 10_000)), int(given.pop("partitions", 1)))
    reader = spark.read.format("study").schema(studies.PIXELS if pixels else studies.METADATA)
    for name, value in given.items():
        reader = reader.option(name, value)
    return reader.option("tables", tables).load()
