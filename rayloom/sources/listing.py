"""Files of folders as a DataFrame: listed by tasks, so that the driver holds none of their names.

A folder is listed by one task, which passes its files on as they come (local folders
are read entry by entry, of other stores a task holds one folder). Its subfolders are
listed in the next round, so there are as many rounds as folders are deep.
"""

from __future__ import annotations

import fnmatch
import functools
import math
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from rayloom.session import ship_package, written
from rayloom.sources import stores

#: Entries that a task passes on together, and folders that it lists.
TOGETHER, TASK_FOLDERS = 10_000, 100
_ENTRIES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def patterns(glob: str | None) -> list[str]:
    """Shell patterns without ``{a,b}``, any of which a name has to match."""
    if not glob:
        return ["*"]
    if not (braces := re.search(r"\{([^{}]*)\}", glob)):
        return [glob]
    return [p for choice in braces[1].split(",") for p in patterns(glob[: braces.start()] + choice + glob[braces.end() :])]


def entries(uri: str) -> Iterator[tuple[str, int, bool]]:
    """(URI, size, whether it is a folder) of what a folder holds; hidden names are left out, as Spark does."""
    system, root = stores.opened(uri)
    prefix = uri[: len(uri) - len(root)] if uri.endswith(root) else ""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(root) as inside:
            for entry in inside:
                if entry.name[:1] not in ("_", ".") and (entry.is_dir() or entry.is_file()):
                    yield f"{prefix}{root.rstrip('/')}/{entry.name}", 0 if entry.is_dir() else entry.stat().st_size, entry.is_dir()
        return
    for info in system.get_file_info(pafs.FileSelector(root.rstrip("/") or "/")):
        if info.base_name[:1] not in ("_", "."):
            yield prefix + info.path, info.size or 0, not info.is_file


def _listed(batches: Iterator[pa.RecordBatch], wanted: Sequence[str]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, bool]] = []
    whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRIES)], schema=_ENTRIES)
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for path, size, folder in entries(uri):
                if folder or any(fnmatch.fnmatch(path.rsplit("/", 1)[-1], p) for p in wanted):
                    rows.append((path, size, folder))
                if len(rows) >= TOGETHER:
                    yield whole()
                    rows.clear()
    if rows:
        yield whole()


def files(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, length) of the files at and below ``paths``, each once, written to the shared folder; a missing path is an error."""
    ship_package(spark)
    wanted, alone, folders = patterns(glob), [], []
    for uri in dict.fromkeys(paths):
        system, root = stores.opened(uri)
        at = system.get_file_info(root.rstrip("/") or "/")
        if at.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"path does not exist: {uri}")
        if not at.is_file:
            folders.append((uri,))
        elif any(fnmatch.fnmatch(at.base_name, p) for p in wanted):
            alone.append((uri, at.size))
    found = [spark.createDataFrame(alone, "path string, length long")] if alone or not folders else []
    level, n = spark.createDataFrame(folders, "path string"), len(folders)
    while n:
        spread = level.repartition(max(min(n, spark.sparkContext.defaultParallelism), math.ceil(n / TASK_FOLDERS)))
        inside, _ = written(spread.mapInArrow(lambda batches: _listed(batches, wanted), "path string, length long, folder boolean"), "listing")
        found.append(inside.filter("not folder").select("path", "length"))
        level = inside.filter("folder").select("path")
        n = level.count()
    every = functools.reduce(DataFrame.union, found)
    return every.distinct() if len(paths) > 1 else every
