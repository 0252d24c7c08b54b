"""Files of any store: what drivers ask of paths and what tasks read and write.

Drivers go through Hadoop's file system, as Spark's readers do. Tasks have no
such door from Python; they use Arrow's file systems, which open local paths and
object stores by the same URIs.
"""

from __future__ import annotations

import os
import uuid
from pathlib import PurePosixPath

import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def kind(spark: SparkSession, path: str) -> str | None:
    """``file``, ``folder``, or None where there is nothing."""
    system, at = _hadoop(spark, path)
    if not system.exists(at):
        return None
    return "folder" if system.getFileStatus(at).isDirectory() else "file"


def matching(spark: SparkSession, path: str) -> list[str]:
    """The full URIs that a path, or a pattern of paths, names; an error where there is none."""
    system, at = _hadoop(spark, path)
    if not (found := system.globStatus(at)):
        raise FileNotFoundError(f"path does not exist: {path}")
    return [status.getPath().toString() for status in found]


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Replaces what ``to`` names."""
    system, at = _hadoop(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    system.delete(target, True)
    if not system.rename(at, target):
        raise OSError(f"cannot rename {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a path or URI, in a task."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    system, at = _hadoop(spark, path)
    if not system.exists(at):
        return None
    file = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
    finally:
        file.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing where it is missing."""
    system, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def _written_aside(spark: SparkSession, folder: str, name: str, text: str):
    """(file system, path of a new hidden file with ``text``, path of ``folder/name``)."""
    system, at = _hadoop(spark, folder)
    system.mkdirs(at)
    aside, target = (system.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, n)) for n in (f".{name}.{uuid.uuid4().hex}", name))
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    return system, aside, target


def _renamed(spark: SparkSession, path, to, how: str) -> None:
    """A rename through ``FileContext``: atomic where the store's renames are."""
    kinds = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = getattr(kinds, how)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(path, to, options)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file of any store whole, over what is there."""
    folder, _, name = path.rpartition("/")
    system, aside, target = _written_aside(spark, folder or ".", name, text)
    try:
        _renamed(spark, aside, target, "OVERWRITE")
    finally:
        system.delete(aside, False)


def create_exclusive(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Writes ``folder/name`` whole, unless it is there: of several writers one gets True.

    The text is written aside first. Local files are then linked, which fails where
    the name is taken; other stores rename without overwriting, which is atomic in
    HDFS and its like (stores of objects that copy to rename can let two writers pass).
    """
    system, aside, target = _written_aside(spark, folder, name, text)
    try:
        if system.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            _renamed(spark, aside, target, "NONE")
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as problem:
        if problem.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    finally:
        system.delete(aside, False)


class RangedBytes:
    """The bytes of a file, read in blocks as slices ask for them; ``taken`` counts what was read."""

    def __init__(self, uri: str, size: int, block: int = 1 << 16):
        system, path = opened(uri)
        self._file, self._size, self._block = system.open_input_file(path), size, block
        self._at, self._held, self.taken = 0, b"", 0

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, key: slice) -> bytes:
        start, stop, _ = key.indices(self._size)
        if stop <= start:
            return b""
        if not (self._at <= start and stop <= self._at + len(self._held)):
            self._at, n = start, max(self._block, stop - start)
            self._held = self._file.read_at(min(n, self._size - start), start)
            self.taken += len(self._held)
        return self._held[start - self._at : stop - self._at]

    def close(self) -> None:
        self._file.close()


def write_file(folder: str, name: str, data: bytes) -> None:
    """Writes ``folder/name`` whole or not at all: each attempt of a task has a name of its own until it is done."""
    system, root = opened(folder)
    target = PurePosixPath(root) / name
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    part = target.with_name(f".{target.name}.{attempt}.part")
    system.create_dir(str(target.parent), recursive=True)
    with system.open_output_stream(str(part)) as out:
        out.write(data)
    system.move(str(part), str(target))
