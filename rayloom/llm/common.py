"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as runs of anything but ASCII white space; Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a temporary folder;
    on a cluster, whose executors would not see such a folder, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rayloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_working: ContextVar[list[str] | None] = ContextVar("working", default=None)


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts the lineage in storage that every executor sees, so a lost
    executor costs a re-read and not a recomputation. Inside ``working_tables``
    the table goes at the end unless it is ``lasting``.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (held := _working.get()) is not None and not lasting:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what was materialised inside: tables that no result reads any more."""
    token = _working.set([])
    try:
        yield
    finally:
        paths = _working.get()
        _working.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, parts: int, part: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``part`` modulo
    ``parts``; a null id is in no such fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))
