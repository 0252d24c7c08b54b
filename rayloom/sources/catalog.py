"""The catalog of recent studies, for several writers.

A catalog is a folder of versions, ``00000000000000000012.json``; the greatest is
the catalog. A commit reads the latest version, makes the next from it and creates
its file exclusively; where another writer was first, it starts again from what
that one has left. So no update is lost, and readers see whole versions. Older
versions than the last ``KEPT`` are deleted. Paths and URIs are opened by Hadoop.

A missing or empty folder is an empty catalog, as is a list that is null. A version
that can't be read as JSON is moved to ``<version>.corrupt.json`` and is an error
once; its predecessor is the catalog again. The list has ten rows, so it is
kept on the driver.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.errors import CommandError
from rayloom.sources import stores

#: Fixed value: how many studies are remembered.
MOST = 10
#: Versions that stay, for readers that have just listed them.
KEPT = 5
ENTRY = "inputPath string, inputName string, measurementScale struct<rowSpacingMm:double,columnSpacingMm:double,source:string>, lastOpenedAt string"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    stems = (name.removesuffix(".json") for name in stores.names(spark, folder) if name.endswith(".json"))
    return sorted(int(stem) for stem in stems if stem.isdigit())


def _latest(spark: SparkSession, folder: str) -> tuple[int, list[dict]]:
    """(version, its entries); version 0 is empty."""
    while held := _versions(spark, folder):
        path = f"{folder}/{held[-1]:020d}.json"
        text = stores.read_text(spark, path)
        if text is None:  # deleted since it was listed: there are newer ones
            continue
        try:
            return held[-1], json.loads(text)["recentStudies"] or []
        except (ValueError, KeyError, TypeError):
            aside = path.replace(".json", ".corrupt.json")
            stores.rename(spark, path, aside)
            raise CommandError("cacheCorrupted", f"study catalog at {path} is invalid JSON, kept as {aside}: {text[:200]}") from None
    return 0, []


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The recent studies, newest first."""
    entries = _latest(spark, folder)[1]
    columns = ("inputPath", "inputName", "measurementScale", "lastOpenedAt")
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in entries], ENTRY)


def commit(spark: SparkSession, folder: str, change: Callable[[list[dict]], list[dict]], attempts: int = 100) -> int:
    """Makes the next version by ``change`` from the latest one's entries, anew as often as another writer is first; its number."""
    for attempt in range(attempts):
        version, entries = _latest(spark, folder)
        text = json.dumps({"recentStudies": change(entries)[:MOST]}, indent=2) + "\n"
        if stores.create_exclusive(spark, folder, f"{version + 1:020d}.json", text):
            for old in _versions(spark, folder):
                if old <= version + 1 - KEPT:
                    stores.delete(spark, f"{folder}/{old:020d}.json")
            return version + 1
        time.sleep(random.uniform(0, min(0.5, 0.01 * 2**attempt)))
    raise CommandError("conflict", f"study catalog at {folder} was changed by others {attempts} times")


def record_opened(spark: SparkSession, folder: str, opened: DataFrame, now: datetime | None = None) -> int:
    """Puts the studies of ``opened`` (as ``api.open_studies`` gives them) first, one entry per path; the version.

    Of many studies the ten first by path are taken (a top-k); rows that hold an
    ``error`` or no path aren't opened studies. A corrupt catalog is set aside and begun anew.
    """
    at = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    scale = F.when(F.col("scale").isNotNull(), F.struct(F.col("scale.row").alias("rowSpacingMm"), F.col("scale.col").alias("columnSpacingMm"), F.col("scale.source").alias("source")))
    entry = opened.filter("path is not null and error is null").select(F.col("path").alias("inputPath"), F.col("input_name").alias("inputName"), scale.alias("measurementScale"))
    new = [json.loads(r.e) | {"lastOpenedAt": at} for r in entry.dropDuplicates(["inputPath"]).orderBy("inputPath").limit(MOST).select(F.to_json(F.struct("*")).alias("e")).collect()]
    paths = {e["inputPath"] for e in new}

    def first(entries: list[dict]) -> list[dict]:
        return new + [e for e in entries if e.get("inputPath") not in paths]

    try:
        return commit(spark, folder, first)
    except CommandError as problem:
        if problem.code != "cacheCorrupted":
            raise
        return commit(spark, folder, first)
