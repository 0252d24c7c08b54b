"""The commands of the engine as functions over paths and DataFrames.

Each command plans one lazy DataFrame; nothing runs until a sink or an action
does. Study paths may name a file, a folder or a list of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.errors import CommandError
from rayloom.functions import kernels
from rayloom.functions import pixels as px
from rayloom.functions import text as tx
from rayloom.operators import annotations, corpus, images, jobs, requests
from rayloom.sources import catalog, file_sink, jpeg, stores, studies, writers


@dataclass(frozen=True)
class Controls:
    """What to do with a rendered image; None takes the preset's value."""

    preset: str = requests.DEFAULT_PRESET
    invert: bool = False
    brightness: int | None = None
    contrast: float | None = None
    equalize: bool = False
    palette: str | None = None
    compare: bool = False

    def resolved(self) -> Controls:
        """All values filled in from the preset; the rules are those of ``requests.resolve``."""
        known = {p[1]: p[2:] for p in requests.PRESETS}
        base = known.get(self.preset.strip().lower())
        if base is None:
            raise CommandError("invalidInput", f"preset must be one of {', '.join(known)}")
        brightness = base[0] if self.brightness is None else self.brightness
        contrast = base[1] if self.contrast is None else self.contrast
        palette = base[4] if self.palette is None else (self.palette.strip().lower() or "none")
        if not -256 <= brightness <= 256:
            raise CommandError("invalidInput", "brightness must be between -256 and 256")
        if not 0 <= contrast < float("inf"):
            raise CommandError("invalidInput", "contrast must be a finite number >= 0")
        if palette not in ("none", "hot", "bone"):
            raise CommandError("invalidInput", "palette must be one of none, hot, bone")
        return replace(
            self, invert=self.invert or base[2], brightness=brightness, contrast=contrast, equalize=self.equalize or base[3], palette=palette
        )


def processing_manifest(spark: SparkSession) -> DataFrame:
    return requests.presets(spark)


def _found(plan) -> DataFrame:
    try:
        return plan()
    except AnalysisException as problem:
        raise CommandError("notFound", str(problem).splitlines()[0]) from None


def open_studies(spark: SparkSession, path: str | list[str], strict: bool = True, ranged: bool = True) -> DataFrame:
    """Header fields, file name and measurement scale of study files; ``ranged=False`` for stores that only Spark can open."""
    found = _found(lambda: studies.read_metadata(spark, path, strict, ranged=ranged))
    return found.withColumn("input_name", tx.file_name(F.col("path")))


def open_study(spark: SparkSession, path: str) -> DataFrame:
    """One study file: a missing one is notFound, a folder invalidInput, a store that can't be asked internal."""
    try:
        kind = stores.kind(spark, path)
    except Exception as problem:
        raise CommandError("internal", f"failed to inspect input file {path}: {str(problem).splitlines()[0]}") from None
    if kind is None:
        raise CommandError("notFound", f"input file does not exist: {path}")
    if kind == "folder":
        raise CommandError("invalidInput", f"input path must be a file: {path}")
    return open_studies(spark, path)


def output_path(spark: SparkSession, path: str | None, cache: str, fingerprint: str) -> str:
    """Where a process job writes: the given file, or an artifact of the cache that repeated runs replace."""
    if path is None:
        return f"{cache}/artifacts/process/{fingerprint}.dcm"
    path = path.strip()
    if path in ("", "."):
        raise CommandError("invalidInput", "outputPath is required when provided")
    if stores.kind(spark, path) == "folder":
        raise CommandError("invalidInput", f"output path must be a file: {path}")
    parent = path.rstrip("/").rpartition("/")[0] or ("/" if path.startswith("/") else ".")
    kind = stores.kind(spark, parent)
    if kind is None:
        raise CommandError("notFound", f"output directory does not exist: {parent}")
    if kind == "file":
        raise CommandError("invalidInput", f"output directory must be a directory: {parent}")
    return path


def inspect_decode(spark: SparkSession, path: str | list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a profile per file, the one-row summary)."""
    found = open_studies(spark, path, strict)
    return corpus.profiles(found), corpus.summarize(found)


def render(spark: SparkSession, path: str | list[str], mode: str = "default", center: float | None = None, width: float | None = None, strict: bool = True) -> DataFrame:
    """Decoded files with ``gray``; mode default, full or manual."""
    if mode not in ("default", "full", "manual"):
        raise CommandError("invalidInput", f"unknown window mode: {mode}")
    decoded = studies.as_images(_found(lambda: studies.read_pixels(spark, path, strict)))
    return images.render(decoded, mode, center, width)


def process(rendered: DataFrame, controls: Controls) -> DataFrame:
    """``gray`` after the point operations and equalization, ``rgba`` where there is a palette or a comparison, and ``mode``."""
    c = controls.resolved()
    out = rendered.withColumn("plain", F.col("gray"))
    if c.invert or c.brightness or c.contrast != 1.0:
        out = out.withColumn("gray", kernels.through(F.col("gray"), px.point_table(c.invert, c.brightness, c.contrast)))
    if c.equalize:
        out = images.equalize_packed(out).withColumn("gray", F.col("equalized")).drop("equalized")
    if c.palette != "none" or c.compare:
        out = images.palette(out, c.palette if c.palette != "none" else "gray")
    if c.compare:
        left = out.withColumn("left", F.transform("plain", px.gray_rgba))
        out = images.compare_packed(left, "left", "rgba").drop("rgba", "left").withColumnRenamed("both", "rgba")
    values = (c.invert, c.brightness, float(c.contrast), c.equalize, c.palette, c.compare)
    return out.drop("plain").withColumn("mode", tx.mode_label(*map(F.lit, values)))


def export(processed: DataFrame, folder: str, now: datetime | None = None, uid_seed: str | None = None) -> dict[str, int]:
    """Writes a PNG and a Secondary Capture per image to ``folder``, a path that all executors share; counts of files.

    Each file is decoded, rendered and encoded once, and nothing shows in
    ``folder`` before all is done. Files of one base name from several folders get
    a hash of their path in the name of the output; any clash left is an error. An
    image that can't be encoded is left out.
    """
    values = writers.flat_values("rgba") if "rgba" in processed.columns else F.col("gray")
    both = writers.encode_both(processed, values, now, uid_seed)
    stem = F.regexp_replace(tx.output_name(F.col("path")), r"\.dcm$", "")
    written = file_sink.save(both.select(stem.alias("stem"), F.col("path").alias("key"), "png", F.col("dicom").alias("dcm")), folder)
    return {"png": written["png"], "dicom": written["dcm"]}


def previews(rendered: DataFrame, folder: str, quality: int = jpeg.QUALITY) -> int:
    """Writes a JPEG per image to ``folder``, all or nothing, under the names that ``export`` gives; how many."""
    values = writers.flat_values("rgba") if "rgba" in rendered.columns else F.col("gray")
    stem = F.regexp_replace(tx.output_name(F.col("path")), r"\.dcm$", "")
    return file_sink.save(writers.encode_jpeg(rendered, values, quality).select(stem.alias("stem"), F.col("path").alias("key"), "jpg"), folder)["jpg"]


def recent_studies(spark: SparkSession, folder: str) -> DataFrame:
    """The studies opened last, from the catalog in ``folder``."""
    return catalog.load(spark, folder)


def remember(spark: SparkSession, folder: str, opened: DataFrame) -> int:
    """Puts opened studies into the catalog, whoever else writes to it; its version."""
    return catalog.record_opened(spark, folder, opened)


def job_snapshots(snapshots: DataFrame, ids: list[int]) -> DataFrame:
    """The latest snapshot of each asked job, in the order asked; unknown ids are left out."""
    asked = snapshots.sparkSession.createDataFrame(list(enumerate(ids)), "place int, job_id long")
    return jobs.batch_get(asked, snapshots)


def measure_lines(lines: DataFrame) -> DataFrame:
    return annotations.measure_lines(lines)


def cancel(spark: SparkSession, job: str) -> list[str]:
    """Interrupts what runs under ``spark.addTag(job)``."""
    return list(spark.interruptTag(job))
