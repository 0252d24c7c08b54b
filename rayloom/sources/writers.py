"""Sinks: PNG, JPEG and DICOM Secondary Capture files, and the catalog.

Encoding is a function of the row, so it runs in tasks and yields binary columns;
``save_files`` and ``file_sink`` write them, to a path that executors share or to an
object store. A row whose encoding fails has an ``error`` and writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayloom.sources import dicom, file_sink, jpeg, raster, stores


def _samples(width: int, height: int, flat: np.ndarray) -> np.ndarray:
    if width <= 0 or height <= 0 or len(flat) not in (width * height, width * height * 4):
        raise ValueError(f"preview of {len(flat)} values does not fit {width}x{height}")
    samples = np.asarray(flat, np.uint8)
    return samples.reshape(height, width) if len(flat) == width * height else samples.reshape(height, width, 4)


def flat_values(column: str) -> F.Column:
    """gray (array of int) as it is, rgba (array of struct) as r, g, b, a in turn."""
    return F.flatten(F.transform(column, lambda p: F.array(p["r"], p["g"], p["b"], p["a"])))


def _encode(df: DataFrame, columns: list, function, *out: str) -> DataFrame:
    """Adds the binary columns ``out`` and ``error``; other columns travel in a struct."""
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    packed = df.select(F.struct("*").alias("row"), *columns)
    schema = StructType([packed.schema["row"], *(StructField(o, BinaryType()) for o in out), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, errors = [], []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:])):
                try:
                    made = function(*values)
                    files.append(made if len(out) > 1 else (made,))
                    errors.append(None)
                except ValueError as problem:
                    files.append((None,) * len(out))
                    errors.append(str(problem))
            binaries = [pa.array([f[at] for f in files], pa.binary()) for at in range(len(out))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *binaries, pa.array(errors, pa.string())], ["row", *out, "error"])

    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in (*out, "error")]
    return packed.mapInArrow(run, schema).select(*kept, *out, "error")


def _capture(samples: np.ndarray, study: str | None, preserved: list | None, when: datetime, uid_seed: str | None) -> bytes:
    count = iter(range(100))
    uid = (lambda: dicom.uid_from(f"{uid_seed}/{study}/{next(count)}")) if uid_seed else dicom.uid_from
    kept = [(e["tag_group"] << 16 | e["tag_element"], e["vr"], e["values"]) for e in preserved or []]
    return dicom.secondary_capture(samples, study or "", kept, when, uid)


def encode_png(df: DataFrame, values: F.Column | str = "gray") -> DataFrame:
    """Adds ``png`` for width, height and a flat array of 8-bit values (one or four per pixel)."""
    flat = F.col(values) if isinstance(values, str) else values
    return _encode(df, [F.col("width"), F.col("height"), flat.alias("flat")], lambda w, h, v: raster.encode_png(_samples(w, h, v)), "png")


def encode_jpeg(df: DataFrame, values: F.Column | str = "gray", quality: int = jpeg.QUALITY) -> DataFrame:
    """Adds ``jpg`` for width, height and a flat array of 8-bit values (one or four per pixel; opacity is left out)."""
    flat = F.col(values) if isinstance(values, str) else values
    return _encode(df, [F.col("width"), F.col("height"), flat.alias("flat")], lambda w, h, v: jpeg.encode(_samples(w, h, v), quality), "jpg")


def encode_secondary_capture(df: DataFrame, values: F.Column | str = "gray", now: datetime | None = None, uid_seed: str | None = None) -> DataFrame:
    """Adds ``dicom`` for width, height, study_uid, preserved and flat 8-bit values.

    With ``uid_seed`` and ``now`` the bytes are the same in every run, else UIDs are random.
    """
    when = now or datetime.now().astimezone()
    flat = F.col(values) if isinstance(values, str) else values

    def encode(w, h, study, preserved, v):
        return _capture(_samples(w, h, v), study, preserved, when, uid_seed)

    return _encode(df, [F.col("width"), F.col("height"), F.col("study_uid"), F.col("preserved"), flat.alias("flat")], encode, "dicom")


def encode_both(df: DataFrame, values: F.Column | str = "gray", now: datetime | None = None, uid_seed: str | None = None) -> DataFrame:
    """Adds ``png`` and ``dicom`` in one pass over the images; an image that one of them can't hold has an ``error`` and neither."""
    when = now or datetime.now().astimezone()
    flat = F.col(values) if isinstance(values, str) else values

    def encode(w, h, study, preserved, v):
        samples = _samples(w, h, v)
        return raster.encode_png(samples), _capture(samples, study, preserved, when, uid_seed)

    return _encode(df, [F.col("width"), F.col("height"), F.col("study_uid"), F.col("preserved"), flat.alias("flat")], encode, "png", "dicom")


def save_files(df: DataFrame, name: str, content: str, folder: str) -> int:
    """Writes ``content`` of each row to ``folder/name``, all or nothing (``file_sink``), and returns how many files were written.

    ``folder`` is a path or URI that all executors reach. Two rows of one name are
    an error; it and any other failure leave the files of earlier runs as they are.
    """
    return file_sink.save(df.select(F.col(name).alias("stem"), F.lit("").alias("key"), F.col(content).alias("file")), folder)["file"]


def write_catalog(recent: DataFrame, path: str) -> None:
    """The recent-studies list (ten rows at most) as indented JSON, at a path or URI; for several writers see ``catalog``."""
    rows = [json.loads(r) for r in recent.limit(10).toJSON().collect()]
    stores.replace_text(recent.sparkSession, path, json.dumps({"recentStudies": rows}, indent=2) + "\n")
