"""Large native images in bands of rows, so that many tasks share one image.

Headers are read by byte ranges and say where each file's samples lie. A band is a
small row (path, first_row, band_rows and where its bytes are); bands are dealt to
tasks before any pixel is read, and a task reads the byte ranges of its own bands,
one at a time. So neither the size of a file nor that of an image bounds what can be
done; ``band_bytes`` bounds what a task holds, beside a megabyte of small bands.

Rendering needs an image's least and greatest value, equalization its histogram.
Both are merged from per-band partial results and joined to the bands, not to
their pixels: pixels are read again where they lie (three passes in all) and never
shuffled. Such a join brings the bands of an image together, so they are dealt anew
before each pass. The bands with their ranges are written once to the shared folder.

* Only native single-frame samples have bands. Compressed ones, several frames and
  files that are not DICOM are an error, or with ``strict=False`` a row with ``error``.
* Null or repeated paths can't come out of a listing; a file listed twice is read once.
* An empty folder gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions import kernels
from rayloom.functions import pixels as px
from rayloom.operators import images
from rayloom.session import written
from rayloom.sources import dicom, listing, stores, studies, study_source

#: Header fields that decoding a band needs.
_KEPT = ("samples_per_pixel", "bits_allocated", "bits_stored", "pixel_representation", "planar_configuration", "photometric")
LAYOUT = (
    "path string, size long, width int, height int, at long, byte_order string, samples_per_pixel int, bits_allocated int, bits_stored int, pixel_representation int, "
    "planar_configuration int, photometric string, slope double, intercept double, window_center double, window_width double, invert boolean, "
    "study_uid string, scale struct<row:double,col:double,source:string>, error string"
)
_KEYS = ("path", "first_row", "band_rows", "width", "height")
#: Small bands whose rows go back to Spark together, and the bytes of values from which they go at once.
TOGETHER, HELD_BYTES = 64, 1 << 20
_BAND = "path string, first_row int, band_rows int, width int, height int"


@dataclass(frozen=True)
class Bands:
    """One row per band (its layout, first_row and band_rows), and the count of tasks to deal them to."""

    rows: DataFrame
    tasks: int

    def where(self, condition) -> Bands:
        return replace(self, rows=self.rows.filter(condition))


def _layout_row(path: str, data: stores.RangedBytes) -> dict:
    study = dicom.read(data, calibrated=True)
    if study.get("pixel_data_encoding") != "native":
        raise ValueError(f"row bands need native pixel data, this is {study.get('pixel_data_encoding')}")
    if study.get("number_of_frames") > 1:
        raise ValueError(f"row bands need a single frame, this has {study.get('number_of_frames')}")
    needed = study.get("rows") * study.get("columns") * study.get("samples_per_pixel") * (study.get("bits_allocated") // 8)
    held = min(study.pixels_length, len(data) - study.pixels_at)
    if held < needed:
        raise ValueError(f"dicom frame has {held} bytes, needs {needed}")
    # what is no image of this kind fails here, before its bands are dealt
    dicom.decode_native(dicom.Study(study.meta | {"rows": 0}), b"", study.order)
    center, width = study.get("window_center", None), study.get("window_width", None)
    windowed = center is not None and width is not None and width > 1
    return {name: study.get(name, "" if name == "photometric" else 0) for name in _KEPT} | {
        "path": path, "size": len(data), "width": study.get("columns"), "height": study.get("rows"), "at": study.pixels_at, "byte_order": study.order,
        "slope": study.slope, "intercept": study.intercept, "window_center": center if windowed else None, "window_width": width if windowed else None,
        "invert": study.get("photometric", "").upper() == "MONOCHROME1", "study_uid": study.study_uid or dicom.uid_from(path), "scale": studies._scale(study), "error": None,
    }


def layouts(spark: SparkSession, path: str | list[str], strict: bool = True, glob: str | None = None, task_bytes: int = 128 << 20) -> DataFrame:
    """One row per file: where its samples lie and how to read them. Tasks list the files, and the listing is dealt to tasks by its count."""
    paths = [path] if isinstance(path, str) else path
    found = listing.files(spark, [root for one in paths for root in stores.matching(spark, one)], glob)
    return studies._decode(found.repartition(_tasks(spark, found.count(), 0, task_bytes)), _layout_row, LAYOUT, strict, ranged=True)


def _tasks(spark: SparkSession, parts: int, size: int, task_bytes: int) -> int:
    """How many tasks read ``parts`` parts of files, ``size`` bytes in all: by the bytes, of which opening takes its share, and no more than parts."""
    weight = size + parts * study_source.HEADER_BYTES
    return max(1, min(parts, max(math.ceil(weight / task_bytes), spark.sparkContext.defaultParallelism)))


def bands(spark: SparkSession, path: str | list[str], strict: bool = True, glob: str | None = None, band_bytes: int = 8 << 20, task_bytes: int = 128 << 20) -> Bands:
    """The bands of all files, of about ``band_bytes`` each (one row of pixels at the least), in tasks of about ``task_bytes``.

    Headers are read here, once, and their layouts written; the count of tasks comes
    from the bands that they say, so small files share tasks. A file without bands keeps one
    row with its ``error`` (``strict=False``).
    """
    row_bytes = F.col("width").cast("long") * F.col("samples_per_pixel") * F.col("bits_allocated") / 8
    step = F.greatest(F.lit(1), F.floor(F.lit(band_bytes) / row_bytes)).cast("int")
    laid = written(layouts(spark, path, strict, glob, task_bytes), "row-band-layouts")[0].withColumn("step", step)
    sized = laid.filter("error is null").agg(F.sum(F.ceil(F.col("height") / F.col("step"))).alias("bands"), F.sum(row_bytes * F.col("height")).cast("long").alias("size")).first()
    starts = F.when(F.col("error").isNull(), F.sequence(F.lit(0), F.col("height") - 1, F.col("step")))
    cut = laid.select("*", F.explode_outer(starts).alias("first_row"))
    rows = cut.withColumn("band_rows", F.least("step", F.col("height") - F.col("first_row"))).drop("step")
    return Bands(rows, _tasks(spark, sized.bands or 0, sized.size or 0, task_bytes))


def _samples(file, band: dict) -> np.ndarray:
    """The values of a band, read from its byte ranges."""
    sample, colours = band["bits_allocated"] // 8, band["samples_per_pixel"]
    planes = colours if colours > 1 and band["planar_configuration"] == 1 else 1
    row = band["width"] * sample * colours // planes
    raw = b"".join(file.read_at(band["band_rows"] * row, band["at"] + (plane * band["height"] + band["first_row"]) * row) for plane in range(planes))
    study = dicom.Study({name: band[name] for name in _KEPT} | {"rows": band["band_rows"], "columns": band["width"]}, slope=band["slope"], intercept=band["intercept"])
    dicom.decode_native(study, raw, band["byte_order"])
    return study.pixels


def through_bands(bands: Bands, function, schema: str) -> DataFrame:
    """``function(band, values)`` gives the rows of each band, as dicts of ``schema``; bands with an error give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                out, held = [], 0
                for band in batch.slice(start, TOGETHER).to_pylist():
                    system, place = stores.opened(band["path"])
                    with system.open_input_file(place) as file:
                        values = _samples(file, band)
                    out += function(band, values)
                    held += values.nbytes
                    if held >= HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return bands.rows.filter("error is null").repartition(bands.tasks).mapInArrow(run, target)


def decode(bands: Bands) -> DataFrame:
    """(path, first_row, band_rows, width, height, pixels) of every band."""
    return through_bands(bands, lambda band, values: [{k: band[k] for k in _KEYS} | {"pixels": values}], f"{_BAND}, pixels array<float>")


def with_range(bands: Bands) -> Bands:
    """Adds min_value and max_value of the whole image to its bands: one row per band is shuffled."""
    partial = through_bands(bands, lambda band, v: [{"path": band["path"], "low": float(v.min()), "high": float(v.max())}], "path string, low double, high double")
    merged = partial.groupBy("path").agg(F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    return replace(bands, rows=written(bands.rows.join(merged, "path", "left"), "row-bands")[0])


def _gray(band: dict, values: np.ndarray, mode: str, center: float | None, width: float | None) -> np.ndarray:
    if mode == "default":
        center, width = band["window_center"], band["window_width"]
    one = lambda x: np.array([np.nan if x is None else x], np.float64)
    inverted = np.array([bool(band["invert"])])
    shown = kernels.render_values(values, np.zeros(len(values), np.int8), one(band["min_value"]), one(band["max_value"]), one(center), one(width), inverted, mode)
    return shown.astype(np.uint8)


def render(ranged: Bands, mode: str = "default", center: float | None = None, width: float | None = None) -> DataFrame:
    """(path, first_row, band_rows, width, height, gray binary) of the bands that ``with_range`` gave."""
    shown = lambda band, v: [{k: band[k] for k in _KEYS} | {"gray": _gray(band, v, mode, center, width).tobytes()}]
    return through_bands(ranged, shown, f"{_BAND}, gray binary")


def histogram(ranged: Bands, mode: str = "default", center: float | None = None, width: float | None = None) -> DataFrame:
    """(image_id, g, n) of whole images; a band sends 256 rows at the most."""

    def counted(band, values):
        counts = np.bincount(_gray(band, values, mode, center, width), minlength=256)
        return [{"image_id": band["path"], "g": int(g), "n": int(counts[g])} for g in counts.nonzero()[0]]

    return through_bands(ranged, counted, "image_id string, g int, n long").groupBy("image_id", "g").agg(F.sum("n").alias("n"))


def equalize(ranged: Bands, mode: str = "default", center: float | None = None, width: float | None = None) -> DataFrame:
    """(path, first_row, band_rows, width, height, gray binary): rendered, then through the table of the whole image's histogram.

    Tables of 256 numbers, one per image, are joined to the bands. ``ranged`` holds
    all bands of an image, or the histogram is that of the bands it holds.
    """
    cumulative = images.cumulative_histogram(histogram(ranged, mode, center, width))
    level = px.equalized(F.col("g"), F.col("cdf"), F.col("cdf_min"), F.col("total"))
    entries = F.collect_list(F.struct(F.col("g"), level.alias("to")))
    tables = cumulative.groupBy(F.col("image_id").alias("path")).agg(entries.alias("levels"))

    def looked_up(band, values):
        table = np.zeros(256, np.uint8)
        for entry in band["levels"]:
            table[entry["g"]] = entry["to"]
        return [{k: band[k] for k in _KEYS} | {"gray": table[_gray(band, values, mode, center, width)].tobytes()}]

    return through_bands(replace(ranged, rows=ranged.rows.join(tables, "path")), looked_up, f"{_BAND}, gray binary")
