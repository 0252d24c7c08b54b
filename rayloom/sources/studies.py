"""Study files as DataFrames.

Files are listed and split by Spark's ``binaryFile`` source, and a path filter
prunes them before their bytes are read. The kernels run per file inside
``mapInArrow``. Header scans don't read contents: tasks open the files and read
blocks up to the pixel data, so what they cost doesn't grow with the images.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.errors import CommandError
from rayloom.functions import text as tx
from rayloom.sources import dicom, raster, stores
from rayloom.sources.stores import RangedBytes

_SPACING = "struct<row:double,col:double>"
METADATA = (
    "path string, rows int, columns int, samples_per_pixel int, bits_allocated int, bits_stored int, pixel_representation int, "
    f"planar_configuration int, number_of_frames long, pixel_data_encoding string, photometric string, transfer_syntax_uid string, "
    f"pixel_spacing {_SPACING}, imager_spacing {_SPACING}, nominal_spacing {_SPACING}, window_center double, window_width double, "
    "scale struct<row:double,col:double,source:string>, error string"
)
_ELEMENT = "struct<tag_group:int,tag_element:int,vr:string,values:array<string>>"
PIXELS = (
    "path string, width int, height int, pixels array<float>, min_value double, max_value double, window_center double, "
    f"window_width double, invert boolean, study_uid string, preserved array<{_ELEMENT}>, "
    "scale struct<row:double,col:double,source:string>, error string"
)


def files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _is_standalone(path: str) -> bool:
    return path.rsplit(".", 1)[-1].strip().lower() in tx.STANDALONE_EXTENSIONS


def _pair(value) -> dict | None:
    return dict(zip(("row", "col"), value)) if value else None


def _scale(study: dicom.Study) -> dict | None:
    return dict(zip(("row", "col", "source"), found)) if (found := study.scale()) else None


def metadata_row(path: str, data: bytes | RangedBytes) -> dict:
    """Header fields of one file; BMP and TIFF files stand in when DICOM parsing fails."""
    try:
        study = dicom.read(data)
    except ValueError:
        if not _is_standalone(path):
            raise
        width, height, kind = raster.config(data)
        if max(width, height) > 65535:
            raise ValueError("image is larger than 65535 pixels") from None
        gray, bits = kind.startswith("gray"), 16 if kind.endswith(("16", "64")) else 8
        study = dicom.Study(
            {
                "rows": height, "columns": width, "samples_per_pixel": 1 if gray else 3, "bits_allocated": bits, "bits_stored": bits,
                "photometric": "MONOCHROME2" if gray else "RGB", "number_of_frames": 1, "pixel_data_encoding": "native",
            }
        )
    numbers = ("rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "pixel_representation", "planar_configuration", "number_of_frames")
    row = {n: study.get(n) for n in numbers} | {n: study.get(n, "") for n in ("pixel_data_encoding", "photometric")}
    row |= {n: _pair(study.get(n, None)) for n in ("pixel_spacing", "imager_spacing", "nominal_spacing")}
    row |= {n: study.get(n, None) for n in ("window_center", "window_width")}
    return row | {"path": path, "transfer_syntax_uid": study.transfer_syntax_uid, "scale": _scale(study), "error": None}


def pixel_row(path: str, data: bytes) -> dict:
    """The decoded image of one file."""
    try:
        study = dicom.read(data, with_pixels=True)
    except ValueError:
        if not _is_standalone(path):
            raise
        image = raster.decode(data)
        study = dicom.Study(width=image.width, height=image.height, pixels=raster.gray_values(image))
    values, window = study.pixels, study.window or (None, None)
    return {
        "path": path, "width": study.width, "height": study.height, "pixels": values,
        "min_value": float(values.min()) if len(values) else 0.0, "max_value": float(values.max()) if len(values) else 0.0,
        "window_center": window[0], "window_width": window[1], "invert": study.invert,
        "study_uid": study.study_uid or dicom.uid_from(path), "scale": _scale(study), "error": None,
        "preserved": [{"tag_group": t >> 16, "tag_element": t & 0xFFFF, "vr": vr, "values": v} for t, vr, v in study.preserved_elements()],
    }


def _decode(found: DataFrame, row, schema: str, strict: bool, ranged: bool = False) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for path, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = RangedBytes(path, held.as_py()) if ranged else held.as_py()
                try:
                    out = row(path, data)
                except (ValueError, struct.error) as problem:
                    if strict:
                        raise ValueError(f"{path}: {problem}") from None
                    out = {"path": path, "error": str(problem)}
                finally:
                    if ranged:
                        data.close()
                # a batch per file: the largest image bounds what is held
                yield pa.RecordBatch.from_pylist([{f.name: out.get(f.name) for f in target}], schema=arrow)

    return found.select("path", "length" if ranged else "content").mapInArrow(run, target)


def read_metadata(spark: SparkSession, path: str | list[str], strict: bool = True, glob: str | None = None, ranged: bool = True) -> DataFrame:
    """One row of header fields per file. Strict: the first unreadable file fails the query; else it gets an ``error``.

    ``ranged`` reads blocks of files in place; without it whole contents come
    through Spark, for stores that only Spark can open (files up to 2 GB).
    """
    return _decode(files(spark, path, glob), metadata_row, METADATA, strict, ranged)


def read_pixels(spark: SparkSession, path: str | list[str], strict: bool = True, glob: str | None = None) -> DataFrame:
    """One row per file with the decoded image in packed form."""
    return _decode(files(spark, path, glob), pixel_row, PIXELS, strict)


def as_images(decoded: DataFrame) -> DataFrame:
    """Decoded files in the packed form of the image operators."""
    return decoded.withColumn("image_id", F.col("path"))


_CATALOG = (
    "recentStudies array<struct<inputPath:string,inputName:string,measurementScale:struct<rowSpacingMm:double,columnSpacingMm:double,source:string>,lastOpenedAt:string>>, "
    "_corrupt_record string"
)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recent studies, corrupt texts) of a catalog written as JSON; a missing file is empty, as is a null list."""
    if stores.kind(spark, path) is None:
        found = spark.createDataFrame([], "value string")
    else:
        found = spark.read.text(path, wholetext=True)
    # a parsed column, not a source's own one, so that either side can be read alone
    parsed = found.select(F.from_json("value", _CATALOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("c")).select("c.*")
    studies = parsed.filter("_corrupt_record is null").select(F.explode("recentStudies").alias("s")).select("s.*")
    return studies, parsed.filter("_corrupt_record is not null").select("_corrupt_record")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The recent studies. A corrupt file is moved aside first, so that the next write can't hide it, and is an error then."""
    studies, corrupt = read_catalog(spark, path)
    if bad := corrupt.first():
        stem, dot, extension = path.rpartition(".")
        aside = f"{stem}.corrupt.{extension}" if dot and "/" not in extension else f"{path}.corrupt"
        stores.rename(spark, path, aside)
        raise CommandError("cacheCorrupted", f"study catalog at {path} is invalid JSON, kept as {aside}: {bad[0][:200]}")
    return studies
