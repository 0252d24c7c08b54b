"""Corpus inspection: profiles, distinct sets, conditional counts, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.functions import text as tx

PROFILE = (
    "path", "rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "pixel_representation", "planar_configuration",
    "number_of_frames", "pixel_data_encoding", "photometric", "transfer_syntax_uid",
)
SETS = ("transfer_syntax_uid", "pixel_data_encoding", "photometric", "samples_per_pixel", "bits_allocated", "number_of_frames")


def profiles(metadata: DataFrame) -> DataFrame:
    return metadata.select(*PROFILE)


def counts() -> dict[str, Column]:
    """Aggregates over profiles; all of them fit one partially aggregated pass."""
    count = lambda condition: F.count(F.when(condition, 1))
    return {
        "study_count": F.count("*"),
        "encapsulated_count": count(F.col("pixel_data_encoding") == "encapsulated"),
        "compressed_count": count(~tx.is_uncompressed(F.col("transfer_syntax_uid"))),
        "color_count": count(F.col("samples_per_pixel") > 1),
        "multi_frame_count": count(F.col("number_of_frames") > 1),
    }


def warnings(summary: DataFrame) -> Column:
    """The warnings of a summary row, in a fixed order."""
    c = F.col
    # fixed values: the texts of the warnings
    several = F.array(
        F.when(F.size("transfer_syntax_uid_set") == 1, "sample set contains one transfer syntax"),
        F.when(c("encapsulated_count") == 0, "sample set contains no encapsulated pixel data"),
        F.when(c("compressed_count") == 0, "sample set contains no compressed transfer syntaxes"),
        F.when(c("multi_frame_count") == 0, "sample set contains no multi-frame studies"),
    )
    return F.when(c("study_count") == 0, F.array(F.lit("no studies inspected"))).otherwise(F.filter(several, lambda w: w.isNotNull()))


def summarize(metadata: DataFrame) -> DataFrame:
    """One row: counts, a sorted set of the values of each of ``SETS``, warnings.

    The sets hold distinct values of header fields and so stay small; they are
    collected per task before the one-row shuffle.
    """
    sets = {f"{name}_set": F.array_sort(F.collect_set(F.coalesce(F.col(name), F.lit("" if name in SETS[:3] else 0)))) for name in SETS}
    out = profiles(metadata).agg(*[v.alias(n) for n, v in (counts() | sets).items()])
    return out.withColumn("warnings", warnings(out))


def decode_summary(decoded: DataFrame) -> DataFrame:
    """What a decode found, without the pixels: size, count, range, window, scale, and how many elements are kept."""
    window = F.when(F.col("window_center").isNotNull() & (F.col("window_width") > 1), F.struct(F.col("window_center").alias("center"), F.col("window_width").alias("width")))
    return decoded.select(
        "path", "width", "height", F.lit("gray-f32").alias("format"), F.coalesce(F.size("pixels"), F.lit(0)).alias("pixel_count"), "min_value", "max_value",
        window.alias("default_window"), "invert", "scale", "study_uid", F.coalesce(F.size("preserved"), F.lit(0)).alias("preserved_element_count"),
    )
