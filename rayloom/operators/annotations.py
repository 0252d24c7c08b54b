"""Annotations: upsert, removal, line measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayloom.functions import geometry as geo


def upsert(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``changes`` over ``current``, both with ``ts``: the newest row of each key. One shuffle."""
    newest = F.max_by(F.struct("*"), "ts")
    return current.unionByName(changes).groupBy(key).agg(newest.alias("row")).select("row.*")


def remove(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return current.join(ids, key, "left_anti")


def measure_lines(lines: DataFrame) -> DataFrame:
    """Adds pixel_length, calibrated_mm, label and secondary to x1, y1, x2, y2, row_mm, col_mm."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    scaled = geo.calibrated_length(*ends, F.col("row_mm"), F.col("col_mm"))
    measured = lines.withColumns({"pixel_length": geo.pixel_length(*ends), "calibrated_mm": scaled})
    return measured.withColumns(
        {
            "label": geo.measurement_label(F.col("pixel_length"), F.col("calibrated_mm")),
            "secondary": geo.secondary_label(F.col("pixel_length"), F.col("calibrated_mm")),
        }
    )


def upsert_elements(defaults: DataFrame, preserved: DataFrame, pixel_module: DataFrame) -> DataFrame:
    """Data elements in ascending tag order; a later list replaces the same tag of an earlier one."""
    ranked = [df.withColumn("priority", F.lit(i)) for i, df in enumerate((defaults, preserved, pixel_module))]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    last = F.max_by(F.struct("vr", "value"), "priority")
    return every.groupBy("owner", "tag").agg(last.alias("e")).select("owner", "tag", "e.vr", "e.value")
