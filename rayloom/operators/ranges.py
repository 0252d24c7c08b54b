"""Places and running totals over a whole table, with no window over all rows.

Rows are dealt to ranges of their order and written once with the number of their
range, so that every use of them sees the same ranges and what gave the rows runs no
more. Rows and totals per range come first (one row per range), then a window inside
each range. Any bounds give the same answer; Spark's sample only makes the ranges
alike in size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rayloom.session import written


def running(rows: DataFrame, order: Sequence[str], size: str | None = None, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 1), and with ``size``: ``prior`` (sum of those before) and ``total``.

    ``order`` names the columns of the order, all in one direction; nulls are
    smallest. Rows that are alike in all of them share a range, in any order.
    ``ranges`` is how many there are, as many as the session shuffles to by default.
    """
    weight = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(0)
    keys = [F.asc_nulls_first(c) for c in order]
    dealt = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).withColumn("_part", F.spark_partition_id())
    held, _ = written(dealt, "ranges")
    way = F.desc("_part") if descending else F.asc("_part")
    # one row per range, so few that one task may order them
    before = Window.orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(weight).alias("_size"))
    starts = sums.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_prior"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    own = Window.partitionBy("_part").orderBy(*[F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in order])
    placed = held.join(F.broadcast(starts), "_part").withColumn("place", (F.col("_first") + F.row_number().over(own)).cast("long"))
    if size:
        inside = F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1))
        placed = placed.withColumns({"prior": F.col("_prior") + F.coalesce(inside, F.lit(0)), "total": F.col("_total")})
    return placed.drop("_part", "_first", "_prior", "_total")
