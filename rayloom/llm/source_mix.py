"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the budget in proportion to its weight, but never
more than ``max_epochs`` times its own size. What a clamped source cannot take
is dealt again to the others by weight, until no source is above its cap. The
fixed point of those rounds is found in one pass: with the sources ordered by
cap / weight, exactly a prefix of them is clamped, so running sums of caps and
weights give the final water level.

Documents are then repeated: each as often as the whole part of
target / source size says, and one time more for a seeded selection whose words
add up to the fractional part. The selection runs in hash buckets of bounded
size within each source, in hash order, until the bucket's share is reached; a
bucket is off by half a document at most and a hot source is spread over many
tasks.

Defined results for odd input: a null text has size 0; null is a source like any
other and comes last; sources of size 0 get target 0; a null id is hashed as the
text ``null``; repeated rows are separate documents; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import WORD, materialise

#: A source table of up to so many rows is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000
_EXACT = "decimal(38,0)"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def rank_weights(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Adds ``weight``: ``weights`` in turn to the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return sizes.withColumn("weight", F.get(cycle, place % len(weights)).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight, ...): a row for each source.

    The budget is the sum of all sizes. The window has no partition key on
    purpose: its input is one aggregated row per source.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(after))
        .withColumn(
            "fits",
            cap.cast(_EXACT) * F.col("heavy").cast("decimal(19,0)")
            >= F.col("weight").cast("decimal(19,0)") * F.col("left").cast(_EXACT),
        )
    )
    level = F.first(F.when(F.col("fits"), F.col("left").cast("double") / F.col("heavy").cast("double")), True)
    return (
        filled.withColumn("level", level.over(everything))
        .withColumn(
            "target",
            F.when(F.col("fits"), F.col("weight").cast("double") * F.col("level")).otherwise(cap.cast("double")),
        )
        .drop("left", "heavy", "fits", "level")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    bucket_rows: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document.

    ``copies`` is how often the mix repeats the document and ``taken`` its words
    in the mix. ``carry`` names further input columns to keep in a struct ``row``.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    kept = [F.struct(*carry).alias("row")] if carry else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), key.alias("key"), *kept
    )
    if not carry:
        sized = materialise(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = materialise(water_fill(rank_weights(sizes, weights), max_epochs), "mix-targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    looked_up = (F.broadcast(targets) if small else targets).withColumnRenamed("source", "target_source")

    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("source_rows") / bucket_rows)
    drawn = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucket = Window.partitionBy("source", "bucket")
    run = bucket.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = (F.col("run") * 2 - F.col("size")).cast("double") <= F.col("part") * F.col("bucket_size") * 2
    return (
        sized.join(looked_up, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("whole", F.floor(share))
        .withColumn("part", share - F.col("whole"))
        .withColumn("bucket", drawn % buckets)
        .withColumn("run", F.sum("size").over(run))
        .withColumn("bucket_size", F.sum("size").over(bucket))
        .withColumn("copies", F.col("whole") + F.when((F.col("part") > 0) & extra, 1).otherwise(0))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []),
        )
    )
