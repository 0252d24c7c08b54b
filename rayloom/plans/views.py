"""The driver's tables as the engine's inputs.

Nothing here is limited or sampled: every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8x8 images of real values."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform("embedding", lambda x: x.cast("double")).alias("pixels"),
    )


def img_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as 12-bit stored samples."""
    packed = img_packed(spark, sf_dir)
    return packed.withColumn("pixels", F.transform("pixels", lambda v: F.floor((v + 1.0) * 2048.0).cast("int")))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed images with ``gray``, on their full range."""
    from rayloom.operators import images

    return images.render(images.with_range(img_packed(spark, sf_dir)), "full")


def pixels_of(packed: DataFrame, **columns: str) -> DataFrame:
    """(image_id, pos, ...) of one or more array columns of equal length."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in columns.items()])
    return packed.select("image_id", F.posexplode(zipped).alias("pos", "p")).select("image_id", "pos", *[F.col(f"p.{n}") for n in columns])


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as long-form images: an order is an image, a quantity a gray value."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").cast("int").alias("g"))


#: Fixed mapping of event types to job states.
STATES = {"signup": "queued", "view": "running", "click": "cancelling", "purchase": "completed", "error": "failed"}


def job_state(event_type: Column) -> Column:
    out = F.lit("queued")
    for event, state in STATES.items():
        out = F.when(event_type == event, state).otherwise(out)
    return out


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as snapshots: a user is a job, whole percents."""
    rows = table(spark, sf_dir, "events")
    percent = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value")))).cast("int")
    return rows.select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), job_state(F.col("event_type")).alias("state"), percent.alias("percent")
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_events``, one in 29 of them from a cache."""
    return job_events(spark, sf_dir).withColumn("from_cache", F.col("seq") % 29 == 0)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows as line annotations; one in three images has no scale."""
    rows = table(spark, sf_dir, "lineitem")
    scaled = F.col("l_linenumber") % 3 != 0
    return rows.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("x1"), F.col("l_suppkey").cast("double").alias("y1"),
        (F.col("l_partkey") + F.col("l_quantity")).alias("x2"), (F.col("l_suppkey") + F.col("l_discount") * 100.0).alias("y2"),
        F.when(scaled, 0.2).alias("row_mm"), F.when(scaled, 0.3).alias("col_mm"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as processing requests, some of them invalid."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.when(k % 4 == 0, " XRAY ").when(k % 4 == 1, "default").when(k % 4 == 2, "high-contrast").otherwise(F.when(k % 3 == 0, "missing").otherwise("xray")).alias("preset_id"),
        (k % 5 == 0).alias("invert"),
        F.when(k % 3 != 0, ((F.col("p_size") - 25) * 12).cast("int")).alias("brightness"),
        F.when(k % 7 != 0, F.round(F.col("p_retailprice") / 1000.0 * 10.0) / 10.0 - 0.3).alias("contrast"),
        F.when(k % 6 != 0, k % 2 == 0).alias("equalize"),
        (k % 9 == 0).alias("compare"),
        F.when(k % 8 == 0, " Hot ").when(k % 8 == 1, "BONE").when(k % 8 == 2, "magma").when(k % 8 == 3, "").alias("palette"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as DICOM text values."""
    p = table(spark, sf_dir, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    text = (
        F.when(k % 5 == 0, size)
        .when(k % 5 == 1, F.concat(size, F.lit(" \\ "), (k % 7).cast("string"), F.lit(" ")))
        .when(k % 5 == 2, F.concat(F.lit("0."), size, F.lit("\\0.5\\9")))
        .when(k % 5 == 3, F.concat(F.lit("x"), size, F.lit("\\1")))
        .otherwise("  ")
    )
    return p.select("p_partkey", "p_type", "p_size", text.alias("text"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` rows as study headers: ``source`` stands for a syntax, ``lang`` for an encoding."""
    d = table(spark, sf_dir, "documents")
    k, source = F.col("doc_id"), F.col("source")
    return d.select(
        k.alias("doc_id"), F.concat(F.lit("studies/"), k.cast("string"), F.lit(".dcm")).alias("path"),
        (k % 2048 + 1).cast("int").alias("rows"), (k % 1024 + 1).cast("int").alias("columns"),
        F.when(k % 10 == 0, 3).otherwise(1).alias("samples_per_pixel"), F.when(k % 3 == 0, 16).otherwise(8).alias("bits_allocated"),
        F.when(k % 3 == 0, 12).otherwise(8).alias("bits_stored"), F.lit(0).alias("pixel_representation"), F.lit(0).alias("planar_configuration"),
        F.when(k % 50 == 0, 4).otherwise(1).cast("long").alias("number_of_frames"),
        F.when(F.col("lang") == "de", "encapsulated").otherwise("native").alias("pixel_data_encoding"),
        F.when(k % 10 == 0, "RGB").otherwise("MONOCHROME2").alias("photometric"),
        F.when(source == "src0", "1.2.840.10008.1.2.1").when(source == "src1", "1.2.840.10008.1.2").when(source == "src2", "").otherwise("1.2.840.10008.1.2.4.50").alias("transfer_syntax_uid"),
    )
