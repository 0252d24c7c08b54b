"""Queries through files and streams.

Tables are written as studies, feeds and catalogs into the shared folder by the
sinks, and what the sources and streams read there is the result. A run has folders
of its own; their files grow with the tables.
"""

from __future__ import annotations

import math
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom import api
from rayloom.operators import images, requests
from rayloom.plans import record_queries as records
from rayloom.plans import views as v
from rayloom.plans.catalog import SQL, query
from rayloom.plans.image_queries import FULL
from rayloom.session import shared_folder
from rayloom.sources import catalog, row_bands, study_source
from rayloom.streaming import jobs as streams

NOW = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
#: Images that a task exports.
TASK_IMAGES = 1000


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ studies


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a PNG and a Secondary Capture of each row of ``embeddings``: 64 pixels in three shapes."""
    k, packed = F.col("image_id"), v.img_packed(spark, sf_dir)
    # small rows make many files: dealt by their count, not by the bytes of the table
    tasks = max(math.ceil(packed.count() / TASK_IMAGES), spark.sparkContext.defaultParallelism)
    rendered = images.render(images.with_range(packed.repartition(tasks)), "full")
    width = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(4)), (k % 3 + 1).cast("int"))
    shown = rendered.withColumns({
        "path": F.concat(F.lit("image-"), k.cast("string"), F.lit(".dcm")), "width": width, "height": F.lit(64) / width,
        "study_uid": F.concat(F.lit("1.2."), k.cast("string")), "preserved": F.lit(None).cast("array<struct<tag_group:int,tag_element:int,vr:string,values:array<string>>>"),
    }).withColumn("height", F.col("height").cast("int"))
    folder = _folder(spark, "studies")
    api.export(shown, folder, NOW, "queries")
    return folder


def _image_id() -> Column:
    return F.regexp_extract("path", r"image-(\d+)_processed\.dcm$", 1).cast("long").alias("image_id")


_WIDTH = "(CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END)"


@query(
    f"SELECT vec_id AS image_id, (64 // {_WIDTH})::INT AS rows, {_WIDTH}::INT AS columns, 1 AS samples_per_pixel, 8 AS bits_allocated, 8 AS bits_stored, 'native' AS pixel_data_encoding, "
    "'MONOCHROME2' AS photometric, '1.2.840.10008.1.2.1' AS transfer_syntax_uid, NULL::VARCHAR AS error FROM embeddings"
)
def study_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of exported images, by the study source: no pixel is read."""
    found = study_source.read(spark, _exported(spark, sf_dir), glob="*.dcm")
    kept = ("rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "pixel_data_encoding", "photometric", "transfer_syntax_uid", "error")
    return found.select(_image_id(), *kept)


@query(f"{FULL} SELECT image_id, pos, g AS stored, '1.2.' || image_id AS study_uid FROM gr")
def study_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of exported images as they come back."""
    found = study_source.read(spark, _exported(spark, sf_dir), pixels=True, glob="*.dcm")
    return found.select(_image_id(), "study_uid", F.posexplode("pixels").alias("pos", "p")).select("image_id", "pos", F.col("p").cast("int").alias("stored"), "study_uid")


@query(SQL["equalize_images"])
def banded_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported images in bands of 32 bytes, equalized by the merged histogram of each."""
    ranged = row_bands.with_range(row_bands.bands(spark, _exported(spark, sf_dir), glob="*.dcm", band_bytes=32))
    shown = row_bands.equalize(ranged, "full")
    byte = lambda i: F.conv(F.hex(F.substring("gray", i + 1, 1)), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.length("gray") - 1), lambda i: F.struct((F.col("first_row") * F.col("width") + i).cast("int").alias("pos"), byte(i).alias("equalized")))
    return shown.select(_image_id(), F.explode(values).alias("p")).select("image_id", "p.*")


@query(
    "WITH f AS (SELECT 'studies/' || doc_id || '.dcm' AS path, doc_id % 90 = 1 AS late FROM documents), a AS (SELECT path FROM f ORDER BY path LIMIT 10), b AS (SELECT path FROM f WHERE late ORDER BY path LIMIT 10), "
    "u AS (SELECT path, 1 AS turn FROM b UNION ALL SELECT path, 2 FROM a WHERE path NOT IN (SELECT path FROM b)) "
    "SELECT path AS input_path, split_part(path, '/', 2) AS input_name, CASE turn WHEN 1 THEN '2024-01-02T04:04:05Z' ELSE '2024-01-02T03:04:05Z' END AS opened_at FROM u ORDER BY turn, path LIMIT 10"
)
def catalog_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after all studies were opened and then some of them again; it keeps ten."""
    found = v.metadata(spark, sf_dir).select(
        "doc_id", "path", F.element_at(F.split("path", "/"), -1).alias("input_name"), F.lit(None).cast("struct<row:double,col:double,source:string>").alias("scale"), F.lit(None).cast("string").alias("error")
    )
    folder = _folder(spark, "catalog")
    catalog.record_opened(spark, folder, found, NOW)
    catalog.record_opened(spark, folder, found.filter("doc_id % 90 = 1"), NOW.replace(hour=4))
    return catalog.load(spark, folder).select(F.col("inputPath").alias("input_path"), F.col("inputName").alias("input_name"), F.col("lastOpenedAt").alias("opened_at"))


# ------------------------------------------------------------------ streams


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream over a finished feed gives, written by batches and read back."""
    spark, out, key = stream.sparkSession, _folder(stream.sparkSession, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _feed(rows: DataFrame) -> str:
    """A feed of ``data: {...}`` lines."""
    folder = _folder(rows.sparkSession, "feed")
    rows.select(F.concat(F.lit("data: "), F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))).write.text(folder)
    return folder


@query(f"SELECT job_id, seq, state, percent FROM ({SQL['distinct_until_changed']})")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that change something, from a feed; the streaming form of ``distinct_until_changed``."""
    feed = streams.read_feed(spark, _feed(v.job_events(spark, sf_dir)))
    return _drained(streams.changes_only(feed)).select("job_id", "seq", "state", "percent")


@query(SQL["job_state_machine"])
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jobs stand after the last request of a feed; the streaming form of ``job_state_machine``."""
    feed = streams.read_feed(spark, _feed(records.job_requests(spark, sf_dir).withColumnRenamed("action", "state")))
    steps = _drained(streams.state_machine(feed))
    last = steps.groupBy("job_id").agg(F.max_by(F.struct("state", "percent"), "seq").alias("last"))
    return last.select("job_id", "last.*")


_MINUTES = "event_id % 90 + 1"


@query(SQL["in_flight_dedupe"].replace("(event_id % 90)", f"({_MINUTES})"))
def stream_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which job each start of a feed of starts and ends runs as; jobs end one to ninety minutes after their start."""
    rows = v.table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), F.col("event_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.lit(True).alias("start")
    )
    end = F.col("ts") + F.make_dt_interval(mins=(F.col("job_id") % 90 + 1).cast("int"))
    both = rows.union(rows.withColumns({"ts": end, "start": F.lit(False)}))
    schema = "fingerprint string, job_id long, ts timestamp, seq long, start boolean"
    return _drained(streams.in_flight(streams.read_feed(spark, _feed(both), schema)))


@query(
    SQL["stall_times"].replace(
        "quiet IS NULL OR", "quiet IS NULL AND date_diff('millisecond', TIMESTAMP '1970-01-01', ts) + 12000 <= (SELECT date_diff('millisecond', TIMESTAMP '1970-01-01', max(ts)) - 5000 FROM events) OR"
    )
)
def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalled jobs by timers, as far as the watermark of a feed has come; the streaming form of ``stall_times``."""
    return _drained(streams.stalls(streams.read_feed(spark, _feed(v.timed_events(spark, sf_dir)))))


# ------------------------------------------------------------------ requests


@query(
    "WITH p AS (SELECT * FROM (VALUES ('default', 0, 1.0::DOUBLE, 'Neutral'), ('xray', 10, 1.4::DOUBLE, 'Bone Focus'), ('high-contrast', 0, 1.8::DOUBLE, 'High Contrast')) v(preset, brightness, contrast, label)), "
    "r AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'xray' WHEN 1 THEN 'default' WHEN 2 THEN 'high-contrast' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'xray' END END AS preset, p_partkey % 3 <> 0 AS own FROM part), "
    "n AS (SELECT preset, count(*) AS asked, count_if(own)::BIGINT AS own_brightness FROM r GROUP BY preset) "
    "SELECT p.*, coalesce(asked, 0)::BIGINT AS asked, coalesce(own_brightness, 0)::BIGINT AS own_brightness FROM p LEFT JOIN n USING (preset)"
)
def processing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets, each with how many requests of ``part`` ask for it and how many of those bring a brightness of their own."""
    return requests.manifest_use(v.requests(spark, sf_dir))
