"""Corpus, text, geometry, job and store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rayloom.functions import contracts
from rayloom.functions import geometry as geo
from rayloom.functions import text as tx
from rayloom.functions import timing as tm
from rayloom.operators import annotations, corpus, jobs, requests, stores
from rayloom.operators import contracts as checks
from rayloom.plans import views as v
from rayloom.plans.catalog import query

# ------------------------------------------------------------------ corpus

META = """m AS (SELECT doc_id, 'studies/' || doc_id || '.dcm' AS path, (doc_id % 2048 + 1)::INT AS rows, (doc_id % 1024 + 1)::INT AS columns,
  CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 1 END AS samples_per_pixel, CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 8 END AS bits_allocated,
  CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 8 END AS bits_stored, 0 AS pixel_representation, 0 AS planar_configuration,
  (CASE WHEN doc_id % 50 = 0 THEN 4 ELSE 1 END)::BIGINT AS number_of_frames,
  CASE WHEN lang = 'de' THEN 'encapsulated' ELSE 'native' END AS pixel_data_encoding, CASE WHEN doc_id % 10 = 0 THEN 'RGB' ELSE 'MONOCHROME2' END AS photometric,
  CASE source WHEN 'src0' THEN '1.2.840.10008.1.2.1' WHEN 'src1' THEN '1.2.840.10008.1.2' WHEN 'src2' THEN '' ELSE '1.2.840.10008.1.2.4.50' END AS transfer_syntax_uid
  FROM documents)"""
_PLAIN = "('', '1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2', '1.2.840.10008.1.2.1.99')"
_COUNTS = (
    "count(*) AS study_count, count_if(pixel_data_encoding = 'encapsulated')::BIGINT AS encapsulated_count, "
    f"count_if(transfer_syntax_uid NOT IN {_PLAIN})::BIGINT AS compressed_count, count_if(samples_per_pixel > 1)::BIGINT AS color_count, "
    "count_if(number_of_frames > 1)::BIGINT AS multi_frame_count"
)


@query(f"WITH {META} SELECT {', '.join(corpus.PROFILE)} FROM m")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profiles(v.metadata(spark, sf_dir))


@query(
    f"WITH {META} SELECT "
    + ", ".join(f"(SELECT string_agg(x, '|' ORDER BY x{'' if i < 3 else '::BIGINT'}) FROM (SELECT DISTINCT {c}::VARCHAR AS x FROM m)) AS {c}_set" for i, c in enumerate(corpus.SETS))
)
def corpus_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.summarize(v.metadata(spark, sf_dir))
    return found.select(*[F.array_join(F.col(f"{c}_set").cast("array<string>"), "|").alias(f"{c}_set") for c in corpus.SETS])


@query(f"WITH {META} SELECT {_COUNTS} FROM m")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summarize(v.metadata(spark, sf_dir)).select(*corpus.counts())


@query(
    f"WITH {META}, s AS (SELECT photometric, {_COUNTS}, count(DISTINCT transfer_syntax_uid) AS syntaxes FROM m GROUP BY photometric) "
    "SELECT photometric, concat_ws('|', CASE WHEN syntaxes = 1 THEN 'sample set contains one transfer syntax' END, "
    "CASE WHEN encapsulated_count = 0 THEN 'sample set contains no encapsulated pixel data' END, "
    "CASE WHEN compressed_count = 0 THEN 'sample set contains no compressed transfer syntaxes' END, "
    "CASE WHEN multi_frame_count = 0 THEN 'sample set contains no multi-frame studies' END) AS warnings FROM s"
)
def corpus_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of the corpus of each photometric interpretation."""
    m = v.metadata(spark, sf_dir)
    parts = m.groupBy("photometric").agg(
        *[c.alias(n) for n, c in corpus.counts().items()], F.collect_set("transfer_syntax_uid").alias("transfer_syntax_uid_set")
    )
    return parts.select("photometric", F.array_join(corpus.warnings(parts), "|").alias("warnings"))


@query(
    "SELECT (SELECT sum(octet_length(encode(text)))::BIGINT FROM documents) AS text_bytes, (SELECT sum(len(embedding) * 4)::BIGINT FROM embeddings) AS pixel_bytes, "
    "(SELECT count(*) FROM documents) AS studies"
)
def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("text_bytes"), F.count("*").alias("studies"))
    images = v.table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding") * 4).alias("pixel_bytes"))
    return docs.crossJoin(images).select("text_bytes", "pixel_bytes", "studies")  # two one-row aggregates


@query("SELECT source AS path, count(*) AS decodes FROM documents GROUP BY source")
def decode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("decodes"))


# ------------------------------------------------------------------ text

TAGS = """t AS (SELECT p_partkey, p_type, p_size, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' \\ ' || (p_partkey % 7) || ' '
  WHEN 2 THEN '0.' || p_size || '\\0.5\\9' WHEN 3 THEN 'x' || p_size || '\\1' ELSE '  ' END AS text FROM part)"""
_FIRST = "trim(split_part(rtrim(text, ' '), '\\', 1))"


@query(
    f"WITH {TAGS} SELECT p_partkey, {_FIRST} AS first, try_cast({_FIRST} AS DOUBLE) AS number, CASE WHEN regexp_matches({_FIRST}, '^[0-9]+$') THEN try_cast({_FIRST} AS BIGINT) END AS whole, "
    "CASE WHEN rtrim(text, ' ') = '' THEN 0 ELSE len(string_split(rtrim(text, ' '), '\\')) END::INT AS parts FROM t"
)
def ds_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return v.tags(spark, sf_dir).select(
        "p_partkey", tx.dicom_first(text).alias("first"), tx.decimal_string(text).alias("number"), tx.integer_string(text).alias("whole"), F.size(tx.dicom_parts(text)).alias("parts")
    )


def _pair_sql(name: str, text: str) -> str:
    a, b = (f"try_cast(trim(split_part(rtrim({text}, ' '), '\\', {i})) AS DOUBLE)" for i in (1, 2))
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END AS {name}_r, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END AS {name}_c"


@query(
    f"WITH {TAGS}, p AS (SELECT p_partkey, {_pair_sql('a', 'text')}, {_pair_sql('b', chr(39) + '0.25' + chr(92) + '0.5' + chr(39))} FROM t) "
    "SELECT p_partkey, CASE WHEN a_r > 0 AND a_c > 0 THEN a_r WHEN p_partkey % 2 = 0 THEN b_r END AS row_mm, CASE WHEN a_r > 0 AND a_c > 0 THEN a_c WHEN p_partkey % 2 = 0 THEN b_c END AS col_mm, "
    "CASE WHEN a_r > 0 AND a_c > 0 THEN 'PixelSpacing' WHEN p_partkey % 2 = 0 THEN 'NominalScannedPixelSpacing' END AS source FROM p"
)
def spacing_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nominal = F.when(F.col("p_partkey") % 2 == 0, F.lit("0.25\\0.5"))
    scale = tx.measurement_scale(tx.spacing_pair(F.col("text")), tx.spacing_pair(F.lit("0\\1")), tx.spacing_pair(nominal))
    return v.tags(spark, sf_dir).select("p_partkey", scale.alias("s")).select(
        "p_partkey", F.col("s.row").alias("row_mm"), F.col("s.col").alias("col_mm"), "s.source"
    )


@query(
    f"WITH {META} SELECT doc_id, CASE transfer_syntax_uid WHEN '1.2.840.10008.1.2' THEN 'implicit little endian' WHEN '1.2.840.10008.1.2.2' THEN 'explicit big endian' "
    f"WHEN '' THEN 'error: empty' ELSE 'explicit little endian' END AS syntax, transfer_syntax_uid IN {_PLAIN} AS uncompressed FROM m"
)
def transfer_syntax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("transfer_syntax_uid")
    return v.metadata(spark, sf_dir).select("doc_id", tx.syntax_class(uid).alias("syntax"), tx.is_uncompressed(uid).alias("uncompressed"))


@query(
    "WITH e AS (SELECT o_orderkey AS owner, 524294 + 65536 * (o_custkey % 5) AS tag, 0 AS priority, 'LO' AS vr, o_orderpriority AS value FROM orders UNION ALL "
    "SELECT o_orderkey, 524294 + 65536 * (o_custkey % 3), 1, 'SH', o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL "
    "SELECT o_orderkey, 2621456, 2, 'US', 'px' FROM orders WHERE o_orderkey % 3 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY owner, tag ORDER BY priority DESC) AS k FROM e) "
    "SELECT owner, tag, printf('(%04x,%04x)', tag // 65536, tag % 65536) AS tag_text, vr, value, row_number() OVER (PARTITION BY owner ORDER BY tag)::INT AS place FROM r WHERE k = 1"
)
def tag_sort_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    one = lambda tag, vr, value: o.select(F.col("o_orderkey").alias("owner"), tag.alias("tag"), F.lit(vr).alias("vr"), value.alias("value"), "o_orderkey")
    base = tx.tag_pack(F.lit(8), F.lit(6))
    defaults = one(base + (F.col("o_custkey") % 5) * 65536, "LO", F.col("o_orderpriority")).drop("o_orderkey")
    preserved = one(base + (F.col("o_custkey") % 3) * 65536, "SH", F.col("o_orderstatus")).filter("o_orderkey % 2 = 0").drop("o_orderkey")
    module = one(tx.tag_pack(F.lit(0x28), F.lit(0x10)), "US", F.lit("px")).filter("o_orderkey % 3 = 0").drop("o_orderkey")
    merged = annotations.upsert_elements(defaults, preserved, module)
    shown = tx.tag_text(F.floor(F.col("tag") / 65536), F.col("tag") % 65536)
    place = F.row_number().over(Window.partitionBy("owner").orderBy("tag"))
    return merged.select("owner", "tag", shown.alias("tag_text"), "vr", "value", place.alias("place"))


@query(
    "SELECT p_partkey, p_type || '.DCM' AS path, p_type || '_processed.dcm' AS output, CASE WHEN p_partkey % 2 = 0 THEN p_type || '.DCM' ELSE p_type || '.tif.dcm' END AS ensured, "
    "p_partkey % 2 = 1 AS standalone, 'cache/artifacts/render/' || p_partkey || '.png' AS artifact FROM part"
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    path = F.concat(F.col("p_type"), F.lit(".DCM"))
    named = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, ".DCM").otherwise(".tif"))
    artifact = tx.artifact_path(F.lit("cache"), F.lit("render"), F.col("p_partkey").cast("string"), F.lit("png"))
    return p.select(
        "p_partkey", path.alias("path"), tx.output_name(F.concat(F.lit("C:\\in/"), path)).alias("output"), tx.with_dicom_extension(named).alias("ensured"),
        tx.is_standalone_image(named).alias("standalone"), artifact.alias("artifact"),
    )


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'invalidInput' WHEN 'O' THEN 'notFound' ELSE 'internal' END AS code, "
    "CASE o_orderstatus WHEN 'F' THEN 400 WHEN 'O' THEN 404 ELSE 500 END AS status, o_orderstatus IN ('F', 'O') AS recoverable, "
    "CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'invalidInput' WHEN 'O' THEN 'notFound' ELSE 'internal' END ELSE 'internal' END AS parsed, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'bad ' || o_orderkey ELSE 'plain ' || o_orderkey END AS message FROM orders"
)
def error_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    code = tx.mapped(F.col("o_orderstatus"), {"F": "invalidInput", "O": "notFound"}, F.lit("internal"))
    key = F.col("o_orderkey").cast("string")
    payload = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(code.alias("code"), F.concat(F.lit("bad "), key).alias("message")))).otherwise(F.concat(F.lit("plain "), key))
    error = tx.normalized_error(payload)
    return o.select("o_orderkey", code.alias("code"), tx.error_status(code).alias("status"), tx.is_recoverable(code).alias("recoverable"), error.code.alias("parsed"), error.message.alias("message"))


# ------------------------------------------------------------------ geometry

LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, l_partkey + l_quantity AS x2, l_suppkey + l_discount * 100.0::DOUBLE AS y2,
  CASE WHEN l_linenumber % 3 <> 0 THEN 0.2::DOUBLE END AS row_mm, CASE WHEN l_linenumber % 3 <> 0 THEN 0.3::DOUBLE END AS col_mm FROM lineitem),
ml AS (SELECT *, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 10.0::DOUBLE) / 10.0::DOUBLE AS pixel_length,
  round(sqrt(((x2 - x1) * col_mm) * ((x2 - x1) * col_mm) + ((y2 - y1) * row_mm) * ((y2 - y1) * row_mm)) * 10.0::DOUBLE) / 10.0::DOUBLE AS calibrated_mm FROM l)"""


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, pixel_length, calibrated_mm FROM ml")
def measure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.measure_lines(v.lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", "pixel_length", "calibrated_mm")


@query(
    f"WITH {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN calibrated_mm IS NOT NULL THEN printf('%.1f mm', calibrated_mm) ELSE printf('%.1f px', pixel_length) END AS label, "
    "CASE WHEN calibrated_mm IS NOT NULL THEN printf('%.1f px', pixel_length) END AS secondary FROM ml"
)
def measure_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.measure_lines(v.lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", "label", "secondary")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, (x1 + x2) / 2.0::DOUBLE AS mid_x, (y1 + y2) / 2.0::DOUBLE AS mid_y, 10.0::DOUBLE / greatest(l_linenumber::DOUBLE, 1.0::DOUBLE) AS label_offset FROM l")
def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return v.lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", ((c("x1") + c("x2")) / 2.0).alias("mid_x"), ((c("y1") + c("y2")) / 2.0).alias("mid_y"),
        geo.label_offset(c("l_linenumber").cast("double")).alias("label_offset"),
    )


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, x1, y1, x2, y2 FROM l WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 2.0::DOUBLE")
def short_lines_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ("x1", "y1", "x2", "y2")
    return v.lines(spark, sf_dir).filter(geo.is_drawn(*map(F.col, ends))).select("l_orderkey", "l_linenumber", *ends)


_VIEW = """w AS (SELECT l_orderkey, l_linenumber, x1, y1, 800.0::DOUBLE AS fw, 600.0::DOUBLE AS fh, 2048.0::DOUBLE AS iw, 1536.0::DOUBLE AS ih,
  l_linenumber * 2.5::DOUBLE AS zoom, l_linenumber * 3.0::DOUBLE - 9.0::DOUBLE AS pan_x, 4.0::DOUBLE - l_linenumber AS pan_y FROM l),
s AS (SELECT *, least(fw / iw, fh / ih) * least(12.0::DOUBLE, greatest(1.0::DOUBLE, zoom)) AS scale FROM w),
o AS (SELECT *, (fw - iw * scale) / 2.0::DOUBLE + pan_x AS offset_x, (fh - ih * scale) / 2.0::DOUBLE + pan_y AS offset_y FROM s)"""


def _viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    size = {"fw": 800.0, "fh": 600.0, "iw": 2048.0, "ih": 1536.0}
    placed = v.lines(spark, sf_dir).withColumns({k: F.lit(x) for k, x in size.items()} | {"zoom": n * 2.5, "pan_x": n * 3.0 - 9.0, "pan_y": 4.0 - n.cast("double")})
    return placed.withColumns(geo.viewport(*[F.col(c) for c in ("fw", "fh", "iw", "ih", "zoom", "pan_x", "pan_y")]))


@query(f"WITH {LINES}, {_VIEW} SELECT l_orderkey, l_linenumber, scale, offset_x, offset_y FROM o")
def viewport_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewer(spark, sf_dir).select("l_orderkey", "l_linenumber", "scale", "offset_x", "offset_y")


@query(
    f"WITH {LINES}, {_VIEW}, p AS (SELECT *, offset_x + x1 * scale AS screen_x FROM o) SELECT l_orderkey, l_linenumber, screen_x, (screen_x - offset_x) / scale AS image_x FROM p"
)
def image_to_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    shown = _viewer(spark, sf_dir).withColumn("screen_x", geo.to_screen(c("x1"), c("offset_x"), c("scale")))
    return shown.select("l_orderkey", "l_linenumber", "screen_x", geo.to_image(c("screen_x"), c("offset_x"), c("scale")).alias("image_x"))


@query(
    f"WITH {LINES}, {_VIEW}, a AS (SELECT *, least(12.0::DOUBLE, greatest(1.0::DOUBLE, zoom * 1.12::DOUBLE)) AS z2, (100.0::DOUBLE - offset_x) / scale AS ax FROM o), "
    "b AS (SELECT *, least(fw / iw, fh / ih) * least(12.0::DOUBLE, greatest(1.0::DOUBLE, z2)) AS s2 FROM a), d AS (SELECT *, (fw - iw * s2) / 2.0::DOUBLE + pan_x AS o2 FROM b) "
    "SELECT l_orderkey, l_linenumber, z2 AS zoom, round(pan_x + (100.0::DOUBLE - (o2 + ax * s2)), 6) AS pan_x FROM d"
)
def zoom_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    moved = geo.zoom_at((c("fw"), c("fh")), (c("iw"), c("ih")), c("zoom"), (c("pan_x"), c("pan_y")), (F.lit(100.0), F.lit(50.0)), F.lit(1.12))
    return _viewer(spark, sf_dir).select("l_orderkey", "l_linenumber", moved["zoom"].alias("zoom"), F.round(moved["pan_x"], 6).alias("pan_x"))


@query(
    f"WITH {LINES} SELECT l_orderkey, l_linenumber, least(2048.0::DOUBLE, greatest(0.0::DOUBLE, x2 - 20.0::DOUBLE)) AS x, CASE WHEN x2 - 20.0::DOUBLE BETWEEN 0 AND 100 AND y2 BETWEEN 0 AND 50 "
    "THEN floor(x2 - 20.0::DOUBLE + 0.5::DOUBLE)::INT END AS hover_x, least(3.0::DOUBLE, greatest(0.1::DOUBLE, y2 / 10.0::DOUBLE)) AS control FROM l"
)
def clamp_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x2") - 20.0
    return v.lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", geo.clamp_to(x, F.lit(2048.0)).alias("x"), geo.hover(x, F.col("y2"), F.lit(100.0), F.lit(50.0)).alias("hover_x"),
        geo.clamp_control(F.col("y2") / 10.0, 0.1, 3.0).alias("control"),
    )


_CHANGED = "SELECT o_orderkey AS id, o_orderpriority AS label, 1::BIGINT AS ts FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'moved', 2 FROM orders WHERE o_orderkey % 6 = 0"


@query(f"SELECT id, arg_max(label, ts) AS label, max(ts) AS ts FROM ({_CHANGED}) GROUP BY id")
def annotation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    one = lambda rows, label, ts: rows.select(F.col("o_orderkey").alias("id"), label.alias("label"), F.lit(ts).cast("long").alias("ts"))
    return annotations.upsert(one(o.filter("o_orderkey % 4 <> 0"), F.col("o_orderpriority"), 1), one(o.filter("o_orderkey % 6 = 0"), F.lit("moved"), 2))


@query("SELECT o_orderkey AS id, o_orderpriority AS label FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def annotation_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), "o_custkey")
    gone = v.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return annotations.remove(current, gone, "o_custkey").select("id", "label")


# ------------------------------------------------------------------ jobs

EV = """ev AS (SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelling'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS state, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, value)))::INT AS percent, event_id % 29 = 0 AS from_cache FROM events)"""
_LATEST = "la AS (SELECT job_id, max_by(ts, seq) AS ts, max(seq) AS seq, max_by(state, seq) AS state, max_by(percent, seq) AS percent FROM ev GROUP BY job_id)"
_W = "OVER (PARTITION BY job_id ORDER BY ts, seq)"
SESSIONS = f"""sn AS (SELECT *, sum(CASE WHEN from_cache THEN 1 ELSE 0 END) {_W} AS cached FROM ev), lk AS (SELECT * FROM sn WHERE state IN ('queued', 'running', 'cancelling') AND NOT from_cache),
fl AS (SELECT *, CASE WHEN percent + 0.5::DOUBLE < lag(percent) {_W} OR cached <> lag(cached) {_W} THEN 1 ELSE 0 END AS fell FROM lk),
se AS (SELECT job_id, ts, seq, state, percent, (sum(fell) {_W})::INT AS session FROM fl),
lg AS (SELECT *, lag(percent) OVER (PARTITION BY job_id, session ORDER BY ts, seq) AS before FROM se),
ac AS (SELECT job_id, ts, seq, state, percent, session FROM lg WHERE before IS NULL OR before <> percent)"""
_S = "OVER (PARTITION BY job_id, session ORDER BY ts, seq)"
RATES = f"""ra AS (SELECT *, date_diff('millisecond', lag(ts) {_S}, ts) AS gap_ms, lag(percent) {_S} AS previous FROM ac),
rt AS (SELECT *, CASE WHEN previous > 0 AND gap_ms >= 250 AND percent - previous >= 0.5::DOUBLE THEN (percent - previous)::DOUBLE / gap_ms END AS rate FROM ra)"""
OVERALL = f"""fi AS (SELECT *, first_value(CASE WHEN percent > 0 THEN ts END IGNORE NULLS) {_S} AS first_ts, first_value(CASE WHEN percent > 0 THEN percent END IGNORE NULLS) {_S} AS first_percent,
  count(CASE WHEN percent > 0 THEN 1 END) {_S} AS measured FROM ac),
ov AS (SELECT *, date_diff('millisecond', first_ts, ts) AS since_first_ms,
  CASE WHEN percent > first_percent + 0.5::DOUBLE AND date_diff('millisecond', first_ts, ts) >= 250 THEN (percent - first_percent)::DOUBLE / date_diff('millisecond', first_ts, ts) END AS overall FROM fi)"""


@query(f"WITH {EV}, {_LATEST} SELECT job_id, ts, seq, state, percent FROM la")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(v.job_events(spark, sf_dir))


@query(f"WITH {EV}, {_LATEST} SELECT job_id, ts, state, row_number() OVER (ORDER BY ts DESC, seq DESC)::INT AS place FROM la")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_order(v.job_events(spark, sf_dir)).select("job_id", "ts", "state", "place")


@query(f"WITH {EV}, {_LATEST} SELECT job_id, ts, seq, state, percent FROM la WHERE job_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ORDER BY ts DESC, seq DESC LIMIT 6")
def job_panel_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    dismissed = v.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job_id"))
    return jobs.panel(v.job_events(spark, sf_dir), dismissed)


@query(f"WITH {EV}, {_LATEST} SELECT count_if(state IN ('queued', 'running', 'cancelling'))::BIGINT AS pending, count_if(state IN ('completed', 'failed', 'cancelled'))::BIGINT AS terminal FROM la")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending_counts(v.job_events(spark, sf_dir))


@query(
    f"WITH {EV}, p AS (SELECT *, lag(percent) {_W} AS before FROM ev) SELECT job_id, bool_or(coalesce(percent > before, false)) AS any_progress, bool_and(state = 'queued') AS all_queued, "
    "bool_or(percent > 80) AS any_near_end FROM p GROUP BY job_id"
)
def poll_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.poll_flags(v.job_events(spark, sf_dir))


@query(
    f"WITH {EV}, p AS (SELECT *, lag(percent) {_W} AS bp, lag(state) {_W} AS bs, row_number() {_W} AS k FROM ev) "
    "SELECT job_id, ts, seq, state, percent FROM p WHERE k = 1 OR bp IS DISTINCT FROM percent OR bs IS DISTINCT FROM state"
)
def distinct_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.changed_only(v.job_events(spark, sf_dir)).select("job_id", "ts", "seq", "state", "percent")


@query(f"WITH {EV}, {SESSIONS} SELECT job_id, seq, session FROM se")
def progress_reset_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(v.timed_events(spark, sf_dir)).select("job_id", "seq", "session")


@query(f"WITH {EV}, {SESSIONS}, {RATES} SELECT job_id, seq, percent, gap_ms, rate FROM rt")
def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rates(v.timed_events(spark, sf_dir)).select("job_id", "seq", "percent", "gap_ms", "rate")


@query(
    f"WITH RECURSIVE {EV}, {SESSIONS}, {RATES}, nn AS (SELECT job_id, session, rate, row_number() OVER (PARTITION BY job_id, session ORDER BY ts, seq) AS k FROM rt WHERE rate IS NOT NULL AND rate <> 0), "
    "ema AS (SELECT job_id, session, k, rate AS smoothed FROM nn WHERE k = 1 UNION ALL "
    "SELECT n.job_id, n.session, n.k, e.smoothed + (n.rate - e.smoothed) * 0.35::DOUBLE FROM ema e JOIN nn n ON n.job_id = e.job_id AND n.session = e.session AND n.k = e.k + 1) "
    "SELECT job_id, session, max_by(smoothed, k) AS smoothed FROM ema GROUP BY job_id, session"
)
def smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.smoothed_rates(v.timed_events(spark, sf_dir))


@query(
    f"WITH {EV}, {SESSIONS}, nb AS (SELECT job_id, seq, ts, list({{'ts': ts, 'seq': seq}}) OVER (PARTITION BY job_id, session ORDER BY ts, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS newest FROM ac), "
    "he AS (SELECT *, list_filter(newest, lambda x: date_diff('millisecond', x.ts, ts) <= 20000 OR x.seq = seq) AS held FROM nb) "
    "SELECT job_id, seq, len(held)::BIGINT AS samples, array_to_string(list_transform(held, lambda x: x.seq), ',') AS held FROM he"
)
def rolling_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample buffer after each accepted snapshot: how many it holds, and which."""
    held = F.array_join(F.transform("held", lambda x: x["seq"].cast("string")), ",")
    return jobs.rolling_samples(v.timed_events(spark, sf_dir)).select("job_id", "seq", F.col("samples").cast("long").alias("samples"), held.alias("held"))


@query(f"WITH {EV}, {SESSIONS}, {OVERALL} SELECT job_id, seq, percent, measured, since_first_ms, overall FROM ov")
def overall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.overall_rates(v.timed_events(spark, sf_dir)).select("job_id", "seq", "percent", "measured", "since_first_ms", "overall")


_EST = f"""{EV}, {SESSIONS}, {OVERALL}, es AS (SELECT job_id, seq, state, percent, measured, since_first_ms, overall, seq % 16000 AS stale_ms,
  CASE WHEN seq % 3 <> 0 THEN (seq % 97)::DOUBLE / 100000.0::DOUBLE END AS recent FROM ov),
we AS (SELECT *, CASE WHEN coalesce(recent, 0.0::DOUBLE) = 0 THEN 0.0::DOUBLE WHEN stale_ms <= 4000 THEN 0.72::DOUBLE WHEN stale_ms >= 14000 THEN 0.0::DOUBLE
  ELSE 0.72::DOUBLE * (1.0::DOUBLE - (stale_ms - 4000) / 10000.0::DOUBLE) END AS weight FROM es),
bl AS (SELECT *, CASE WHEN overall IS NULL THEN recent WHEN recent IS NULL THEN overall ELSE overall * (1.0::DOUBLE - weight) + recent * weight END AS rate FROM we),
et AS (SELECT *, CASE WHEN percent > 0 AND percent < 100 AND rate > 0 THEN (100.0::DOUBLE - percent) / rate END AS remaining,
  CASE WHEN overall IS NULL OR recent IS NULL OR greatest(overall, recent) <= 0 THEN 0.0::DOUBLE ELSE least(overall, recent) / greatest(overall, recent) END AS agreed FROM bl),
sc AS (SELECT *, 2.0::DOUBLE + (CASE WHEN measured >= 3 THEN 1 ELSE 0 END) + (CASE WHEN since_first_ms >= 10000 THEN 1 ELSE 0 END) + (CASE WHEN percent >= 25 THEN 1 ELSE 0 END)
  + (CASE WHEN stale_ms <= 4000 THEN 1 ELSE 0 END) + (CASE WHEN agreed >= 0.7::DOUBLE THEN 1.0::DOUBLE WHEN agreed >= 0.45::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN remaining <= 10000 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM et),
co AS (SELECT *, CASE WHEN remaining IS NULL OR NOT coalesce(measured >= 2 AND since_first_ms >= 3000 AND percent >= 8 AND stale_ms < 12000, false) THEN 'none'
  WHEN score >= 6 THEN 'high' WHEN score >= 4.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence, stale_ms >= 12000 AS stalled FROM sc)"""


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a staleness and a recent rate, and everything that follows from them."""
    c = F.col
    base = jobs.overall_rates(v.timed_events(spark, sf_dir)).withColumns(
        {"stale_ms": c("seq") % 16000, "recent": F.when(c("seq") % 3 != 0, (c("seq") % 97).cast("double") / 100000.0)}
    )
    rated = base.withColumn("rate", tm.blended_rate(c("overall"), c("recent"), tm.recent_weight(c("stale_ms"), c("recent"))))
    timed = rated.withColumn("remaining", tm.remaining_ms(c("percent"), c("rate")))
    sure = tm.confidence(c("measured"), c("since_first_ms"), c("percent"), c("stale_ms"), c("overall"), c("recent"), c("remaining"))
    return timed.withColumns({"confidence": sure, "stalled": c("stale_ms") >= tm.STALL_MS})


@query(f"WITH {_EST} SELECT job_id, seq, rate FROM bl")
def rate_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).select("job_id", "seq", "rate")


@query(f"WITH {_EST} SELECT job_id, seq, remaining FROM et")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).select("job_id", "seq", "remaining")


@query(f"WITH {_EST} SELECT job_id, seq, confidence, stalled FROM co")
def eta_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).select("job_id", "seq", "confidence", "stalled")


_STEP = "CASE WHEN ms < 10000 THEN 1000 WHEN ms < 60000 THEN 5000 WHEN ms < 300000 THEN 15000 WHEN ms < 1800000 THEN 30000 ELSE 60000 END"
_BUCKET = f"bu AS (SELECT *, greatest({_STEP}, ceil(ms / ({_STEP})) * ({_STEP}))::BIGINT AS bucket FROM ms), sx AS (SELECT *, greatest(1, ceil(bucket / 1000.0::DOUBLE))::BIGINT AS s FROM bu)"
_TEXT = (
    "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END "
    "ELSE (s // 3600) || 'h' || CASE WHEN (s // 60) % 60 > 0 THEN ' ' || ((s // 60) % 60) || 'm' ELSE '' END END"
)


@query(f"WITH ms AS (SELECT o_orderkey, o_totalprice * 37.5::DOUBLE AS ms FROM orders), {_BUCKET} SELECT o_orderkey, bucket, {_TEXT} AS duration FROM sx")
def eta_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", tm.eta_bucket(F.col("o_totalprice") * 37.5).alias("bucket"))
    return o.select("o_orderkey", "bucket", tm.duration_text(F.col("bucket")).alias("duration"))


@query(
    f"WITH {_EST}, ms AS (SELECT *, remaining AS ms FROM co), {_BUCKET} SELECT job_id, seq, CASE WHEN stalled THEN 'waiting for next update' WHEN remaining IS NULL OR confidence = 'none' THEN 'estimating time...' "
    f"WHEN remaining < 5000 THEN '<5s remaining' ELSE CASE WHEN confidence = 'low' THEN 'estimating... ' ELSE '' END || CASE WHEN confidence = 'high' THEN '' ELSE '~' END || ({_TEXT}) || ' remaining' END AS label FROM sx"
)
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _estimates(spark, sf_dir)
    return e.select("job_id", "seq", tm.eta_text(F.col("remaining"), F.col("confidence"), F.col("stalled")).alias("label"))


@query(
    f"WITH {_EST} SELECT job_id, seq, CASE WHEN seq % 20 = 0 OR state IN ('completed', 'failed', 'cancelled') THEN 'simple' WHEN seq % 7 = 0 THEN 'indeterminate' "
    "WHEN NOT stalled AND remaining IS NOT NULL AND confidence <> 'none' THEN 'detailed' WHEN percent <= 0 THEN 'indeterminate' WHEN stale_ms < 1000 THEN 'hidden' ELSE 'simple' END AS mode FROM co"
)
def display_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    show = ~c("stalled") & c("remaining").isNotNull() & (c("confidence") != "none")
    mode = tm.display_mode(c("state"), c("seq") % 20 == 0, c("seq") % 7 != 0, c("percent"), c("stale_ms"), show)
    return _estimates(spark, sf_dir).select("job_id", "seq", mode.alias("mode"))


@query(
    f"WITH {EV}, {SESSIONS}, n AS (SELECT job_id, seq, ts, last_value(CASE WHEN seq IN (SELECT seq FROM ac) THEN ts END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, seq) AS moved FROM se), "
    "k AS (SELECT job_id, seq, date_diff('millisecond', moved, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq)) AS quiet_ms FROM n) SELECT job_id, seq, quiet_ms >= 12000 AS stalled FROM k WHERE quiet_ms IS NOT NULL"
)
def stall_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job has been without progress for 12 s when its next snapshot comes."""
    every = jobs.sessions(v.timed_events(spark, sf_dir))
    inside = Window.partitionBy("job_id", "session").orderBy("ts", "seq")
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    before = F.lag("percent").over(inside)
    moved = F.when(before.isNull() | (before != F.col("percent")), F.col("ts"))
    marked = every.withColumn("own", moved).withColumn("moved", F.last("own", True).over(order)).withColumn("next", F.lead("ts").over(order))
    quiet = marked.withColumn("quiet_ms", jobs.millis(F.col("next")) - jobs.millis(F.col("moved"))).filter("quiet_ms is not null")
    return quiet.select("job_id", "seq", (F.col("quiet_ms") >= tm.STALL_MS).alias("stalled"))


@query(
    f"WITH {EV}, {SESSIONS}, mk AS (SELECT job_id, ts, seq, percent::DOUBLE AS percent FROM ac UNION ALL SELECT job_id, ts, seq, NULL FROM ev WHERE from_cache OR state IN ('completed', 'failed', 'cancelled')), "
    f"qu AS (SELECT *, date_diff('millisecond', ts, lead(ts) {_W}) AS quiet FROM mk) SELECT job_id, seq, percent, date_diff('millisecond', TIMESTAMP '1970-01-01', ts) + 12000 AS stalled_ms FROM qu WHERE percent IS NOT NULL AND (quiet IS NULL OR quiet >= 12000)"
)
def stall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When jobs had stood still for 12 s, whether or not another snapshot came; the batch form of the stream with timers."""
    return jobs.stalls(v.timed_events(spark, sf_dir))


_REQUESTED = "rq AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS job_id FROM orders)"


@query(f"WITH {EV}, {_LATEST}, {_REQUESTED} SELECT place, job_id, state, percent FROM rq JOIN la USING (job_id)")
def batch_get_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("job_id"))
    return jobs.batch_get(asked, v.job_events(spark, sf_dir)).select("place", "job_id", "state", "percent")


@query(
    f"WITH {EV} SELECT job_id, seq, CASE state WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Running' WHEN 'cancelling' THEN 'Cancelling' WHEN 'completed' THEN 'Completed' ELSE 'Failed' END AS label, "
    "CASE WHEN job_id % 2 = 0 THEN 'Render Preview' ELSE 'Process Study' END AS title, CASE WHEN job_id % 2 = 0 THEN "
    "CASE WHEN percent >= 100 THEN 'completed' WHEN percent >= 90 THEN 'writingPreview' WHEN percent >= 75 THEN 'renderingPreview' WHEN percent >= 35 THEN 'loadingStudy' WHEN percent >= 10 THEN 'validating' ELSE 'queued' END "
    "ELSE CASE WHEN percent >= 100 THEN 'completed' WHEN percent >= 95 THEN 'writingDicom' WHEN percent >= 84 THEN 'writingPreview' WHEN percent >= 65 THEN 'processingPixels' WHEN percent >= 30 THEN 'loadingStudy' "
    "WHEN percent >= 10 THEN 'validating' ELSE 'queued' END END AS stage FROM ev"
)
def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("job_id") % 2 == 0, "renderStudy").otherwise("processStudy")
    rows = v.job_events(spark, sf_dir).withColumn("kind", kind)
    return rows.select(
        "job_id", "seq", tx.mapped(F.col("state"), tx.STATE_LABELS).alias("label"), tx.mapped(F.col("kind"), tx.JOB_TITLES).alias("title"),
        jobs.stage_of(F.col("kind"), F.col("percent")).alias("stage"),
    )


_ACTIONS = """ac AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'cancel'
  WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'start' END AS action, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, value)))::INT AS p FROM events)"""
_STEP_STATE = """CASE WHEN m.state IN ('completed', 'failed', 'cancelled') THEN m.state WHEN a.action = 'cancel' THEN CASE m.state WHEN 'queued' THEN 'cancelled' ELSE 'cancelling' END
  WHEN a.action IN ('complete', 'fail') THEN CASE WHEN m.state = 'cancelling' THEN 'cancelled' WHEN a.action = 'complete' THEN 'completed' ELSE 'failed' END WHEN m.state = 'queued' THEN 'running' ELSE m.state END"""
_STEP_PERCENT = "CASE WHEN m.state NOT IN ('queued', 'running') THEN m.percent WHEN a.action = 'progress' THEN a.p WHEN a.action = 'complete' THEN 100 ELSE m.percent END"


@query(
    f"WITH RECURSIVE {_ACTIONS}, m AS (SELECT DISTINCT job_id, 0::BIGINT AS k, 'queued' AS state, 0 AS percent FROM ac UNION ALL "
    f"SELECT m.job_id, a.k, {_STEP_STATE}, {_STEP_PERCENT} FROM m JOIN ac a ON a.job_id = m.job_id AND a.k = m.k + 1) "
    "SELECT job_id, max_by(state, k) AS state, max_by(percent, k)::INT AS percent FROM m GROUP BY job_id"
)
def job_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests folded into the final state of each job; a user is a job."""
    return jobs.state_machine(job_requests(spark, sf_dir))


def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as requests to jobs (job_id, ts, seq, action, percent)."""
    action = {"signup": "start", "view": "progress", "click": "cancel", "purchase": "complete", "error": "fail"}
    rows = v.table(spark, sf_dir, "events")
    percent = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value")))).cast("int")
    named = tx.mapped(F.col("event_type"), action, F.lit("start"))
    return rows.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), named.alias("action"), percent.alias("percent"))


_STARTS = """st AS (SELECT user_id || '-' || event_type AS fingerprint, event_id AS job_id, ts, ts + INTERVAL 1 MINUTE * (event_id % 90) AS end_ts,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)"""


@query(
    f"WITH RECURSIVE {_STARTS}, m AS (SELECT fingerprint, k, job_id, job_id AS ran_as, end_ts FROM st WHERE k = 1 UNION ALL "
    "SELECT s.fingerprint, s.k, s.job_id, CASE WHEN s.ts < m.end_ts THEN m.ran_as ELSE s.job_id END, CASE WHEN s.ts < m.end_ts THEN m.end_ts ELSE s.end_ts END "
    "FROM m JOIN st s ON s.fingerprint = m.fingerprint AND s.k = m.k + 1) SELECT fingerprint, job_id, ran_as FROM m"
)
def in_flight_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that arrive while a job of the same fingerprint runs get that job's id."""
    rows = v.table(spark, sf_dir, "events")
    end = F.col("ts") + F.make_dt_interval(mins=F.col("event_id").cast("int") % 90)
    return jobs.deduplicated_starts(
        rows.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fingerprint"), F.col("event_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), end.alias("end_ts"))
    )


@query(f"WITH {EV}, {_LATEST} SELECT l.job_id, l.state, d.source AS display_name, d.doc_id IS NOT NULL AND d.doc_id % 2 = 0 AS from_cache FROM la l LEFT JOIN documents d ON d.doc_id = l.job_id")
def job_study_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the display name of their study, null when it is missing, and whether its result is cached."""
    studies = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("display_name"), F.lit(True).alias("known"))
    joined = jobs.latest(v.job_events(spark, sf_dir)).join(studies, "job_id", "left")
    return joined.select("job_id", "state", "display_name", (F.coalesce("known", F.lit(False)) & (F.col("job_id") % 2 == 0)).alias("from_cache"))


@query(
    f"WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) {_W} <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ev), b AS (SELECT *, sum(fresh) {_W} AS burst FROM g) "
    "SELECT job_id, max(seq) AS seq, max_by(state, seq) AS state, max_by(percent, seq) AS percent, min(ts) AS began, max(ts) AS ended, count(*) AS updates FROM b GROUP BY job_id, burst"
)
def coalesced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each burst of a job's updates; six quiet hours end a burst."""
    found = jobs.coalesced(v.job_events(spark, sf_dir), "6 hours")
    return found.select("job_id", "update.seq", "update.state", "update.percent", "began", "ended", "updates")


@query(f"WITH {EV} SELECT state, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM ev GROUP BY ALL")
def state_stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots per state and day, the batch form of the windowed stream (an addition)."""
    rows = v.job_events(spark, sf_dir)
    return rows.groupBy("state", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'get_job' WHEN 'click' THEN 'cancel_job' ELSE event_type END AS command, event_type IN ('view', 'click') AS supported FROM events")
def supported_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = tx.mapped(F.col("event_type"), {"view": "get_job", "click": "cancel_job"}, F.col("event_type"))
    return v.table(spark, sf_dir, "events").select("event_id", command.alias("command"), tx.is_supported_command(command).alias("supported"))


@query("SELECT o_orderdate AS batch, o_custkey AS job_id, min(o_orderkey) AS place FROM orders WHERE o_custkey % 7 <> 0 GROUP BY ALL")
def distinct_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's orders are a batch request; each id counts once."""
    asked = v.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("batch"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("job_id"), F.col("o_orderkey").alias("place"))
    return requests.distinct_ids(asked)


@query("SELECT event_id, user_id AS study_id, d.source AS name, CASE WHEN d.doc_id IS NULL THEN 'notFound: study not found: ' || user_id END AS error FROM events LEFT JOIN documents d ON d.doc_id = user_id AND d.doc_id % 3 > 0")
def study_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with their study, or the error of one that is not registered."""
    known = v.table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("study_id"), F.col("source").alias("name"))
    commands = v.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("study_id"))
    return requests.with_study(commands, known).select("event_id", "study_id", "name", "error")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'jpeg' WHEN event_id % 3 = 1 THEN 'png' END AS format FROM events")
def preview_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.when(F.col("event_id") % 3 == 0, "gray8").when(F.col("event_id") % 3 == 1, "rgba8").otherwise("gray16")
    return v.table(spark, sf_dir, "events").select("event_id", tx.preview_format(pixels).alias("format"))


_SCHEDULE = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {p}, '{s}')" for i, (k, p, s) in enumerate(jobs.STAGES)) + ") v(place, kind, wanted, stage))"
_REPORTS = """rp AS (SELECT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 'renderStudy' ELSE 'processStudy' END AS kind, ts, event_id AS seq,
  CASE event_id % 5 WHEN 0 THEN 'validating' WHEN 1 THEN 'loadingStudy' WHEN 2 THEN 'writingPreview' WHEN 3 THEN 'completed' ELSE 'uploading' END AS stage,
  (CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 35 WHEN 2 THEN 84 ELSE 100 END)::INT AS percent FROM events)"""


@query(
    f"WITH {_SCHEDULE}, {_REPORTS}, pl AS (SELECT rp.*, place, wanted FROM rp LEFT JOIN sc USING (kind, stage)), "
    "re AS (SELECT *, max(place) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM pl), "
    "er AS (SELECT job_id, seq, stage, CASE WHEN place IS NULL THEN 'unknown stage' WHEN percent <> wanted THEN 'expected percent ' || wanted WHEN place <= reached THEN 'stage out of order' END AS error FROM re) "
    "SELECT * FROM er WHERE error IS NOT NULL"
)
def stage_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress reports that break their job kind's schedule."""
    k = F.col("event_id") % 5
    stage = F.when(k == 0, "validating").when(k == 1, "loadingStudy").when(k == 2, "writingPreview").when(k == 3, "completed").otherwise("uploading")
    reports = v.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.when(F.col("user_id") % 2 == 0, "renderStudy").otherwise("processStudy").alias("kind"), "ts", F.col("event_id").alias("seq"),
        stage.alias("stage"), F.when(k == 0, 10).when(k == 1, 35).when(k == 2, 84).otherwise(100).alias("percent"),
    )
    return jobs.schedule_errors(reports).select("job_id", "seq", "stage", "error")


# ------------------------------------------------------------------ stores

_OPENED = "op AS (SELECT 'study-' || (event_id % 400) AS path, ts, event_id AS seq FROM events), lo AS (SELECT path, max(ts) AS ts, max(seq) AS seq FROM op GROUP BY path)"


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("study-"), (F.col("event_id") % 400).cast("string")).alias("path"), "ts", F.col("event_id").alias("seq"))


@query(f"WITH {_OPENED} SELECT path, ts, seq FROM lo ORDER BY ts DESC, seq DESC LIMIT 10")
def recent_studies_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.recent(_opened(spark, sf_dir))


@query(f"WITH {_OPENED} SELECT path, ts, seq FROM lo ORDER BY ts DESC, seq DESC LIMIT 32")
def retain_studies_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.recent(_opened(spark, sf_dir), 32)


@query(f"WITH {EV}, {_LATEST} SELECT job_id, ts, state FROM la WHERE state IN ('completed', 'failed', 'cancelled') ORDER BY ts DESC, seq DESC LIMIT 64")
def retain_terminal_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = jobs.latest(v.job_events(spark, sf_dir)).filter(tm.is_terminal(F.col("state")))
    return stores.retain_newest(ended, 64, F.desc("ts"), F.desc("seq")).select("job_id", "ts", "state")


_ACCESS = "ax AS (SELECT e.user_id AS key, e.ts, e.event_id AS seq, d.n_chars AS size FROM events e JOIN documents d ON d.doc_id = e.user_id), ky AS (SELECT key, max(ts) AS ts, max(seq) AS seq, max_by(size, seq) AS size FROM ax GROUP BY key)"


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"))
    return v.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq")).join(sizes, "key")


@query(f"WITH {_ACCESS} SELECT key, size, (row_number() OVER (ORDER BY ts DESC, seq DESC))::INT AS place FROM ky ORDER BY ts DESC, seq DESC LIMIT 32")
def lru_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.lru(_accesses(spark, sf_dir), capacity=32).select("key", "size", "place")


@query(
    f"WITH {_ACCESS}, rk AS (SELECT key, size, (row_number() OVER (ORDER BY ts DESC, seq DESC))::INT AS place, (sum(size) OVER (ORDER BY ts DESC, seq DESC))::BIGINT AS used_bytes FROM ky) "
    "SELECT key, size, place, used_bytes FROM rk WHERE used_bytes <= 60000 OR place = 1"
)
def lru_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.lru(_accesses(spark, sf_dir), max_bytes=60_000, keep_one=True)


@query(
    "WITH f AS (SELECT 'a-' || doc_id AS path, n_chars AS size, doc_id // 3 AS mod_time FROM documents), r AS (SELECT *, sum(size) OVER () AS total, "
    "coalesce(sum(size) OVER (ORDER BY mod_time, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f) SELECT path, size, mod_time, total - prior > 1000000 AS evicted FROM r"
)
def artifact_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v.table(spark, sf_dir, "documents").select(F.concat(F.lit("a-"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.floor(F.col("doc_id") / 3).alias("mod_time"))
    return stores.evict_oldest(files, 1_000_000, groups=16)


_STORE = """ar AS (SELECT c_custkey AS c, 'p' || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN -1 WHEN c_custkey % 3 = 0 THEN 150000 ELSE 9000000000 END AS gone FROM customer),
pt AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN 'processStudy' ELSE 'renderStudy' END AS kind, (c_custkey % 40 * 1000)::BIGINT AS at_ms FROM customer WHERE c_custkey % 4 > 0
  UNION ALL SELECT c_custkey, 'renderStudy', 200000 FROM customer WHERE c_custkey % 6 = 0),
ak AS (SELECT o_custkey AS c, o_orderkey AS job_id, CASE WHEN o_orderkey % 9 = 0 THEN 'processStudy' ELSE 'renderStudy' END AS kind, (o_orderkey % 1000 * 400)::BIGINT AS at_ms FROM orders),
al AS (SELECT c, at_ms, 0 AS turn, NULL::BIGINT AS job_id, kind FROM pt UNION ALL SELECT c, at_ms, 1, job_id, kind FROM ak),
rw AS (SELECT al.*, coalesce(gone, -1) AS gone, row_number() OVER (PARTITION BY al.c ORDER BY at_ms, turn, job_id) AS k FROM al LEFT JOIN ar USING (c)),
ho AS (SELECT c, 0::BIGINT AS k, NULL::BIGINT AS job_id, NULL::VARCHAR AS asked, NULL::VARCHAR AS outcome, NULL::VARCHAR AS held, 0::BIGINT AS looked FROM (SELECT DISTINCT c FROM rw) UNION ALL
  SELECT c, k, job_id, asked, outcome, CASE WHEN turn = 0 THEN asked WHEN outcome = 'hit' THEN held END, CASE WHEN turn = 0 OR due THEN at_ms ELSE looked END
  FROM (SELECT *, CASE WHEN turn = 0 THEN NULL WHEN held IS NULL THEN 'miss' WHEN due AND gone <= at_ms THEN 'stale' WHEN held <> asked THEN 'kindMismatch' ELSE 'hit' END AS outcome
    FROM (SELECT rw.c, rw.k, rw.job_id, rw.kind AS asked, rw.turn, rw.at_ms, rw.gone, ho.held, ho.looked, rw.at_ms - ho.looked >= 60000 AS due FROM ho JOIN rw ON rw.c = ho.c AND rw.k = ho.k + 1)))"""


def _result_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders ask for results that customers' jobs have stored; some artifacts go, some never were."""
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    named = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    first = c.filter("k % 4 > 0").withColumn("kind", F.when(F.col("k") % 5 == 0, "processStudy").otherwise("renderStudy")).withColumn("at_ms", F.col("k") % 40 * 1000)
    again = c.filter("k % 6 = 0").withColumn("kind", F.lit("renderStudy")).withColumn("at_ms", F.lit(200_000).cast("long"))
    stored = first.union(again).select(named("f", "k").alias("fingerprint"), "kind", named("p", "k").alias("path"), "at_ms")
    there = c.filter("k % 7 <> 0").select(named("p", "k").alias("path"), F.when(F.col("k") % 3 == 0, 150_000).cast("long").alias("gone_ms"))
    asked = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), named("f", "o_custkey").alias("fingerprint"), F.when(F.col("o_orderkey") % 9 == 0, "processStudy").otherwise("renderStudy").alias("kind"), (F.col("o_orderkey") % 1000 * 400).alias("at_ms")
    )
    return stores.result_store(asked, stored, there)


@query(
    f"WITH RECURSIVE {_STORE} SELECT job_id, outcome, CASE WHEN outcome = 'hit' THEN 'completed' END AS state, CASE WHEN outcome = 'hit' THEN 'cacheHit' END AS stage, "
    "CASE WHEN outcome = 'hit' THEN 100 END AS percent, outcome = 'hit' AS from_cache, CASE WHEN outcome = 'hit' THEN 'p' || c END AS path FROM ho WHERE outcome IS NOT NULL"
)
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against stored results: hits become completed snapshots of new jobs."""
    return _result_store(spark, sf_dir)[0].select("job_id", "outcome", "state", "stage", "percent", "from_cache", "path")


@query(f"WITH RECURSIVE {_STORE} SELECT 'f' || c AS fingerprint, max_by(held, k) AS kind, 'p' || c AS path, max_by(looked, k) AS checked_ms FROM (SELECT *, coalesce(held, '') AS h FROM ho) GROUP BY c HAVING max_by(h, k) <> ''")
def result_store_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store of results holds after all requests."""
    return _result_store(spark, sf_dir)[1]


@query(
    "SELECT event_id, CASE WHEN len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 THEN 'unknown field' WHEN NOT list_contains(json_keys(props), 'k') THEN 'missing field k' ELSE '' END AS errors FROM events"
)
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties against a contract of one integer field."""
    errors = contracts.contract_errors(F.col("props"), {"k": "integer"}, ["k"])
    return v.table(spark, sf_dir, "events").select("event_id", F.array_join(errors, "|").alias("errors"))


EVENT_SCHEMA = {
    "$defs": {
        "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}}},
        "event": {
            "type": "object", "additionalProperties": False, "required": ["id", "type", "user"],
            "properties": {
                "id": {"type": "integer", "minimum": 5}, "type": {"enum": ["view", "click", "purchase", "error"]},
                "user": {"anyOf": [{"$ref": "#/$defs/user"}, {"type": "null"}]}, "next": {"$ref": "#/$defs/event"},
            },
        },
    }
}


@query(
    "WITH e AS (SELECT event_id AS key, event_type FROM events), r AS ("
    "SELECT key, 'event.type' AS place, 'expected one of \"view\", \"click\", \"purchase\", \"error\", received \"' || event_type || '\"' AS error FROM e WHERE event_type NOT IN ('view', 'click', 'purchase', 'error') "
    "UNION ALL SELECT key, 'event.user', 'value does not match any allowed shape' FROM e WHERE key % 7 = 0 UNION ALL SELECT key, 'event.extra', 'unexpected property' FROM e WHERE key % 11 = 0 "
    "UNION ALL SELECT key, 'event.id', 'below 5' FROM e WHERE key < 5 UNION ALL SELECT key, 'event.next.id', 'below 5' FROM e WHERE key < 5 AND key % 3 = 0 "
    "UNION ALL SELECT key, 'event.next.user', 'missing required property' FROM e WHERE key % 3 = 0 AND key % 6 <> 0) SELECT key, place, error FROM r"
)
def contract_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON of events, some of them wrong, against a schema that refers to itself."""
    k, text = F.col("event_id"), F.col("event_id").cast("string")
    user = F.when(k % 7 == 0, '"nobody"').otherwise(F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit("}")))
    nothing = F.lit("")
    following = F.when(k % 6 == 0, F.concat(F.lit(', "next": {"type": "view", "user": null, "id": '), text, F.lit("}"))).when(k % 3 == 0, F.concat(F.lit(', "next": {"type": "view", "id": '), text, F.lit("}"))).otherwise(nothing)
    extra = F.when(k % 11 == 0, F.lit(', "extra": [1, {"deep": true}]')).otherwise(nothing)
    payload = F.concat(F.lit('{"id": '), text, F.lit(', "type": "'), "event_type", F.lit('", "user": '), user, following, extra, F.lit("}"))
    rows = v.table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return checks.schema_errors(rows, "event_id", "payload", EVENT_SCHEMA, "event").withColumnRenamed("at", "place")


@query(
    "WITH o AS (SELECT p_size AS definition, p_brand AS property, p_type AS type FROM part), n AS (SELECT p_size AS definition, p_brand AS property, p_type AS type FROM part WHERE p_partkey % 10 <> 0 "
    "UNION ALL SELECT p_size, p_brand, p_type FROM part WHERE p_partkey % 17 = 0), a AS (SELECT * FROM n EXCEPT ALL SELECT * FROM o), d AS (SELECT * FROM o EXCEPT ALL SELECT * FROM n) "
    "SELECT 'added' AS change, definition, property, type FROM a UNION ALL SELECT 'removed', definition, property, type FROM d"
)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table of definitions: what came and what went, counted by rows."""
    part = v.table(spark, sf_dir, "part")
    named = lambda rows: rows.select(F.col("p_size").alias("definition"), F.col("p_brand").alias("property"), F.col("p_type").alias("type"))
    return checks.schema_drift(named(part), named(part.filter("p_partkey % 10 <> 0")).union(named(part.filter("p_partkey % 17 = 0"))))
