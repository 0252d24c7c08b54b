"""Pixel queries over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions import pixels as px
from rayloom.functions import text as tx
from rayloom.operators import corpus, images, requests
from rayloom.plans import views as v
from rayloom.plans.catalog import query

# ------------------------------------------------------------------ SQL building blocks

PX = """px AS (SELECT vec_id AS image_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
RANGE = "rg AS (SELECT image_id, pos, v, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM px)"
U16 = PX.replace("unnest(embedding)::DOUBLE AS v", "floor((unnest(embedding)::DOUBLE + 1.0::DOUBLE) * 2048.0::DOUBLE)::INT AS v")


def clamp(x: str) -> str:
    return f"floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {x})) + 0.5::DOUBLE)::INT"


def linear(x: str) -> str:
    return f"CASE WHEN hi <= lo THEN 0 ELSE {clamp(f'({x} - lo) * (255.0::DOUBLE / nullif(hi - lo, 0))')} END"


def window(x: str, c: str, w: str) -> str:
    mid, half, scale = f"({c} - 0.5::DOUBLE)", f"(({w} - 1.0::DOUBLE) / 2.0::DOUBLE)", f"(255.0::DOUBLE / ({w} - 1.0::DOUBLE))"
    inner = clamp(f"{x} * {scale} + (127.5::DOUBLE - {mid} * {scale})")
    return f"CASE WHEN {x} <= {mid} - {half} THEN 0 WHEN {x} > {mid} + {half} THEN 255 ELSE {inner} END"


def brighter(g: str, d: int) -> str:
    return f"least(255, greatest(0, {g} + ({d})))"


def contrasted(g: str, f: float) -> str:
    return f"least(255.0::DOUBLE, greatest(0.0::DOUBLE, round(128.0::DOUBLE + {f}::DOUBLE * (({g})::DOUBLE - 128.0::DOUBLE))))::INT"


FULL = f"WITH {PX}, {RANGE}, gr AS (SELECT image_id, pos, {linear('v')} AS g FROM rg)"
EQUALIZE = """
h AS (SELECT image_id, g, count(*) AS n FROM {src} GROUP BY ALL),
c AS (SELECT image_id, g, sum(n) OVER (PARTITION BY image_id ORDER BY g)::BIGINT AS cdf, sum(n) OVER (PARTITION BY image_id)::BIGINT AS total,
      first_value(n) OVER (PARTITION BY image_id ORDER BY g)::BIGINT AS cdf_min FROM h),
t AS (SELECT image_id, g, (CASE WHEN total = cdf_min THEN g WHEN cdf <= cdf_min THEN 0
      ELSE ((cdf - cdf_min) * 255 + (total - cdf_min) // 2) // (total - cdf_min) END)::INT AS equalized FROM c)"""


def equalize(src: str) -> str:
    return EQUALIZE.format(src=src)


# ------------------------------------------------------------------ rendering


@query("SELECT vec_id AS image_id, list_min(embedding)::DOUBLE AS min_value, list_max(embedding)::DOUBLE AS max_value FROM embeddings")
def image_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.with_range(v.img_packed(spark, sf_dir)).select("image_id", "min_value", "max_value")


@query(f"{FULL} SELECT image_id, pos, g FROM gr")
def linear_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels_of(v.rendered(spark, sf_dir), g="gray")


_C, _W = "(CASE WHEN image_id % 3 <> 0 THEN 2000.0 + image_id % 100 END)::DOUBLE", "(CASE WHEN image_id % 5 = 0 THEN 1.0 ELSE 900.0 END)::DOUBLE"


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-bit images, some with a window, some with one that is too narrow, some inverted."""
    k = F.col("image_id")
    return images.with_range(v.img_u16(spark, sf_dir)).withColumns(
        {
            "window_center": F.when(k % 3 != 0, (k % 100).cast("double") + 2000.0),
            "window_width": F.when(k % 5 == 0, 1.0).otherwise(900.0),
            "invert": k % 2 == 0,
        }
    )


_SHOWN = f"CASE WHEN c IS NOT NULL AND w > 1 THEN {window('v', 'c', 'w')} ELSE {linear('v')} END"
_U = f"WITH {U16}, {RANGE}"


@query(
    f"{_U}, w AS (SELECT image_id, pos, v::DOUBLE AS v, lo::DOUBLE AS lo, hi::DOUBLE AS hi, {_C} AS c, {_W} AS w FROM rg) "
    f"SELECT image_id, pos, (CASE WHEN image_id % 2 = 0 THEN 255 - ({_SHOWN}) ELSE {_SHOWN} END)::INT AS g FROM w"
)
def window_render_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels_of(images.render(_windowed(spark, sf_dir)), g="gray")


@query(f"{_U} SELECT image_id, pos, ({window('v::DOUBLE', '2048.0::DOUBLE', '1000.0::DOUBLE')})::INT AS g FROM rg")
def window_render_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = images.with_range(v.img_u16(spark, sf_dir))
    return v.pixels_of(images.render(packed, "manual", 2048.0, 1000.0), g="gray")


@query(f"{_U}, w AS (SELECT image_id, pos, v::DOUBLE AS v, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM rg) SELECT image_id, pos, ({linear('v')})::INT AS g FROM w")
def window_render_fullrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels_of(images.render(_windowed(spark, sf_dir).drop("invert"), "full"), g="gray")


@query(
    f"WITH {U16}, s AS (SELECT image_id, pos, v::DOUBLE * 0.37::DOUBLE + 5.25::DOUBLE AS v FROM px), {RANGE.replace('FROM px', 'FROM s')} "
    f"SELECT image_id, pos, ({linear('floor(v + 0.5::DOUBLE)')})::INT AS g FROM rg"
)
def lut_quantized_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = images.map_pixels(v.img_u16(spark, sf_dir), lambda x: px.rescale(x, 0.37, 5.25))
    return v.pixels_of(images.render(images.with_range(packed), "full"), g="gray")


@query(
    f"WITH {U16}, b AS (SELECT image_id, pos, (image_id % 14)::BIGINT AS bits, image_id % 2 = 1 AS signed, (v::BIGINT * 977 + image_id) AS raw FROM px), "
    "m AS (SELECT *, CASE WHEN bits = 0 THEN 4294967296 ELSE (1::BIGINT << bits) END AS span FROM b) "
    "SELECT image_id, pos, (CASE WHEN (signed OR bits = 0) AND raw % span >= span // 2 THEN raw % span - span ELSE raw % span END)::BIGINT AS stored, "
    "((CASE WHEN (signed OR bits = 0) AND raw % span >= span // 2 THEN raw % span - span ELSE raw % span END)::DOUBLE * 2.0::DOUBLE + -10.0::DOUBLE) AS rescaled FROM m"
)
def stored_value_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("image_id")
    packed = v.img_u16(spark, sf_dir)
    rows = packed.select("image_id", F.posexplode("pixels").alias("pos", "v")).withColumn("raw", F.col("v").cast("long") * 977 + k)
    stored = px.stored_value(F.col("raw"), (k % 14).cast("int"), k % 2 == 1)
    return rows.withColumn("stored", stored).select("image_id", "pos", "stored", px.rescale(F.col("stored"), 2.0, -10.0).alias("rescaled"))


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * 5) % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, ((19595 * r * 257 + 38470 * g * 257 + 7471 * b * 257 + 32768) // 16777216)::INT AS luma FROM c"
)
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem")
    shown = px.luma(F.col("l_quantity").cast("long") * 5 % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 256)
    return rows.select("l_orderkey", "l_linenumber", shown.alias("luma"))


# ------------------------------------------------------------------ point operations, histograms


def _point_ops(name: str, invert: bool, brightness: int, contrast: float) -> None:
    g = "255 - g" if invert else "g"
    g = brighter(g, brightness) if brightness else g
    g = contrasted(g, contrast) if contrast != 1.0 else g

    @query(f"{FULL} SELECT image_id, pos, ({g})::INT AS g FROM gr", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = images.map_pixels(
            v.rendered(spark, sf_dir).withColumn("pixels", F.col("gray")), lambda x: px.point_ops(x, invert, brightness, contrast)
        )
        return v.pixels_of(done, g="pixels")


_point_ops("point_ops_xray", False, 10, 1.4)
_point_ops("point_ops_high_contrast", False, 0, 1.8)
_point_ops("point_ops_invert", True, -20, 0.5)


@query("SELECT l_orderkey AS image_id, l_quantity::INT AS g, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.histogram(v.lineitem_pixels(spark, sf_dir))


_LI = "WITH src AS (SELECT l_orderkey AS image_id, l_quantity::INT AS g FROM lineitem)"


@query(f"{_LI}, {equalize('src')} SELECT image_id, g, cdf, cdf_min, total FROM c")
def histogram_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.cumulative_histogram(images.histogram(v.lineitem_pixels(spark, sf_dir))).select("image_id", "g", "cdf", "cdf_min", "total")


@query(f"{_LI}, {equalize('src')} SELECT s.image_id, s.g, t.equalized FROM src s JOIN t USING (image_id, g)")
def equalize_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.equalize_long(v.lineitem_pixels(spark, sf_dir))


@query(f"{FULL}, {equalize('gr')} SELECT image_id, pos, equalized FROM gr JOIN t USING (image_id, g)")
def equalize_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels_of(images.equalize_packed(v.rendered(spark, sf_dir)), equalized="equalized")


_XRAY = f"{FULL}, po AS (SELECT image_id, pos, g AS plain, ({contrasted(brighter('g', 10), 1.4)}) AS g FROM gr), {equalize('po')}"


def _xray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = v.rendered(spark, sf_dir).withColumn("plain", F.col("gray"))
    done = rendered.withColumn("gray", F.transform("gray", lambda g: px.point_ops(g, False, 10, 1.4)))
    return images.equalize_packed(done).withColumn("gray", F.col("equalized"))


@query(f"{_XRAY} SELECT image_id, pos, equalized FROM po JOIN t USING (image_id, g)")
def equalize_after_point_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pixels_of(_xray(spark, sf_dir), equalized="equalized")


@query("SELECT o_orderkey AS image_id, (o_custkey % 256)::INT AS g, (o_custkey % 256)::INT AS equalized FROM orders")
def equalize_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one pixel have one value and stay as they are."""
    one = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 256).cast("int").alias("g"))
    return images.equalize_long(one)


@query(
    f"{FULL}, {equalize('gr')} SELECT image_id, count(*) AS pixels, sum(equalized)::BIGINT AS equalized_sum, min(equalized) AS darkest, "
    "max(equalized) AS brightest FROM gr JOIN t USING (image_id, g) GROUP BY image_id"
)
def equalized_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: linear map, equalization and a summary per image, in one stage without shuffle."""
    done = images.equalize_packed(v.rendered(spark, sf_dir))
    total = F.aggregate("equalized", F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select(
        "image_id", F.size("equalized").cast("long").alias("pixels"), total.alias("equalized_sum"),
        F.array_min("equalized").alias("darkest"), F.array_max("equalized").alias("brightest"),
    )


# ------------------------------------------------------------------ palettes, comparison, pipeline

_HOT = "CASE WHEN {g} <= 84 THEN {g} * 3 ELSE 255 END AS r, CASE WHEN {g} <= 84 THEN 0 WHEN {g} <= 169 THEN ({g} - 85) * 3 ELSE 255 END AS gr, CASE WHEN {g} <= 169 THEN 0 ELSE ({g} - 170) * 3 END AS b"
_BONE = "least(255, {g} * 7 // 8 + greatest({g} - 128, 0)) AS r, least(255, {g} * 7 // 8 + greatest({g} - 128, 0) + {g} // 16) AS gr, least(255, {g} + greatest({g} - 128, 0) // 2) AS b"


def _palette(name: str, sql: str) -> None:
    @query(f"{FULL}, c AS (SELECT image_id, pos, {sql.format(g='g')} FROM gr) SELECT image_id, pos, r::INT AS r, gr::INT AS g, b::INT AS b, 255 AS a FROM c", f"palette_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = v.pixels_of(images.palette(v.rendered(spark, sf_dir), name), p="rgba")
        return shown.select("image_id", "pos", "p.r", "p.g", "p.b", "p.a")


_palette("hot", _HOT)
_palette("bone", _BONE)


def _rgba_pixels(packed: DataFrame, column: str) -> DataFrame:
    shown = packed.select("image_id", "width", "height", F.posexplode(column).alias("pos", "p"))
    at = F.col("pos")
    return shown.select(
        "image_id", "width", "height", (at % F.col("width")).alias("x"), F.floor(at / F.col("width")).cast("int").alias("y"), "p.r", "p.g", "p.b", "p.a"
    )


@query(
    f"{_XRAY}, f AS (SELECT image_id, pos, plain, equalized FROM po JOIN t USING (image_id, g)), "
    f"d AS (SELECT image_id, pos % 8 AS x, pos // 8 AS y, plain AS r, plain AS gr, plain AS b FROM f UNION ALL "
    f"SELECT image_id, pos % 8 + 8 AS x, pos // 8 AS y, {_BONE.format(g='equalized')} FROM f) "
    "SELECT image_id, 16 AS width, 8 AS height, x::INT AS x, y::INT AS y, r::INT AS r, gr::INT AS g, b::INT AS b, 255 AS a FROM d"
)
def pipeline_xray_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render, point operations, equalization, palette, and the comparison with the plain render on the left."""
    done = images.palette(_xray(spark, sf_dir), "bone").withColumn("left", F.transform("plain", px.gray_rgba))
    both = _rgba_pixels(images.compare_packed(done, "left", "rgba"), "both")
    return both.select("image_id", "width", "height", "x", "y", "r", "g", "b", "a")


@query(
    f"{FULL}, c AS (SELECT image_id, (pos % 8)::INT AS x, (pos // 8)::INT AS y, g FROM gr UNION ALL "
    "SELECT image_id, (pos % 8 + 8)::INT AS x, (pos // 8)::INT AS y, 255 - g FROM gr) SELECT image_id, 16 AS width, x, y, g::INT AS r FROM c"
)
def compare_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = v.rendered(spark, sf_dir)
    left = _rgba_pixels(images.palette(shown, "gray"), "rgba")
    right = _rgba_pixels(images.palette(shown.withColumn("gray", F.transform("gray", px.inverted)), "gray"), "rgba")
    return images.compare(left, right).select("image_id", "width", "x", "y", "r")


# ------------------------------------------------------------------ requests

REQUESTS = """req AS (SELECT p_partkey,
  CASE WHEN p_partkey % 4 = 0 THEN ' XRAY ' WHEN p_partkey % 4 = 1 THEN 'default' WHEN p_partkey % 4 = 2 THEN 'high-contrast'
       WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'xray' END AS preset_id,
  p_partkey % 5 = 0 AS invert, CASE WHEN p_partkey % 3 <> 0 THEN (p_size - 25) * 12 END::INT AS brightness,
  CASE WHEN p_partkey % 7 <> 0 THEN round(p_retailprice / 1000.0::DOUBLE * 10.0::DOUBLE) / 10.0::DOUBLE - 0.3::DOUBLE END AS contrast,
  CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 2 = 0 END AS equalize, p_partkey % 9 = 0 AS compare,
  CASE p_partkey % 8 WHEN 0 THEN ' Hot ' WHEN 1 THEN 'BONE' WHEN 2 THEN 'magma' WHEN 3 THEN '' END AS palette FROM part),
pre AS (SELECT * FROM (VALUES (0, 'default', 0, 1.0::DOUBLE, false, false, 'none'), (1, 'xray', 10, 1.4::DOUBLE, false, true, 'bone'),
  (2, 'high-contrast', 0, 1.8::DOUBLE, false, true, 'none')) v(p_ord, p_id, p_brightness, p_contrast, p_invert, p_equalize, p_palette)),
j AS (SELECT * FROM req LEFT JOIN pre ON lower(trim(preset_id)) = p_id)"""
_RESOLVED = """WITH {req}, r AS (SELECT *, coalesce(brightness, p_brightness) AS rb, coalesce(contrast, p_contrast) AS rc,
  CASE WHEN palette IS NULL THEN p_palette WHEN trim(palette) = '' THEN 'none' WHEN lower(trim(palette)) IN ('none', 'hot', 'bone') THEN lower(trim(palette)) END AS rp FROM j),
e AS (SELECT *, CASE WHEN p_id IS NULL THEN 'invalidInput: preset must be one of default, xray, high-contrast'
  WHEN NOT rb BETWEEN -256 AND 256 THEN 'invalidInput: brightness must be between -256 and 256'
  WHEN NOT (rc >= 0) THEN 'invalidInput: contrast must be a finite number >= 0'
  WHEN rp IS NULL THEN 'invalidInput: palette must be one of none, hot, bone' END AS error FROM r),
s AS (SELECT p_partkey, preset_id, error, CASE WHEN error IS NULL THEN coalesce(invert, false) OR coalesce(p_invert, false) END AS invert,
  CASE WHEN error IS NULL THEN rb END::INT AS brightness, CASE WHEN error IS NULL THEN rc END AS contrast,
  CASE WHEN error IS NULL THEN coalesce(equalize, false) OR coalesce(p_equalize, false) END AS equalize,
  CASE WHEN error IS NULL THEN coalesce(compare, false) END AS compare, CASE WHEN error IS NULL THEN rp END AS palette FROM e)""".format(req=REQUESTS)


@query(f"{_RESOLVED} SELECT * FROM s")
def resolve_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.resolve(v.requests(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT p_partkey, p_id, p_brightness FROM j WHERE p_id IS NOT NULL")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.with_preset(v.requests(spark, sf_dir)).filter("p_id is not null").select("p_partkey", "p_id", "p_brightness")


@query(f"WITH {REQUESTS} SELECT p_partkey, preset_id FROM j WHERE p_id IS NULL")
def preset_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.unknown_presets(v.requests(spark, sf_dir)).select("p_partkey", "preset_id")


_CONTROLS = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 10 ELSE 0 END AS brightness,
  1.0::DOUBLE + (c_custkey % 100)::DOUBLE / 100.0::DOUBLE AS contrast, c_custkey % 10 = 9 AS invert, c_custkey % 3 > 0 AS equalize,
  CASE WHEN c_custkey % 3 = 1 THEN 'bone' ELSE 'none' END AS palette FROM customer)"""


@query(
    f"WITH {_CONTROLS} SELECT c_custkey, CASE WHEN brightness = 0 AND abs(contrast - 1.0::DOUBLE) < 0.05::DOUBLE AND NOT invert AND NOT equalize AND palette = 'none' THEN 'Neutral' "
    "WHEN brightness = 10 AND abs(contrast - 1.4::DOUBLE) < 0.05::DOUBLE AND NOT invert AND equalize AND palette = 'bone' THEN 'Bone Focus' "
    "WHEN brightness = 0 AND abs(contrast - 1.8::DOUBLE) < 0.05::DOUBLE AND NOT invert AND equalize AND palette = 'none' THEN 'High Contrast' ELSE 'Custom' END AS preset_label FROM c"
)
def preset_match_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    controls = v.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 == 1, 10).otherwise(0).alias("brightness"), ((k % 100).cast("double") / 100.0 + 1.0).alias("contrast"),
        (k % 10 == 9).alias("invert"), (k % 3 > 0).alias("equalize"), F.when(k % 3 == 1, "bone").otherwise("none").alias("palette"),
    )
    return requests.match_preset(controls, "c_custkey")


@query(
    f"WITH {REQUESTS} SELECT p_partkey, preset_id, invert AND NOT p_invert AS invert, CASE WHEN brightness IS DISTINCT FROM p_brightness THEN brightness END AS brightness, "
    "CASE WHEN contrast IS DISTINCT FROM p_contrast THEN contrast END AS contrast, equalize AND NOT p_equalize AS equalize, compare, "
    "CASE WHEN palette IS DISTINCT FROM p_palette THEN palette END AS palette FROM j"
)
def request_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_diff(v.requests(spark, sf_dir)).select(
        "p_partkey", "preset_id", "invert", "brightness", "contrast", "equalize", "compare", "palette"
    )


_NUM = "regexp_replace(contrast::VARCHAR, '\\.0$', '')"


@query(
    f"{_RESOLVED} SELECT p_partkey, CASE WHEN compare THEN 'comparison of grayscale and ' ELSE '' END || CASE WHEN invert THEN 'inverted grayscale' ELSE 'grayscale' END || "
    "CASE WHEN brightness <> 0 THEN ' with brightness ' || printf('%+d', brightness) ELSE '' END || "
    "CASE WHEN tenths <> 10 THEN ' with contrast ' || (tenths // 10)::VARCHAR || CASE WHEN tenths % 10 <> 0 THEN '.' || (tenths % 10)::VARCHAR ELSE '' END ELSE '' END || "
    "CASE WHEN equalize THEN ' with histogram equalization' ELSE '' END || CASE WHEN palette <> 'none' THEN ' with ' || palette || ' palette' ELSE '' END AS mode "
    "FROM (SELECT *, round(contrast * 10.0::DOUBLE)::INT AS tenths FROM s WHERE error IS NULL)"
)
def mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = requests.resolve(v.requests(spark, sf_dir)).filter("error is null").withColumn("contrast", F.round(F.col("contrast") * 10.0) / 10.0)
    label = tx.mode_label(*[F.col(c) for c in ("invert", "brightness", "contrast", "equalize", "palette", "compare")])
    return ok.select("p_partkey", label.alias("mode"))


@query(
    f"WITH {REQUESTS} SELECT p_partkey, CASE WHEN palette IS NULL OR trim(palette) = '' THEN 'none' WHEN lower(trim(palette)) IN ('none', 'hot', 'bone') "
    "THEN lower(trim(palette)) END AS palette FROM req"
)
def palette_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.requests(spark, sf_dir).select("p_partkey", px.palette_name(F.col("palette")).alias("palette"))


_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"' END"


@query(
    f"WITH {REQUESTS}, f AS (SELECT p_partkey, 'studies/<' || p_partkey || '>.dcm' AS path, preset_id, invert, brightness, round(contrast * 10.0::DOUBLE)::INT AS tenths, equalize, compare, palette FROM req) "
    "SELECT p_partkey, sha256('{\"namespace\":\"render-study-v1\",\"inputPath\":\"studies/\\u003c' || p_partkey || '\\u003e.dcm\"}') AS render_key, "
    "sha256('{\"namespace\":\"process-study-v3\",\"inputPath\":\"studies/\\u003c' || p_partkey || '\\u003e.dcm\",\"presetId\":\"' || preset_id || '\",\"invert\":' || invert || "
    "',\"brightness\":' || coalesce(brightness::VARCHAR, 'null') || ',\"contrast\":' || coalesce(CASE WHEN tenths < 0 THEN '-' ELSE '' END || (abs(tenths) // 10)::VARCHAR || "
    "CASE WHEN tenths % 10 <> 0 THEN '.' || (abs(tenths) % 10)::VARCHAR ELSE '' END, 'null') || ',\"equalize\":' || coalesce(equalize, false) || ',\"compare\":' || compare || "
    f"',\"palette\":' || {_JSON.format('palette')} || '}}') AS process_key FROM f"
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of render and process requests."""
    path = F.concat(F.lit("studies/<"), F.col("p_partkey").cast("string"), F.lit(">.dcm"))
    asked = v.requests(spark, sf_dir).withColumn("contrast", F.round(F.col("contrast") * 10.0) / 10.0)
    return asked.select("p_partkey", requests.render_fingerprint(path).alias("render_key"), requests.process_fingerprint(path).alias("process_key"))


@query(
    f"WITH {REQUESTS} SELECT p_partkey, p_partkey % 2 = 0 AND preset_id = 'default' AND NOT invert AND brightness IS NULL AND contrast IS NULL AND NOT coalesce(equalize, false) AND NOT compare "
    "AND coalesce(trim(palette), '') = '' AS plain FROM req"
)
def plain_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    preview = F.when(c("p_partkey") % 2 == 0, "out.png").otherwise(" ")
    plain = tx.is_plain_preview(preview, F.lit(None).cast("string"), c("preset_id"), c("invert"), c("brightness"), c("contrast"), c("equalize"), c("compare"), c("palette"))
    return v.requests(spark, sf_dir).select("p_partkey", plain.alias("plain"))


@query("SELECT vec_id AS image_id, vec_id % 3 + list_min(list_transform(embedding, lambda x: floor((x::DOUBLE + 1.0::DOUBLE) * 2048.0::DOUBLE)))::DOUBLE * 0.5::DOUBLE AS darkest, "
       "vec_id % 3 + list_max(list_transform(embedding, lambda x: floor((x::DOUBLE + 1.0::DOUBLE) * 2048.0::DOUBLE)))::DOUBLE * 0.5::DOUBLE AS brightest FROM embeddings")  # fmt: skip
def modality_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored samples through a slope and an intercept of their image."""
    scaled = v.img_u16(spark, sf_dir).withColumn("v", F.transform("pixels", lambda p: px.rescale(p, 0.5, F.col("image_id") % 3)))
    return scaled.select("image_id", F.array_min("v").alias("darkest"), F.array_max("v").alias("brightest"))


@query(
    "SELECT 'e-' || vec_id AS path, 8 AS width, 8 AS height, 'gray-f32' AS format, len(embedding)::INT AS pixel_count, list_min(embedding)::DOUBLE AS min_value, list_max(embedding)::DOUBLE AS max_value, "
    "CASE WHEN vec_id % 4 > 1 THEN (vec_id % 4)::DOUBLE END AS window_width FROM embeddings"
)
def decode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decode found, without the pixels."""
    none = lambda kind: F.lit(None).cast(kind)
    decoded = images.with_range(v.img_packed(spark, sf_dir)).withColumns({
        "path": F.concat(F.lit("e-"), F.col("image_id").cast("string")), "window_center": F.lit(0.0), "window_width": (F.col("image_id") % 4).cast("double"), "invert": F.lit(False),
        "scale": none("struct<row:double,col:double,source:string>"), "study_uid": none("string"), "preserved": none("array<string>"),
    })
    return corpus.decode_summary(decoded).select("path", "width", "height", "format", "pixel_count", "min_value", "max_value", F.col("default_window.width").alias("window_width"))
