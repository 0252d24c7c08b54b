import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.functions import kernels
from rayloom.functions import pixels as px
from rayloom.functions import text as tx
from rayloom.operators import images, requests


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def many(spark, values, function, kind="double"):
    return one(spark, F.transform(F.array(*[F.lit(x).cast(kind) for x in values]), function))


@pytest.mark.parametrize(
    "values, function, want",
    [
        ([-4, 127.49, 127.5, 300], px.clamp_to_byte, [0, 127, 128, 255]),
        ([0, 127.5, 255], lambda v: px.map_window(v, 128.0, 256.0), [0, 128, 255]),
        ([0, 512, 1024], lambda v: px.map_linear(v, 0.0, 1024.0), [0, 128, 255]),
        ([5, 6], lambda v: px.map_linear(v, 6.0, 6.0), [0, 0]),
        ([0, 64, 128], lambda v: px.render(v, F.lit(0), F.lit(128), "full", 5.0, 2.0), [0, 128, 255]),
        ([0, 127.5, 255], lambda v: px.render(v, F.lit(0), F.lit(255), "default", 128.0, 256.0, True), [255, 127, 0]),
        ([-100, 70000], lambda v: px.render(v, F.lit(-100), F.lit(70000), "full"), [0, 255]),
        ([10, 20], lambda v: px.render(v, F.lit(10), F.lit(20), "manual", 5.0, 1.0), [0, 255]),
    ],
)
def test_mapping(spark, values, function, want):
    assert many(spark, values, function) == want


@pytest.mark.parametrize(
    "values, function, want",
    [
        ([100], lambda g: px.point_ops(g, True, 20, 2.0), [222]),
        ([0, 250], lambda g: px.brightened(g, 10), [10, 255]),
        ([0, 127, 128, 255], lambda g: px.contrasted(g, 2.0), [0, 126, 128, 255]),
    ],
)
def test_point_operations(spark, values, function, want):
    assert many(spark, values, function, "int") == want


def colours(spark, name, values):
    rows = spark.createDataFrame([(1, values)], "image_id long, gray array<int>")
    return [tuple(p)[:3] for p in images.palette(rows, name).first().rgba]


def test_palettes(spark):
    assert colours(spark, "hot", [0, 84, 85, 170, 255]) == [(0, 0, 0), (252, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)]
    assert colours(spark, "bone", [0, 128, 255]) == [(0, 0, 0), (112, 120, 128), (255, 255, 255)]
    with pytest.raises(ValueError):
        colours(spark, "none", [0])
    names = [one(spark, px.palette_name(F.lit(x))) for x in ("", "none", " Hot ", "BONE", "rainbow")]
    assert names == ["none", "none", "hot", "bone", None]


def equalized(spark, values):
    packed = spark.createDataFrame([(1, values)], "image_id long, gray array<int>")
    long = spark.createDataFrame([(1, i, g) for i, g in enumerate(values)] or [], "image_id long, pos int, g int")
    got = images.equalize_packed(packed).first().equalized
    assert got == [r.equalized for r in images.equalize_long(long).orderBy("pos").collect()]
    return got


@pytest.mark.parametrize("values, want", [([0, 128, 128, 255], [0, 170, 170, 255]), ([20, 70, 220, 220], [0, 85, 255, 255]), ([42, 42, 42], [42, 42, 42]), ([], [])])
def test_equalize(spark, values, want):
    assert equalized(spark, values) == want


def test_golden_chain(spark):
    """Window, brightness 10, contrast 1.4, equalization, bone palette, comparison on the 4x2 study."""
    source = [0.0, 64.0, 128.0, 255.0, 10.0, 80.0, 160.0, 240.0]
    packed = spark.createDataFrame([(1, 4, 2, source, 127.5, 255.0, False)], "image_id long, width int, height int, pixels array<double>, window_center double, window_width double, invert boolean")
    shown = images.render(images.with_range(packed))
    assert shown.first().gray == [0, 64, 129, 255, 10, 80, 161, 241]
    done = images.equalize_packed(shown.withColumn("gray", F.transform("gray", lambda g: px.point_ops(g, False, 10, 1.4)))).withColumn("gray", F.col("equalized"))
    assert done.first().gray == [0, 43, 128, 255, 0, 85, 170, 255]
    toned = images.palette(done, "bone")
    assert [tuple(p)[:3] for p in toned.first().rgba] == [
        (0, 0, 0), (37, 39, 43), (112, 120, 128), (255, 255, 255), (0, 0, 0), (74, 79, 85), (190, 200, 191), (255, 255, 255),
    ]


def test_compare_gives_an_error_row_for_other_sizes(spark):
    schema = "image_id long, width long, height int, x long, y int, r int"
    left = spark.createDataFrame([(1, 2, 1, 0, 0, 10), (1, 2, 1, 1, 0, 20), (2, 1, 1, 0, 0, 1), (3, 1, 1, 0, 0, 1), (4, 2**31, 1, 0, 0, 1)], schema)
    right = spark.createDataFrame([(1, 2, 1, 0, 0, 30), (1, 2, 1, 1, 0, 40), (2, 2, 1, 0, 0, 1), (4, 2**31, 1, 0, 0, 1)], schema)
    rows = images.compare(left, right).collect()
    assert sorted((r.image_id, r.width, r.x, r.r) for r in rows if not r.error) == [(1, 4, 0, 10), (1, 4, 1, 20), (1, 4, 2, 30), (1, 4, 3, 40)]
    mismatch = "compare preview requires matching image dimensions"
    assert {r.image_id: (r.error, r.r) for r in rows if r.error} == {2: (mismatch, None), 3: (mismatch, None), 4: ("compare preview width overflow", None)}


def test_packed_images_that_do_not_fit_have_no_comparison(spark):
    rows = [(1, 2, 1, [1, 2], [3, 4]), (2, 2, 1, [1, 2], [3]), (3, 2, 1, None, [3, 4])]
    out = images.compare_packed(spark.createDataFrame(rows, "image_id int, width int, height int, a array<int>, b array<int>"), "a", "b")
    assert {r.image_id: r.both for r in out.collect()} == {1: [1, 2, 3, 4], 2: None, 3: None}


@pytest.mark.parametrize("mode", ["default", "full", "manual"])
def test_kernels_equal_the_expressions(spark, mode):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        values = (rng.normal(100, 90, rng.integers(1, 60)) * rng.choice([1, 1, 40])).round(rng.integers(0, 3)).tolist()
        values = [abs(x) for x in values] if i % 3 else values
        low, high = (min(values), max(values)) if i % 7 else (5.0, 5.0)
        rows.append((i, values, low, high, *[(None, None), (90.0, 120.0), (90.0, 1.0), (float("nan"), 50.0)][i % 4], bool(i % 5 == 0)))
    rows += [(60, [], 0.0, 0.0, None, None, False), (61, None, 0.0, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "image_id int, pixels array<double>, min_value double, max_value double, window_center double, window_width double, invert boolean")
    center, width = (F.lit(80.0), F.lit(150.0)) if mode == "manual" else (F.when(~F.isnan("window_center"), F.col("window_center")), F.col("window_width"))
    want = df.withColumn("gray", F.transform("pixels", lambda v: px.render(v, F.col("min_value"), F.col("max_value"), mode, center, width, F.coalesce("invert", F.lit(False)))))
    got = images.render(df, mode, *((80.0, 150.0) if mode == "manual" else ()))
    assert {r.image_id: r.gray for r in got.collect()} == {r.image_id: r.gray for r in want.collect()}


def test_equalization_equals_the_long_form(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, rng.integers(1, 257), rng.integers(1, 400)).tolist()) for i in range(40)] + [(40, [7] * 9), (41, [])]
    packed = spark.createDataFrame(rows, "image_id int, gray array<int>")
    long = packed.select("image_id", F.posexplode("gray").alias("pos", "g"))
    want = {}
    for r in images.equalize_long(long).orderBy("image_id", "pos").collect():
        want.setdefault(r.image_id, []).append(r.equalized)
    assert {r.image_id: r.equalized for r in images.equalize_packed(packed).collect()} == want | {41: []}


def test_point_tables_equal_the_expressions(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("g"))
    for invert, brightness, contrast in [(False, 0, 1.0), (True, 30, 1.0), (False, -40, 1.37), (True, 10, 0.5), (False, 0, 2.5), (False, 256, 0.0)]:
        want = [r[0] for r in df.orderBy("g").select(px.point_ops(F.col("g"), invert, brightness, contrast)).collect()]
        assert px.point_table(invert, brightness, contrast) == want


REQUEST = "id long, preset_id string, invert boolean, brightness int, contrast double, equalize boolean, compare boolean, palette string"


def test_requests(spark):
    rows = [
        (1, "xray", True, 24, 2.25, False, True, "hot"), (2, "missing", False, None, None, False, False, None),
        (3, "default", False, 999, None, False, False, None), (4, "default", False, None, None, False, False, "magma"),
        (5, "default", False, None, float("nan"), False, False, None),
    ]
    got = {r.id: r for r in requests.resolve(spark.createDataFrame(rows, REQUEST)).collect()}
    assert tuple(got[1])[2:] == (None, True, 24, 2.25, True, True, "hot")
    assert all(got[i].error.startswith("invalidInput") and got[i].palette is None for i in (2, 3, 4, 5))


def test_mode_label(spark):
    label = lambda *x: one(spark, tx.mode_label(*map(F.lit, x)))
    assert label(False, 10, 1.4, True, "bone", True) == (
        "comparison of grayscale and grayscale with brightness +10 with contrast 1.4 with histogram equalization with bone palette"
    )
    assert label(True, 20, 2.0, False, "none", False) == "inverted grayscale with brightness +20 with contrast 2"


@pytest.mark.parametrize("raw, bits, signed, want", [(0xFFF, 12, True, -1), (0x1FFF, 12, False, 4095), (2**31, 32, False, -(2**31)), (200, 8, True, -56), (200, 0, False, 200)])
def test_stored_values(spark, raw, bits, signed, want):
    import numpy as np

    from rayloom.sources.dicom import stored_values

    assert one(spark, px.stored_value(F.lit(raw), bits, signed)) == want
    assert stored_values(np.array([raw], np.uint32), bits, signed).tolist() == [want]


def test_null_pixels_stay_null_and_count_nowhere(spark):
    """Also where a whole image is null, empty or holds nulls alone."""
    values = [[10, None, 20, 40], None, [], [None, None], [7, 7]]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "image_id int, pixels array<int>")
    shown = images.render(images.with_range(df.withColumn("width", F.lit(1))), "full").orderBy("image_id")
    assert [r.gray for r in shown.collect()] == [[0, None, 85, 255], None, [], [None, None], [0, 0]]
    table = F.col("pixels").alias("gray")
    assert [r.equalized for r in images.equalize_packed(df.select("image_id", table)).orderBy("image_id").collect()] == [[0, None, 128, 255], None, [], [None, None], [7, 7]]
    assert [r.out for r in df.select("image_id", kernels.through(F.col("pixels"), list(range(255, -1, -1))).alias("out")).orderBy("image_id").collect()][0] == [245, None, 235, 215]
