"""Image operators on two forms of an image table.

*packed*: ``image_id, width, height, pixels array<...>`` - one row per image; per
pixel work needs no shuffle. Rendering and equalization run as Arrow kernels over
a batch's pixels, simple point functions as a ``transform`` over the array.
*long*: ``image_id, pos, v`` - one row per pixel; used for histograms of sources
that come as rows. An image is one partition key there, so the largest image
bounds a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.functions import kernels
from rayloom.functions import pixels as px


#: Fixed value: twice the width must stay a 32-bit number.
MOST_WIDTH = (2**32 - 1) // 2


def explode_pixels(packed: DataFrame) -> DataFrame:
    """The long form, with x and y."""
    long = packed.select("image_id", "width", F.posexplode("pixels").alias("pos", "v"))
    return long.select("image_id", "pos", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), "v")


def with_range(packed: DataFrame) -> DataFrame:
    """Adds min_value and max_value; 0 and 0 for an image without pixels."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    return packed.withColumns({"min_value": F.coalesce(low, F.lit(0)).cast("double"), "max_value": F.coalesce(high, F.lit(0)).cast("double")})


def minmax(long: DataFrame) -> DataFrame:
    return long.groupBy("image_id").agg(F.min("v").cast("double").alias("min_value"), F.max("v").cast("double").alias("max_value"))


def map_pixels(packed: DataFrame, function: Callable[[Column], Column], name: str = "pixels") -> DataFrame:
    return packed.withColumn(name, F.transform("pixels", function))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def render(packed: DataFrame, mode: str = "default", center: float | None = None, width: float | None = None) -> DataFrame:
    """``gray``: 8-bit values of every pixel.

    ``packed`` has min_value and max_value; in default mode it may have
    window_center, window_width and invert.
    """
    has = set(packed.columns)
    own = mode == "default" and "window_center" in has
    number = lambda x: F.lit(x).cast("double")
    shown = kernels.render(
        F.col("pixels"), F.col("min_value"), F.col("max_value"), F.col("window_center") if own else number(center),
        F.col("window_width") if own else number(width), F.col("invert") if "invert" in has else F.lit(False), mode,
    )
    return packed.withColumn("gray", shown)


def histogram(gray: DataFrame) -> DataFrame:
    """(image_id, g, n) of the long form: partial counts before the only shuffle."""
    return gray.groupBy("image_id", "g").agg(F.count("*").alias("n"))


def cumulative_histogram(counts: DataFrame) -> DataFrame:
    """Adds cdf, cdf_min (the first bin's count) and total to a histogram.

    The shuffle moves at most 256 rows per image, whatever its size.
    """
    image = Window.partitionBy("image_id")
    upto = image.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns(
        {"cdf": F.sum("n").over(upto), "cdf_min": F.first("n").over(upto), "total": F.sum("n").over(image)}
    )


def equalize_long(gray: DataFrame) -> DataFrame:
    """Adds ``equalized`` to (image_id, ..., g), one row per pixel.

    Histogram tables are joined back to the pixels, so a large image is read by
    many tasks; each side is at most 256 rows per image.
    """
    table = cumulative_histogram(histogram(gray)).select(
        F.col("image_id").alias("table_id"), F.col("g").alias("table_g"), px.equalized(F.col("g"), F.col("cdf"), F.col("cdf_min"), F.col("total")).alias("equalized")
    )
    matched = gray["image_id"].eqNullSafe(table["table_id"]) & (gray["g"] == table["table_g"])
    return gray.join(table, matched).drop("table_id", "table_g")


def equalize_packed(packed: DataFrame, column: str = "gray") -> DataFrame:
    """The same on the packed form, inside each row: no shuffle. Linear in the pixels."""
    return packed.withColumn("equalized", kernels.equalize(F.col(column)))


def palette(packed: DataFrame, name: str, column: str = "gray") -> DataFrame:
    """``rgba``: array of struct(r, g, b, a). The name ``none`` is an error here, as it is for a caller that skips it."""
    function = {"hot": px.hot, "bone": px.bone, "gray": px.gray_rgba}.get(name)
    if function is None:
        raise ValueError(f"unknown palette: {name}")
    return packed.withColumn("rgba", F.transform(column, function))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two pixel sets (image_id, x, y, width, height, r, g, b, a) side by side: a union, the right one moved by the width.

    Images whose sizes differ, that are on one side only, or whose width would
    overflow have one row with ``error`` and no pixels instead.
    """
    sides = [df.select("image_id", "width", "height").distinct().withColumnsRenamed({"width": f"{n}_w", "height": f"{n}_h"}) for df, n in ((left, "l"), (right, "r"))]
    sizes = sides[0].join(sides[1], "image_id", "full")
    same = (F.col("l_w") == F.col("r_w")) & (F.col("l_h") == F.col("r_h"))
    error = F.when(~F.coalesce(same, F.lit(False)), "compare preview requires matching image dimensions").when(F.col("l_w") > MOST_WIDTH, "compare preview width overflow")
    judged = sizes.select(F.col("image_id"), error.alias("error"))
    moved = right.withColumn("x", F.col("x") + F.col("width"))
    both = left.unionByName(moved).join(judged.filter("error is null"), "image_id").withColumn("width", F.col("width") * 2)
    return both.unionByName(judged.filter("error is not null"), allowMissingColumns=True)


def compare_packed(packed: DataFrame, left: str, right: str, out: str = "both") -> DataFrame:
    """The same for two arrays of one row: each row of pixels from the left, then the right. No shuffle, no union.

    Null where an array does not have width * height values.
    """
    row = lambda c, y: F.slice(c, y * F.col("width") + 1, F.col("width"))
    rows = F.sequence(F.lit(0), F.col("height") - 1)
    joined = lambda a, b: F.flatten(F.transform(rows, lambda y: F.concat(row(a, y), row(b, y))))
    bound = let(F.col(left), lambda a: let(F.col(right), lambda b: joined(a, b)))
    pixels = F.col("width").cast("long") * F.col("height")
    fits = (F.size(left) == pixels) & (F.size(right) == pixels) & (pixels > 0)
    return packed.withColumn(out, F.when(fits, bound)).withColumn("width", F.col("width") * 2)
