"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive lines is hashed to 128 bits. Windows that occur
more than once anywhere are repeated; the occurrence with the smallest
(document, position) stays and all others are later ones. A line is removed if
any later occurrence covers it; the covered positions of overlapping windows are
merged per document. Each removed line keeps an equal copy at an earlier place.

Counting windows is a partially aggregated ``groupBy``; occurrences find the
first one again by a join whose repeated side has one row per window, so a
window that a third of all documents share is split and never gathered.

Defined results for odd input: lines end at ``\\n`` and are compared without
spaces around them; windows of three blank lines do not count; texts of fewer
than three lines have no window and stay as they are; a null text stays null with
0 lines; documents order by id, null last, then by text hash; rows with the same
id and text are one document and are treated alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

WINDOW = 3
_LAST = 9_223_372_036_854_775_807


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """(d, t, pos, h1, h2) for each window of each document (d, t, text) that is not blank."""
    hashed = docs.select(
        "d",
        "t",
        F.transform(_lines("text"), lambda x: F.xxhash64(F.trim(x))).alias("one"),
        F.transform(_lines("text"), lambda x: F.xxhash64(F.lit(7), F.trim(x))).alias("two"),
    ).filter(F.size("one") >= width)
    blank = F.xxhash64(F.lit(""))

    def window(i: Column) -> Column:
        near = [F.get("one", i + k) for k in range(width)]
        some = near[0] != blank
        for x in near[1:]:
            some = some | (x != blank)
        other = [F.get("two", i + k) for k in range(width)]
        return F.when(some, F.struct(i.alias("pos"), F.xxhash64(*near).alias("h1"), F.xxhash64(*other).alias("h2")))

    positions = F.sequence(F.lit(0), F.size("one") - width)
    return hashed.select("d", "t", F.explode(F.transform(positions, window)).alias("w")).filter("w is not null").select("d", "t", "w.*")


def dedup_lines(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clean_text, n_lines, n_removed) for every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t")
    )
    seen = _occurrences(own, width)
    first = seen.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.max(F.struct("d", "t", "pos")).alias("last"))
    repeated = materialise(first.filter("first <> last").select("h1", "h2", "first"), "line-windows")
    later = seen.join(repeated, ["h1", "h2"]).filter(F.struct("d", "t", "pos") != F.col("first"))
    starts = later.groupBy("d", "t").agg(F.collect_set("pos").alias("starts"))
    joined = own.join(starts, ["d", "t"], "left")
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    return (
        joined.withColumn("lines", _lines("text"))
        .withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
        .select(
            "doc_id",
            F.when(F.col("kept").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
            .alias("clean_text"),
            F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
            F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).alias("n_removed"),
        )
    )
