"""Processing requests: presets, resolution, differences, fingerprints.

A request has preset_id, invert, brightness, contrast, equalize, compare and
palette; the scalars may be null, which means "as the preset says".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.functions import pixels as px
from rayloom.functions import text as tx

#: Fixed values: (ordinal, id, brightness, contrast, invert, equalize, palette).
PRESETS = (
    (0, "default", 0, 1.0, False, False, "none"),
    (1, "xray", 10, 1.4, False, True, "bone"),
    (2, "high-contrast", 0, 1.8, False, True, "none"),
)
DEFAULT_PRESET = "default"
PRESET_SCHEMA = "p_ord int, p_id string, p_brightness int, p_contrast double, p_invert boolean, p_equalize boolean, p_palette string"


def presets(spark: SparkSession) -> DataFrame:
    """The processing manifest: three fixed rows."""
    return spark.createDataFrame(list(PRESETS), PRESET_SCHEMA)


def manifest_use(requests: DataFrame) -> DataFrame:
    """The manifest with the number of requests for each preset (``asked``), and of those with a brightness of their own.

    Requests are counted by preset first; the three rows meet counts, not requests.
    """
    used = requests.groupBy(preset_key(F.col("preset_id")).alias("used")).agg(F.count("*").alias("asked"), F.count("brightness").alias("own_brightness"))
    known = used.join(F.broadcast(presets(requests.sparkSession).select("p_id")), F.col("used") == F.col("p_id"), "left_semi")
    named = presets(requests.sparkSession).join(known, F.col("p_id") == F.col("used"), "left")
    return named.select(
        F.col("p_id").alias("preset"), F.col("p_brightness").alias("brightness"), F.col("p_contrast").alias("contrast"), tx.preset_label(F.col("p_id")).alias("label"),
        F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("own_brightness", F.lit(0)).alias("own_brightness"),
    )


def preset_key(preset_id: Column) -> Column:
    return F.lower(F.trim(preset_id))


def with_preset(requests: DataFrame) -> DataFrame:
    """Adds the preset's columns, null where the id is unknown. The three rows are broadcast."""
    return requests.join(F.broadcast(presets(requests.sparkSession)), preset_key(F.col("preset_id")) == F.col("p_id"), "left")


def unknown_presets(requests: DataFrame) -> DataFrame:
    return requests.join(F.broadcast(presets(requests.sparkSession)), preset_key(F.col("preset_id")) == F.col("p_id"), "left_anti")


def resolve(requests: DataFrame) -> DataFrame:
    """The controls that a request stands for, or ``error`` for one that is invalid.

    Numbers override the preset where they are given; booleans can only be
    switched on.
    """
    palette = F.when(F.col("palette").isNull(), F.col("p_palette")).otherwise(px.palette_name(F.col("palette")))
    brightness, contrast = F.coalesce("brightness", "p_brightness"), F.coalesce("contrast", "p_contrast")
    finite = ~F.isnan(contrast) & (contrast >= 0) & (contrast < float("inf"))
    error = (
        F.when(F.col("p_id").isNull(), F.concat(F.lit("invalidInput: preset must be one of "), F.lit(", ".join(p[1] for p in PRESETS))))
        .when(~brightness.between(-256, 256), "invalidInput: brightness must be between -256 and 256")
        .when(~finite, "invalidInput: contrast must be a finite number >= 0")
        .when(palette.isNull(), "invalidInput: palette must be one of none, hot, bone")
    )
    on = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    joined = with_preset(requests)
    values = {
        "invert": on("invert", "p_invert"), "brightness": brightness, "contrast": contrast, "equalize": on("equalize", "p_equalize"),
        "compare": F.coalesce("compare", F.lit(False)), "palette": palette,
    }
    out = joined.withColumns({"error": error} | {f"r_{n}": F.when(error.isNull(), v) for n, v in values.items()})
    kept = [c for c in requests.columns if c not in values]
    return out.select(*kept, "error", *[F.col(f"r_{n}").alias(n) for n in values])


def request_diff(requests: DataFrame) -> DataFrame:
    """What a form must send: values that differ from the preset's, else null; booleans only if the preset lacks them."""
    joined = with_preset(requests)
    changed = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"p_{c}")), F.col(c)).alias(c)
    added = lambda c: (F.col(c) & ~F.col(f"p_{c}")).alias(c)
    own = {"invert", "brightness", "contrast", "equalize", "palette"}
    return joined.select(
        *[c for c in requests.columns if c not in own], added("invert"), changed("brightness"), changed("contrast"), added("equalize"), changed("palette")
    )


def match_preset(controls: DataFrame, key: str) -> DataFrame:
    """(key, preset_label) of the first preset that the controls equal, contrast within 0.05; else ``Custom``.

    The theta join runs against three broadcast rows, folded into one projection
    by a CASE over the constant table, so controls are never multiplied.
    """
    label = F.lit("Custom")
    for _, preset, brightness, contrast, invert, equalize, palette in reversed(PRESETS):
        same = (
            (F.col("brightness") == brightness)
            & (F.abs(F.col("contrast") - contrast) < 0.05)
            & (F.col("invert") == invert)
            & (F.col("equalize") == equalize)
            & (F.col("palette") == palette)
        )
        label = F.when(same, tx.PRESET_LABELS[preset]).otherwise(label)
    return controls.select(key, label.alias("preset_label"))


#: Characters that JSON strings of the contract escape as \\u00xx, beside quote, backslash, \\n, \\r and \\t.
_ESCAPED = [c for c in map(chr, range(32)) if c not in "\n\r\t"] + ["<", ">", "&", "\u2028", "\u2029"]


def json_value(value: Column, kind: str) -> Column:
    """JSON of a string, integer, double or boolean, ``null`` for null."""
    if kind == "boolean" or kind == "integer":
        shown = value.cast("string")
    elif kind == "double":
        plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        shown = F.when(value == 0, "0").when(F.abs(value).between(1e-6, 1e15), plain).otherwise(F.lower(value.cast("string")))
    else:
        text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(raw), F.lit(mark))
        rare = text
        for c in _ESCAPED:
            rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
        shown = F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f<>&\\u2028\\u2029]"), rare).otherwise(text), F.lit('"'))
    return F.coalesce(shown, F.lit("null"))


def fingerprint(namespace: str, fields: dict[str, tuple[Column, str]]) -> Column:
    """SHA-256 of the fields (value, kind) as JSON in the given order, under a versioned namespace."""
    parts: list[Column] = [F.lit(f'{{"namespace":"{namespace}"')]
    for name, (value, kind) in fields.items():
        parts += [F.lit(f',"{name}":'), json_value(value, kind)]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def render_fingerprint(path: Column) -> Column:
    return fingerprint("render-study-v1", {"inputPath": (path, "string")})


def process_fingerprint(path: Column) -> Column:
    """Of the request as it came, before the preset is filled in; the output path is no part of it."""
    kinds = {"preset_id": "string", "invert": "boolean", "brightness": "integer", "contrast": "double", "equalize": "boolean", "compare": "boolean", "palette": "string"}
    named = {"presetId" if n == "preset_id" else n: (F.coalesce(n, F.lit(False)) if k == "boolean" else F.col(n), k) for n, k in kinds.items()}
    return fingerprint("process-study-v3", {"inputPath": (path, "string")} | named)


def with_study(commands: DataFrame, studies: DataFrame) -> DataFrame:
    """Commands with the columns of their study; ``error`` for an unknown ``study_id``."""
    known = studies.withColumn("_known", F.lit(True))
    missing = F.when(F.col("_known").isNull(), F.concat(F.lit("notFound: study not found: "), F.coalesce(F.col("study_id").cast("string"), F.lit(""))))
    return commands.join(known, "study_id", "left").withColumn("error", missing).drop("_known")


def distinct_ids(requested: DataFrame) -> DataFrame:
    """(batch, job_id, place): each id of a batch request once, at its first place; blank ids are left out."""
    return requested.filter("job_id is not null").groupBy("batch", "job_id").agg(F.min("place").alias("place"))
