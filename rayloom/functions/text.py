"""Labels, names and DICOM text as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transfer syntaxes without compression, in the corpus summary's sense.
IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
UNCOMPRESSED = ("", IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE, DEFLATED_LE)
#: Extensions of images read without DICOM, and the commands by name.
STANDALONE_EXTENSIONS = ("bmp", "tif", "tiff")
COMMANDS = (
    "get_processing_manifest", "open_study", "start_render_job", "start_process_job", "get_job", "get_jobs", "cancel_job", "measure_line_annotation",
)
#: HTTP status by error code.
ERROR_STATUS = {"invalidInput": 400, "notFound": 404, "conflict": 409, "cancelled": 409, "cacheCorrupted": 500, "internal": 500}
#: What is shown for job kinds, states and presets.
JOB_TITLES = {"renderStudy": "Render Preview", "processStudy": "Process Study"}
STATE_LABELS = {
    "queued": "Queued", "running": "Running", "cancelling": "Cancelling", "completed": "Completed", "failed": "Failed", "cancelled": "Cancelled",
}
PRESET_LABELS = {"default": "Neutral", "xray": "Bone Focus", "high-contrast": "High Contrast"}


def mapped(value: Column, table: dict, otherwise: Column | None = None) -> Column:
    """``value`` through a small constant table."""
    items = iter(table.items())
    key, shown = next(items)
    out = F.when(value == key, shown)
    for key, shown in items:
        out = out.when(value == key, shown)
    return out.otherwise(otherwise) if otherwise is not None else out


def dicom_trim(text: Column) -> Column:
    """Without the spaces and NULs at the end."""
    return F.regexp_replace(text, r"[ \x00]+$", "")


def dicom_parts(text: Column) -> Column:
    """Components between backslashes, trimmed; none for a blank text."""
    clean = dicom_trim(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(clean, r"\\"), F.trim))


def dicom_first(text: Column) -> Column:
    return F.trim(F.get(F.split(dicom_trim(text), r"\\"), F.lit(0)))


def decimal_string(text: Column) -> Column:
    """The first component as a double, null if it is none."""
    return dicom_first(text).try_cast("double")


def integer_string(text: Column, bits: int = 32) -> Column:
    """The first component as an unsigned integer of so many bits, null if it is none."""
    first = dicom_first(text)
    value = F.when(first.rlike(r"^[0-9]{1,18}$"), first.try_cast("long"))
    return F.when(value < 2**bits, value)


def spacing_pair(text: Column) -> Column:
    """struct(row, col) of the first two components, null if either is no number."""
    parts = F.split(dicom_trim(text), r"\\")
    row, col = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    return F.when(row.isNotNull() & col.isNotNull(), F.struct(row.alias("row"), col.alias("col")))


def measurement_scale(pixel: Column, imager: Column, nominal: Column) -> Column:
    """struct(row, col, source) of the first spacing whose parts are both positive."""

    def use(pair: Column, source: str) -> Column:
        good = (pair["row"] > 0) & (pair["col"] > 0)
        return F.when(good, F.struct(pair["row"].alias("row"), pair["col"].alias("col"), F.lit(source).alias("source")))

    return F.coalesce(use(pixel, "PixelSpacing"), use(imager, "ImagerPixelSpacing"), use(nominal, "NominalScannedPixelSpacing"))


def syntax_class(uid: Column) -> Column:
    """How a dataset of this transfer syntax is read."""
    return (
        F.when(uid == IMPLICIT_LE, "implicit little endian")
        .when(uid == EXPLICIT_BE, "explicit big endian")
        .when(uid == DEFLATED_LE, "error: deflated")
        .when(F.coalesce(uid, F.lit("")) == "", "error: empty")
        .otherwise("explicit little endian")
    )


def is_uncompressed(uid: Column) -> Column:
    return F.coalesce(uid, F.lit("")).isin(*UNCOMPRESSED)


def is_standalone_image(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(path, r"\.([^./\\]*)$", 1))).isin(*STANDALONE_EXTENSIONS)


def tag_text(group: Column, element: Column) -> Column:
    return F.format_string("(%04x,%04x)", group.cast("int"), element.cast("int"))


def tag_pack(group: Column, element: Column) -> Column:
    return group.cast("long") * 65536 + element.cast("long")


def number_text(value: Column) -> Column:
    """A double as text, without a trailing ``.0``."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def mode_label(invert: Column, brightness: Column, contrast: Column, equalize: Column, palette: Column, compare: Column) -> Column:
    """What a processed image shows, in the order of the steps."""
    text = F.concat(
        F.when(invert, "inverted grayscale").otherwise("grayscale"),
        F.when(brightness != 0, F.concat(F.lit(" with brightness "), F.format_string("%+d", brightness.cast("int")))).otherwise(""),
        F.when(contrast != 1.0, F.concat(F.lit(" with contrast "), number_text(contrast))).otherwise(""),
        F.when(equalize, " with histogram equalization").otherwise(""),
        F.when(palette != "none", F.concat(F.lit(" with "), palette, F.lit(" palette"))).otherwise(""),
    )
    return F.when(compare, F.concat(F.lit("comparison of grayscale and "), text)).otherwise(text)


def preset_label(preset: Column) -> Column:
    """Known copy, or the words of the id with capital first letters."""
    words = F.filter(F.split(preset, "-"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    return mapped(preset, PRESET_LABELS, title)


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def output_name(path: Column) -> Column:
    name = F.when(file_name(path) == "", "study.dcm").otherwise(file_name(path))
    return F.concat(F.regexp_replace(name, r"(?i)\.(dcm|dicom)$", ""), F.lit("_processed.dcm"))


def with_dicom_extension(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.(dcm|dicom)$"), path).otherwise(F.concat(path, F.lit(".dcm")))


def preview_format(pixel_format: Column) -> Column:
    """File format by pixel format: jpeg for gray8, png for rgba8, else null."""
    return mapped(pixel_format, {"gray8": "jpeg", "rgba8": "png"})


def artifact_path(root: Column, namespace: Column, key: Column, extension: Column) -> Column:
    return F.concat_ws("/", root, F.lit("artifacts"), namespace, F.concat_ws(".", key, extension))


def element_text(vr: Column, values: Column) -> Column:
    """Values joined by backslashes, padded to even length in bytes: NUL for UI, space for all other VRs."""
    joined = F.array_join(values, "\\")
    pad = F.when(F.upper(vr) == "UI", "\u0000").otherwise(" ")
    return F.when(F.octet_length(joined) % 2 == 1, F.concat(joined, pad)).otherwise(joined)


def error_status(code: Column) -> Column:
    return mapped(code, ERROR_STATUS, F.lit(500))


def is_recoverable(code: Column) -> Column:
    return code != "internal"


def normalized_error(payload: Column, default: str = "Unexpected backend error.") -> Column:
    """struct(code, message) of an error given as JSON object or as plain text."""
    parsed = F.from_json(payload, "code string, message string")
    known = parsed["code"].isNotNull() & parsed["message"].isNotNull()
    plain = F.when(parsed["message"].isNotNull(), parsed["message"]).when(~F.coalesce(payload, F.lit("")).rlike(r"^\s*([{\[]|$)"), payload)
    return F.struct(
        F.when(known, parsed["code"]).otherwise("internal").alias("code"),
        F.when(known, parsed["message"]).otherwise(F.coalesce(plain, F.lit(default))).alias("message"),
    )


def is_supported_command(name: Column) -> Column:
    return name.isin(*COMMANDS)


def is_plain_preview(preview: Column, output: Column, preset: Column, invert: Column, brightness: Column, contrast: Column, equalize: Column, compare: Column, palette: Column) -> Column:
    """Whether a request asks for a preview and for nothing that needs processing."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    off = lambda c: ~F.coalesce(c, F.lit(False))
    untouched = off(invert) & brightness.isNull() & contrast.isNull() & off(equalize) & off(compare) & blank(palette)
    return ~blank(preview) & blank(output) & (F.lower(F.coalesce(preset, F.lit(""))) == "default") & untouched
