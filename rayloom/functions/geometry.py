"""Measurement and viewer geometry as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZOOM_RANGE = (1.0, 12.0)


def one_decimal(v: Column) -> Column:
    return F.round(v * 10.0) / 10.0


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def pixel_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return one_decimal(length(x2 - x1, y2 - y1))


def calibrated_length(x1: Column, y1: Column, x2: Column, y2: Column, row_mm: Column, col_mm: Column) -> Column:
    """Millimetres; null without a scale."""
    return one_decimal(length((x2 - x1) * col_mm, (y2 - y1) * row_mm))


def measurement_label(pixels: Column, millimetres: Column) -> Column:
    """The main label; both lengths already have one decimal."""
    shown = lambda v, unit: F.concat(F.format_string("%.1f", v), F.lit(f" {unit}"))
    return F.when(pixels.isNull(), "Pending").when(millimetres.isNotNull(), shown(millimetres, "mm")).otherwise(shown(pixels, "px"))


def secondary_label(pixels: Column, millimetres: Column) -> Column:
    return F.when(pixels.isNotNull() & millimetres.isNotNull(), F.concat(F.format_string("%.1f", pixels), F.lit(" px")))


def label_offset(scale: Column) -> Column:
    return F.lit(10.0) / F.greatest(scale, F.lit(1.0))


def clamp_zoom(zoom: Column) -> Column:
    return F.least(F.lit(ZOOM_RANGE[1]), F.greatest(F.lit(ZOOM_RANGE[0]), zoom))


def viewport(frame_w: Column, frame_h: Column, image_w: Column, image_h: Column, zoom: Column, pan_x: Column, pan_y: Column) -> dict[str, Column]:
    """scale, offset_x and offset_y of an image fitted into a frame, zoomed and panned."""
    scale = F.least(frame_w / image_w, frame_h / image_h) * clamp_zoom(zoom)
    return {
        "scale": scale,
        "offset_x": (frame_w - image_w * scale) / 2.0 + pan_x,
        "offset_y": (frame_h - image_h * scale) / 2.0 + pan_y,
    }


def to_screen(v: Column, offset: Column, scale: Column) -> Column:
    return offset + v * scale


def to_image(v: Column, offset: Column, scale: Column) -> Column:
    return (v - offset) / scale


def clamp_to(v: Column, limit: Column) -> Column:
    return F.least(limit, F.greatest(F.lit(0.0), v))


def zoom_at(
    frame: tuple[Column, Column], image: tuple[Column, Column], zoom: Column, pan: tuple[Column, Column], pointer: tuple[Column, Column], factor: Column
) -> dict[str, Column]:
    """zoom, pan_x and pan_y after zooming by ``factor`` with the point under the pointer kept in place."""
    before = viewport(*frame, *image, zoom, *pan)
    next_zoom = clamp_zoom(zoom * factor)
    after = viewport(*frame, *image, next_zoom, *pan)
    out = {"zoom": next_zoom}
    for axis, p, at in (("x", pan[0], pointer[0]), ("y", pan[1], pointer[1])):
        anchor = to_image(at, before[f"offset_{axis}"], before["scale"])
        out[f"pan_{axis}"] = p + (at - to_screen(anchor, after[f"offset_{axis}"], after["scale"]))
    return out


def is_drawn(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a drafted line is long enough to stay."""
    return length(x2 - x1, y2 - y1) >= 2.0


def hover(v: Column, other: Column, limit: Column, other_limit: Column) -> Column:
    """The rounded coordinate under the pointer, null outside the image."""
    inside = (v >= 0) & (v <= limit) & (other >= 0) & (other <= other_limit)
    return F.when(inside, F.floor(v + 0.5).cast("int"))


def clamp_control(v: Column, low: float, high: float) -> Column:
    """A form value within its limits; null for NaN."""
    return F.when(~F.isnan(v), F.least(F.lit(high), F.greatest(F.lit(low), v)))
