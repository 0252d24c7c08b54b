"""Scalar pixel functions as Catalyst expressions.

Every function takes and returns Columns, so a whole rendering chain collapses
into one generated projection. Values are computed in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return F.lit(x).cast("double") if isinstance(x, (int, float)) else x.cast("double")


def clamp_to_byte(v: Column) -> Column:
    """Nearest integer in 0..255, halves up."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), _d(v))) + F.lit(0.5)).cast("int")


def stored_value(raw: Column, bits: Column | int, signed: Column | bool) -> Column:
    """The value of the low ``bits`` of a raw sample.

    0 or more than 32 bits mean 32. The result is a signed 32-bit number, so an
    unsigned 32-bit sample of 2**31 or more comes out negative.
    """
    bits = F.lit(bits) if isinstance(bits, int) else bits
    signed = F.lit(signed) if isinstance(signed, bool) else signed
    width = F.when((bits <= 0) | (bits > 32), 32).otherwise(bits)
    span = F.pow(F.lit(2.0), width).cast("long")
    low = F.pmod(raw.cast("long"), span)
    sign_set = (signed | (width == 32)) & (low >= F.floor(span / 2))
    return F.when(sign_set, low - span).otherwise(low)


def rescale(stored: Column, slope: Column | float = 1.0, intercept: Column | float = 0.0) -> Column:
    return _d(stored) * _d(slope) + _d(intercept)


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray of 8-bit colour through 16-bit channels and integer weights."""
    wide = [c.cast("long") * 257 for c in (r, g, b)]
    total = wide[0] * 19595 + wide[1] * 38470 + wide[2] * 7471 + 32768
    return F.shiftright(total, 24).cast("int")


def window_is_valid(width: Column) -> Column:
    return F.coalesce(width > 1.0, F.lit(False))


def map_window(v: Column, center: Column | float, width: Column | float) -> Column:
    """8-bit value of ``v`` through a window of valid width."""
    v, c, w = _d(v), _d(center), _d(width)
    middle, half = c - 0.5, (w - 1.0) / 2.0
    scale = F.lit(255.0) / (w - 1.0)
    mapped = clamp_to_byte(v * scale + (F.lit(127.5) - middle * scale))
    return F.when(v <= middle - half, 0).when(v > middle + half, 255).otherwise(mapped)


def map_linear(v: Column, low: Column | float, high: Column | float) -> Column:
    """8-bit value of ``v`` on the range from ``low`` to ``high``; 0 on an empty range."""
    v, low, high = _d(v), _d(low), _d(high)
    return F.when(high <= low, 0).otherwise(clamp_to_byte((v - low) * (F.lit(255.0) / F.nullif(high - low, F.lit(0.0)))))


def render(
    v: Column,
    low: Column,
    high: Column,
    mode: str = "default",
    center: Column | float | None = None,
    width: Column | float | None = None,
    invert: Column | bool = False,
) -> Column:
    """Gray value of a source pixel.

    ``default`` uses the image's own window (``center``, ``width``, may be null),
    ``manual`` the given one, both only if it is valid, and ``full`` the range of
    the image. Images whose range lies in 0..65535 are rendered through a table
    of integers, so their values are rounded first.
    """
    v, low, high = _d(v), _d(low), _d(high)
    exact = F.when((low >= 0) & (high <= 65535), F.floor(v + 0.5).cast("double")).otherwise(v)
    shown = map_linear(exact, low, high)
    if mode != "full" and center is not None and width is not None:
        c, w = _d(center), _d(width)
        usable = c.isNotNull() & window_is_valid(w)
        shown = F.when(usable, map_window(exact, F.when(usable, c), F.when(usable, w))).otherwise(shown)
    if isinstance(invert, bool):
        return 255 - shown if invert else shown
    return F.when(invert, 255 - shown).otherwise(shown)


def inverted(g: Column) -> Column:
    return 255 - g


def brightened(g: Column, delta: int) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), g + F.lit(delta)))


def contrasted(g: Column, factor: float) -> Column:
    """Stretched around 128, halves away from zero."""
    stretched = F.round(F.lit(128.0) + F.lit(float(factor)) * (_d(g) - 128.0))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), stretched)).cast("int")


def point_table(invert: bool = False, brightness: int = 0, contrast: float = 1.0) -> list[int]:
    """``point_ops`` of 0 to 255."""

    def at(g: int) -> int:
        g = 255 - g if invert else g
        g = min(255, max(0, g + brightness))
        if contrast != 1.0:
            stretched = 128.0 + contrast * (g - 128.0)
            g = int(min(255.0, max(0.0, abs(stretched) // 1 + (abs(stretched) % 1 >= 0.5) if stretched >= 0 else 0.0)))
        return g

    return [at(g) for g in range(256)]


def point_ops(g: Column, invert: bool = False, brightness: int = 0, contrast: float = 1.0) -> Column:
    """Invert, then brightness, then contrast; steps that change nothing are not planned."""
    if invert:
        g = inverted(g)
    if brightness:
        g = brightened(g, brightness)
    return contrasted(g, contrast) if contrast != 1.0 else g


def equalized(g: Column, cdf: Column, cdf_min: Column, total: Column) -> Column:
    """Histogram-equalized value; images of one value stay as they are."""
    span = (total - cdf_min).cast("long")
    scaled = F.floor(((cdf - cdf_min) * 255 + F.floor(span / 2)) / F.nullif(span, F.lit(0).cast("long"))).cast("int")
    return F.when(span == 0, g).when(cdf <= cdf_min, 0).otherwise(scaled).cast("int")


def hot(g: Column) -> Column:
    """struct(r, g, b, a): black, red, yellow, white."""
    r = F.when(g <= 84, g * 3).otherwise(255)
    green = F.when(g <= 84, 0).when(g <= 169, (g - 85) * 3).otherwise(255)
    b = F.when(g <= 169, 0).otherwise((g - 170) * 3)
    return _rgba(r, green, b)


def bone(g: Column) -> Column:
    """struct(r, g, b, a): gray with a blue tint in the shadows and warm lights."""
    lift = F.greatest(g - 128, F.lit(0))
    top = lambda x: F.least(F.lit(255), x)
    part = lambda x, n: F.floor(x / n)
    red = part(g * 7, 8) + lift
    return _rgba(top(red), top(red + part(g, 16)), top(g + part(lift, 2)))


def gray_rgba(g: Column) -> Column:
    return _rgba(g, g, g)


def _rgba(r: Column, g: Column, b: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"), (F.lit(255), "a"))))


def palette_name(text: Column) -> Column:
    """Normalised palette name; null for an unknown one."""
    name = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(name == "", "none").when(name.isin("none", "hot", "bone"), name)
