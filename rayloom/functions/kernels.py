"""Pixel kernels on Arrow arrays: whole images as flat vectors, linear in their pixels.

They compute what the expressions of ``pixels`` say, for packed images. Inside a
row those are interpreted value by value over boxed numbers; here a batch's pixels
are one vector, and chained kernels run in one pass of a Python worker. Columns
they don't name never reach Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Images whose histograms are held at a time.
_IMAGES = 4096


def _mapped(lists: pa.Array, function) -> pa.Array:
    """``function(values, image of each value)`` in the shape of a list array, as integers.

    Null images stay null. Null values stay null too, and ``function`` doesn't see them.
    """
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, image = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
    if flat.null_count:
        held = flat.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(flat), np.int32)
        out[held] = function(flat.drop_null().to_numpy(zero_copy_only=False), image[held])
        values = pa.array(out, mask=~held)
    else:
        values = pa.array(function(flat.to_numpy(zero_copy_only=False), image).astype(np.int32))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _bytes(v: np.ndarray) -> np.ndarray:
    """Nearest integers in 0..255, halves up."""
    return np.floor(np.clip(v, 0.0, 255.0) + 0.5)


def render_values(v: np.ndarray, image: np.ndarray, low, high, center, width, invert, mode: str) -> np.ndarray:
    """Gray values of the pixels ``v``; the others hold one value for each image."""
    v = v.astype(np.float64)
    table = (low >= 0) & (high <= 65535)
    v = np.where(table[image], np.floor(v + 0.5), v) if table.any() else v
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(high > low, 255.0 / (high - low), 0.0)
        shown = np.where((high > low)[image], _bytes((v - low[image]) * scale[image]), 0.0)
        usable = np.isfinite(center) & (width > 1.0) if mode != "full" else np.zeros(len(low), bool)
        if usable.any():
            c, w = np.where(usable, center, 0.0), np.where(usable, width, 2.0)
            middle, half, step = c - 0.5, (w - 1.0) / 2.0, 255.0 / (w - 1.0)
            mapped = _bytes(v * step[image] + (127.5 - middle * step)[image])
            mapped = np.where(v <= (middle - half)[image], 0.0, np.where(v > (middle + half)[image], 255.0, mapped))
            shown = np.where(usable[image], mapped, shown)
    return np.where(invert[image], 255.0 - shown, shown)


def equalize_values(g: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """Each image's values through the table of its cumulative histogram."""
    out = np.empty(len(g), np.int64)
    for start in range(0, images, _IMAGES):
        n = min(_IMAGES, images - start)
        a, b = np.searchsorted(image, [start, start + n])
        own, at = g[a:b].astype(np.int64), image[a:b] - start
        counts = np.bincount(at * 256 + own, minlength=n * 256).reshape(n, 256)
        cdf = counts.cumsum(axis=1)
        first = np.take_along_axis(cdf, (counts > 0).argmax(axis=1)[:, None], axis=1)
        spread = cdf[:, -1:] - first
        table = np.where(cdf <= first, 0, ((cdf - first) * 255 + spread // 2) // np.maximum(spread, 1))
        table = np.where(spread == 0, np.arange(256), table)
        out[a:b] = table[at, own]
    return out


def render(pixels: Column, low: Column, high: Column, center: Column, width: Column, invert: Column, mode: str) -> Column:
    """Gray values (array of int) of packed pixels."""

    @F.arrow_udf("array<int>")
    def run(pixels: pa.Array, low: pa.Array, high: pa.Array, center: pa.Array, width: pa.Array, invert: pa.Array) -> pa.Array:
        number = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731  null is not a number
        inverted = invert.fill_null(False).to_numpy(zero_copy_only=False)
        per_image = [*map(number, (low, high, center, width)), inverted, mode]
        return _mapped(pixels, lambda values, image: render_values(values, image, *per_image))

    return run(pixels, low, high, center, width, invert)


def equalize(gray: Column) -> Column:
    """Equalized gray values (array of int) of packed 8-bit values."""

    @F.arrow_udf("array<int>")
    def run(gray: pa.Array) -> pa.Array:
        return _mapped(gray, lambda values, image: equalize_values(values, image, len(gray)))

    return run(gray)


def through(gray: Column, table: list[int]) -> Column:
    """Every value looked up in one table of 256."""

    @F.arrow_udf("array<int>")
    def run(gray: pa.Array) -> pa.Array:
        return _mapped(gray, lambda values, _: np.array(table)[values])

    return run(gray)
