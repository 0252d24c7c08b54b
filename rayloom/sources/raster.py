"""PNG, BMP and TIFF kernels on bytes, for use inside tasks; JPEG is in ``jpeg``.

``decode`` gives a :class:`Raster`: samples as height x width x channels (uint8 or
uint16). Only what study files need is read; anything else is a ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from rayloom.sources import jpeg


@dataclass
class Raster:
    samples: np.ndarray  # height, width, channels
    kind: str  # gray, gray16, rgb, rgba, rgba64

    @property
    def height(self) -> int:
        return self.samples.shape[0]

    @property
    def width(self) -> int:
        return self.samples.shape[1]


def decode(data: bytes) -> Raster:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return decode_tiff(data)
    if data[:2] == b"\xff\xd8":
        samples = jpeg.decode(data)
        return Raster(samples, "gray" if samples.shape[2] == 1 else "rgb")
    raise ValueError("unknown image format")


def config(data: bytes) -> tuple[int, int, str]:
    """(width, height, kind) of a BMP or TIFF file, from its header alone; ``data`` may give slices of a file."""
    if data[:2] == b"BM":
        head = data[0:54]
        width, height, _, bits = struct.unpack_from("<iiHH", head, 18)
        return width, abs(height), "rgba" if bits == 32 else "rgb"
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("unknown image format")
    tags = _tiff_tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, channels = one(258, 1), one(277, 1)
    kind = ("gray" if bits == 8 else "gray16") if channels == 1 else ("rgb" if channels == 3 else "rgba") if bits == 8 else "rgba64"
    return one(256, 0), one(257, 0), kind


# ---------------------------------------------------------------- PNG

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of (filter, bytes...) to plain rows."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int32)
    for y, row in enumerate(raw):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.concatenate([np.cumsum(line[i::step]) % 256 for i in range(step)])
            now = now.reshape(step, -1).T.ravel() if len(line) % step == 0 else _sequential(line, above, step, kind)
        elif kind == 2:
            now = (line + above) % 256
        elif kind in (3, 4):
            now = _sequential(line, above, step, kind)
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        out[y] = now
        above = now.astype(np.int32)
    return out


def _sequential(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """Filters whose bytes depend on the byte before."""
    now, up = line.tolist(), above.tolist()
    for i, value in enumerate(now):
        left = now[i - step] if i >= step else 0
        corner = up[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) // 2
        else:
            base = left + up[i] - corner
            near = sorted(((abs(base - left), 0, left), (abs(base - up[i]), 1, up[i]), (abs(base - corner), 2, corner)))
            guess = near[0][2]
        now[i] = (value + guess) & 255
    return np.array(now, np.int32)


def decode_png(data: bytes) -> Raster:
    width = height = depth = colour = 0
    table, packed = None, []
    for name, body in _chunks(data):
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if interlace or depth not in (8, 16) or colour not in _CHANNELS:
                raise ValueError("unsupported PNG: interlaced, or bits other than 8 and 16")
        elif name == b"PLTE":
            table = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
    channels, size = _CHANNELS[colour], depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    rows = _unfilter(raw.reshape(height, 1 + width * channels * size), channels * size)
    samples = np.ascontiguousarray(rows).view(">u2" if size == 2 else np.uint8).reshape(height, width, channels)
    if colour == 3:
        return Raster(table[samples[:, :, 0]], "rgb")
    if colour == 4:
        gray, alpha = samples[:, :, :1], samples[:, :, 1:]
        samples, colour = np.concatenate([gray, gray, gray, alpha], axis=2), 6
    kind = {0: "gray", 2: "rgb", 6: "rgba"}[colour]
    return Raster(samples.astype(np.uint16 if size == 2 else np.uint8), {"gray": "gray16", "rgb": "rgba64", "rgba": "rgba64"}[kind] if size == 2 else kind)


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A PNG of height x width (gray) or height x width x 3 or 4 samples."""
    height, width = samples.shape[:2]
    channels = 1 if samples.ndim == 2 else samples.shape[2]
    flat = np.ascontiguousarray(samples, dtype=np.uint8).reshape(height, width * channels)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), flat], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


# ---------------------------------------------------------------- BMP


def decode_bmp(data: bytes) -> Raster:
    start, = struct.unpack_from("<I", data, 10)
    header, width, signed_height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"unsupported BMP: {bits} bits, compression {packing}")
    height, pitch = abs(signed_height), (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, pitch * height, start).reshape(height, pitch)[:, : width * bits // 8].reshape(height, width, bits // 8)
    if signed_height > 0:
        rows = rows[::-1]
    if bits == 8:
        table = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
        return Raster(table[rows[:, :, 0]], "rgb")
    return Raster(rows[:, :, 2::-1], "rgb") if bits == 24 else Raster(rows[:, :, [2, 1, 0, 3]], "rgba")


# ---------------------------------------------------------------- TIFF

#: Bytes and format of TIFF field types.
_FIELD = {1: "B", 3: "H", 4: "I"}


def _tiff_tags(data: bytes) -> dict[int, tuple]:
    """The fields of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    number = lambda kind, at: struct.unpack(order + kind, data[at : at + struct.calcsize(kind)])[0]
    at = number("I", 4)
    tags: dict[int, tuple] = {}
    for entry in range(at + 2, at + 2 + 12 * number("H", at), 12):
        tag, kind, n = number("H", entry), number("H", entry + 2), number("I", entry + 4)
        if kind in _FIELD:
            size = struct.calcsize(_FIELD[kind]) * n
            where = entry + 8 if size <= 4 else number("I", entry + 8)
            tags[tag] = struct.unpack(f"{order}{n}{_FIELD[kind]}", data[where : where + size])
    return tags


def decode_tiff(data: bytes) -> Raster:
    """Strips, uncompressed, deflated or PackBits; gray or RGB(A), 8 or 16 bits."""
    order, tags = "<" if data[:2] == b"II" else ">", _tiff_tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, channels = one(256, 0), one(257, 0), one(258, 1), one(277, 1)
    packing, meaning, planar, predictor = one(259, 1), one(262, 1), one(284, 1), one(317, 1)
    if bits not in (8, 16) or channels not in (1, 3, 4) or planar != 1 or predictor not in (1, 2) or meaning not in (0, 1, 2):
        raise ValueError("unsupported TIFF layout")
    parts = []
    for offset, size in zip(tags.get(273, ()), tags.get(279, ())):
        strip = data[offset : offset + size]
        if packing in (8, 32946):
            strip = zlib.decompress(strip)
        elif packing == 32773:
            strip = _unpack_bits(strip)
        elif packing != 1:
            raise ValueError(f"unsupported TIFF compression {packing}")
        parts.append(strip)
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    need = width * height * channels
    samples = np.frombuffer(b"".join(parts), kind)
    if len(samples) < need:
        raise ValueError("TIFF strips are too short")
    samples = samples[:need].reshape(height, width, channels).astype(np.uint8 if bits == 8 else np.uint16)
    if predictor == 2:
        samples = np.cumsum(samples, axis=1, dtype=samples.dtype)
    if meaning == 0:
        samples = np.iinfo(samples.dtype).max - samples
    if channels == 1:
        return Raster(samples, "gray" if bits == 8 else "gray16")
    return Raster(samples, ("rgb" if channels == 3 else "rgba") if bits == 8 else "rgba64")


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def gray_values(raster: Raster) -> np.ndarray:
    """Float32 gray: gray samples as they are, colour as the luma of its high bytes."""
    if raster.kind in ("gray", "gray16"):
        return raster.samples[:, :, 0].astype(np.float32).ravel()
    high = raster.samples[:, :, :3] if raster.samples.dtype == np.uint8 else raster.samples[:, :, :3] >> 8
    if raster.samples.shape[2] == 4:  # colours count as they show on black
        top = 255 if raster.samples.dtype == np.uint8 else 65535
        wide = raster.samples.astype(np.uint64) * (257 if top == 255 else 1)
        high = (wide[:, :, :3] * wide[:, :, 3:] // 65535) >> 8
    return luma(high).ravel()


def luma(rgb: np.ndarray) -> np.ndarray:
    wide = rgb.astype(np.int64) * 257
    return ((wide @ np.array([19595, 38470, 7471]) + 32768) >> 24).astype(np.float32)
