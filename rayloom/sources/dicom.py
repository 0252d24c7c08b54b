"""DICOM kernels on bytes, for use inside tasks: header walk, pixels, encoding.

The walk keeps a cursor over the file's bytes and yields elements; what to keep is
the caller's choice, so a metadata scan ends at the pixel data.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np

from rayloom.functions.text import DEFLATED_LE, EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE
from rayloom.sources import raster

UNDEFINED = 0xFFFFFFFF
PIXELS, ITEM, ITEM_END, SEQUENCE_END = 0x7FE00010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
STUDY_UID, SLOPE, INTERCEPT = 0x0020000D, 0x00281053, 0x00281052
#: Representations with a 32-bit length.
LONG_VRS = frozenset(("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "UC", "UR", "UT", "UN"))
TEXT_VRS = frozenset(("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"))
#: Metadata fields by tag and how they are read.
FIELDS = {
    0x00280002: ("samples_per_pixel", "u16"), 0x00280004: ("photometric", "text"), 0x00280006: ("planar_configuration", "u16"),
    0x00280008: ("number_of_frames", "u32"), 0x00280010: ("rows", "u16"), 0x00280011: ("columns", "u16"),
    0x00280030: ("pixel_spacing", "pair"), 0x00280100: ("bits_allocated", "u16"), 0x00280101: ("bits_stored", "u16"),
    0x00280103: ("pixel_representation", "u16"), 0x00181164: ("imager_spacing", "pair"), 0x00182010: ("nominal_spacing", "pair"),
    0x00281050: ("window_center", "number"), 0x00281051: ("window_width", "number"),
}
#: Identifier and calibration tags that survive a round trip, in this order, with their default VR.
PRESERVED = {
    0x00100010: "PN", 0x00100020: "LO", 0x00100030: "DA", 0x00100040: "CS", 0x00200010: "SH", 0x00080020: "DA", 0x00080030: "TM",
    0x00080050: "SH", 0x00081030: "LO", 0x00080090: "PN", 0x00080080: "LO", 0x00280030: "DS", 0x00181164: "DS", 0x00182010: "DS",
    0x00280A04: "CS", 0x00280A02: "LO",
}


@dataclass
class Syntax:
    order: str  # of struct: < or >
    explicit: bool


def syntax_of(uid: str) -> Syntax:
    if uid == DEFLATED_LE:
        raise ValueError(f"unsupported deflated transfer syntax: {uid}")
    if not uid:
        raise ValueError("invalid DICOM metadata: empty transfer syntax UID")
    return Syntax(">" if uid == EXPLICIT_BE else "<", uid != IMPLICIT_LE)


class Cursor:
    """A place in a file's bytes, or in an object that gives slices of them."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise ValueError("unexpected end of DICOM data")
        self.at += n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("unexpected end of DICOM data")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, order: str, kind: str) -> int:
        return struct.unpack(order + kind, self.take(struct.calcsize(kind)))[0]

    def header(self, syntax: Syntax) -> tuple[int, str, int]:
        """(tag, representation, length); items have no representation."""
        tag = self.number(syntax.order, "H") << 16 | self.number(syntax.order, "H")
        if tag >> 16 == 0xFFFE or not syntax.explicit:
            return tag, "", self.number(syntax.order, "I")
        vr = self.take(2).decode("latin-1")
        if vr in LONG_VRS:
            self.take(2)
            return tag, vr, self.number(syntax.order, "I")
        return tag, vr, self.number(syntax.order, "H")

    def skip_undefined(self, syntax: Syntax) -> None:
        """Past a value of undefined length, which may hold others."""
        depth = 1
        while depth:
            tag, _, length = self.header(syntax)
            if tag in (ITEM_END, SEQUENCE_END):
                depth -= 1
                self.skip(length)
            elif length == UNDEFINED:
                depth += 1
            else:
                self.skip(length)


def text_of(value: bytes) -> str:
    return value.decode("latin-1").rstrip(" \0")


def first_of(value: bytes) -> str:
    return text_of(value).split("\\")[0].strip()


def _unsigned(text: str, bits: int) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and int(text) < 2**bits else None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _pair(text: str) -> tuple[float, float] | None:
    parts = [_number(p.strip()) for p in text.split("\\")[:2]]
    return (parts[0], parts[1]) if len(parts) == 2 and None not in parts else None


def value_of(kind: str, value: bytes, order: str):
    if kind == "u16":
        return struct.unpack(order + "H", value)[0] if len(value) == 2 else _unsigned(first_of(value), 16)
    if kind == "u32":
        return _unsigned(first_of(value), 32)
    if kind == "pair":
        return _pair(text_of(value))
    return _number(first_of(value)) if kind == "number" else text_of(value)


@dataclass
class Study:
    """What one file holds. ``pixels`` is None after a metadata scan."""

    meta: dict = field(default_factory=dict)
    transfer_syntax_uid: str = ""
    study_uid: str = ""
    slope: float = 1.0
    intercept: float = 0.0
    preserved: dict = field(default_factory=dict)
    width: int = 0
    height: int = 0
    pixels: np.ndarray | None = None
    window: tuple[float, float] | None = None
    invert: bool = False
    #: Where the value of the pixel data starts in the file, and its length.
    pixels_at: int = -1
    pixels_length: int = 0
    order: str = "<"

    def get(self, name: str, default=0):
        return self.meta.get(name, default)

    def defaults(self) -> None:
        self.meta["samples_per_pixel"] = self.get("samples_per_pixel") or 1
        self.meta["number_of_frames"] = self.get("number_of_frames") or 1
        self.meta["bits_stored"] = self.get("bits_stored") or self.get("bits_allocated")
        self.meta.setdefault("pixel_data_encoding", "missing")

    def scale(self) -> tuple[float, float, str] | None:
        """The first spacing whose parts are both positive."""
        for name, source in (("pixel_spacing", "PixelSpacing"), ("imager_spacing", "ImagerPixelSpacing"), ("nominal_spacing", "NominalScannedPixelSpacing")):
            pair = self.get(name, None)
            if pair and min(pair) > 0:
                return (*pair, source)
        return None

    def preserved_elements(self) -> list[tuple[int, str, list[str]]]:
        return [(t, *self.preserved[t]) for t in PRESERVED if t in self.preserved]


def transfer_syntax(cursor: Cursor) -> str:
    """The syntax a file declares; a file without the magic word is implicit little endian from its first byte."""
    if cursor.data[128:132] != b"DICM":
        return IMPLICIT_LE
    cursor.at, uid, meta = 132, "", Syntax("<", True)
    while cursor.at + 4 <= len(cursor.data) and cursor.data[cursor.at : cursor.at + 2] == b"\2\0":
        tag, _, length = cursor.header(meta)
        if length == UNDEFINED:
            raise ValueError("invalid DICOM file meta: undefined length")
        value = cursor.take(length)
        uid = text_of(value) if tag == 0x00020010 else uid
    if not uid:
        raise ValueError("invalid DICOM file meta: missing TransferSyntaxUID (0002,0010)")
    return uid


def elements(cursor: Cursor, syntax: Syntax, wanted: frozenset[int]) -> Iterator[tuple[int, str, int, bytes]]:
    """(tag, representation, length, value) of the wanted elements; the pixel data comes last, unread."""
    while cursor.at < len(cursor.data):
        tag, vr, length = cursor.header(syntax)
        if tag == PIXELS:
            yield tag, vr, length, b""
            return
        if length == UNDEFINED:
            cursor.skip_undefined(syntax)
        elif tag in wanted:
            yield tag, vr, length, cursor.take(length)
        else:
            cursor.skip(length)


_SCAN = frozenset(FIELDS)
_DECODE = _SCAN | {STUDY_UID, SLOPE, INTERCEPT} | frozenset(PRESERVED)


def read(data: bytes, with_pixels: bool = False, calibrated: bool = False) -> Study:
    """A study from the bytes of a DICOM file; ``calibrated`` takes slope, intercept and identifiers from a scan too."""
    cursor, study = Cursor(data), Study()
    study.transfer_syntax_uid = transfer_syntax(cursor)
    syntax = syntax_of(study.transfer_syntax_uid)
    for tag, vr, length, value in elements(cursor, syntax, _DECODE if with_pixels or calibrated else _SCAN):
        if tag == PIXELS:
            study.pixels_at, study.pixels_length, study.order = cursor.at, length, syntax.order
            study.meta["pixel_data_encoding"] = "encapsulated" if length == UNDEFINED else "native"
            if with_pixels:
                _check_size(study)
                study.defaults()
                _encapsulated(study, cursor, syntax) if length == UNDEFINED else decode_native(study, cursor.take(length), syntax.order)
            break
        if tag in FIELDS:
            name, kind = FIELDS[tag]
            parsed = value_of(kind, value, syntax.order)
            if parsed is not None or kind in ("pair", "number"):
                study.meta[name] = parsed
        if tag == STUDY_UID:
            study.study_uid = text_of(value).strip()
        elif tag in (SLOPE, INTERCEPT) and (parsed := _number(first_of(value))) is not None:
            setattr(study, "slope" if tag == SLOPE else "intercept", parsed)
        if tag in PRESERVED and with_pixels:
            text = text_of(value)
            study.preserved[tag] = ((vr or PRESERVED[tag]).strip().upper(), [p.strip() for p in text.split("\\")] if text else [])
    study.defaults()
    _check_size(study)
    if with_pixels and study.pixels is None:
        raise ValueError("missing PixelData (7fe0,0010)")
    return study


def _check_size(study: Study) -> None:
    for name, label in (("rows", "Rows"), ("columns", "Columns")):
        if not study.get(name):
            raise ValueError(f"missing required {label}")


def _window(study: Study) -> None:
    center, width = study.get("window_center", None), study.get("window_width", None)
    if center is not None and width is not None and width > 1:
        study.window = (center, width)
    study.invert = study.get("photometric", "").upper() == "MONOCHROME1"


def stored_values(samples: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    """The low ``bits`` of raw samples as 32-bit signed numbers."""
    bits = bits if 0 < bits <= 32 else 32
    low = samples.astype(np.int64) & ((1 << bits) - 1)
    if signed or bits == 32:
        low = np.where(low >> (bits - 1) & 1 == 1, low - (1 << bits), low)
    return low


def decode_native(study: Study, raw: bytes, order: str) -> None:
    """Fills in the pixels of ``study`` from its raw samples."""
    study.width, study.height = study.get("columns"), study.get("rows")
    count, colours, bits = study.width * study.height, study.get("samples_per_pixel"), study.get("bits_allocated")
    _window(study)
    if bits not in (8, 16, 32):
        raise ValueError(f"unsupported BitsAllocated for source decode: {bits}")
    if colours != 1 and bits != 8:
        raise ValueError(f"{bits}-bit color DICOM source decode is not supported yet")
    kind = np.dtype(f"{order}u{bits // 8}")
    if len(raw) < count * colours * kind.itemsize:
        raise ValueError(f"dicom frame has {len(raw)} bytes, needs {count * colours * kind.itemsize}")
    samples = np.frombuffer(raw, kind, count * colours)
    if colours == 1:
        stored = stored_values(samples, study.get("bits_stored"), study.get("pixel_representation") == 1)
        study.pixels = stored.astype(np.float32) * np.float32(study.slope) + np.float32(study.intercept)
        return
    photometric = study.get("photometric", "").strip().upper()
    if colours != 3 or photometric != "RGB":
        raise ValueError(f"unsupported color source decode: {colours} samples, {photometric}")
    if study.get("planar_configuration") not in (0, 1):
        raise ValueError(f"unsupported planar configuration: {study.get('planar_configuration')}")
    rgb = samples.reshape(count, 3) if study.get("planar_configuration") == 0 else samples.reshape(3, count).T
    study.pixels = raster.luma(rgb)


def _encapsulated(study: Study, cursor: Cursor, syntax: Syntax) -> None:
    if study.get("number_of_frames") > 1:
        raise ValueError(f"unsupported multi-frame encapsulated source decode: {study.get('number_of_frames')} frames")
    items: list[bytes] = []
    while True:
        tag, _, length = cursor.header(syntax)
        if tag == SEQUENCE_END and items:
            break
        if tag != ITEM or length == UNDEFINED:
            raise ValueError("invalid encapsulated pixel data: expected an item of known length")
        items.append(cursor.take(length))
    payload = b"".join(items[1:])  # the first item is the offset table
    if not payload:
        raise ValueError("encapsulated pixel data did not contain any frame bytes")
    image = raster.decode(payload)
    _window(study)
    if image.kind not in ("gray", "gray16"):
        study.window, study.invert = None, False
    study.width, study.height, study.pixels = image.width, image.height, raster.gray_values(image)


# ---------------------------------------------------------------- writing

SECONDARY_CAPTURE = "1.2.840.10008.5.1.4.1.1.7"
IMPLEMENTATION = ("2.25.302043790172249692526321623266752743501", "RAYLOOM_1")


def uid_from(seed: str | None = None) -> str:
    """``2.25.`` and the number of a version-4 UUID: random, or the same for the same seed."""
    raw = uuid.uuid4() if seed is None else uuid.UUID(bytes=hashlib.sha256(seed.encode()).digest()[:16], version=4)
    return f"2.25.{raw.int}"


def _even(value: bytes, pad: bytes) -> bytes:
    return value + pad if len(value) % 2 else value


def text_element(tag: int, vr: str, *values: str) -> tuple[int, str, bytes]:
    return tag, vr, _even("\\".join(values).encode("latin-1", "replace"), b"\0" if vr == "UI" else b" ")


def _u16(tag: int, value: int) -> tuple[int, str, bytes]:
    return tag, "US", struct.pack("<H", value)


def element_bytes(tag: int, vr: str, value: bytes) -> bytes:
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    if vr in LONG_VRS:
        return head + b"\0\0" + struct.pack("<I", len(value)) + value
    if len(value) > 0xFFFF:
        raise ValueError(f"element ({tag >> 16:04x},{tag & 0xFFFF:04x}) with VR {vr} exceeds 16-bit value length")
    return head + struct.pack("<H", len(value)) + value


def pixel_module(samples: np.ndarray) -> list[tuple[int, str, bytes]]:
    """Image elements of 8-bit gray (2-d) or RGBA (3-d) samples; alpha is dropped."""
    gray, size = samples.ndim == 2, samples.shape[:2]
    if max(size) > 0xFFFF:
        raise ValueError(f"secondary capture dimensions must fit DICOM Rows/Columns, got {size[1]}x{size[0]}")
    kept = samples if gray else samples[:, :, :3]
    out = [
        _u16(0x00280002, 1 if gray else 3), text_element(0x00280004, "CS", "MONOCHROME2" if gray else "RGB"),
        _u16(0x00280010, size[0]), _u16(0x00280011, size[1]), _u16(0x00280100, 8), _u16(0x00280101, 8), _u16(0x00280102, 7), _u16(0x00280103, 0),
        (PIXELS, "OB", _even(np.ascontiguousarray(kept, np.uint8).tobytes(), b"\0")),
    ]
    window = [text_element(0x00281050, "DS", "127.5"), text_element(0x00281051, "DS", "255")]
    return out + (window if gray else [_u16(0x00280006, 0)])


def secondary_capture(samples: np.ndarray, study_uid: str, preserved: list[tuple[int, str, list[str]]], now: datetime, uid=uid_from) -> bytes:
    """A DICOM Secondary Capture file. Preserved elements replace defaults, pixel elements replace both."""
    instance, day, time = uid(), now.strftime("%Y%m%d"), now.strftime("%H%M%S")
    texts = [
        (0x00080008, "CS", "DERIVED", "SECONDARY"), (0x00080012, "DA", day), (0x00080013, "TM", time), (0x00080016, "UI", SECONDARY_CAPTURE),
        (0x00080018, "UI", instance), (0x00080023, "DA", day), (0x00080033, "TM", time), (0x00080060, "CS", "OT"), (0x00080064, "CS", "WSD"),
        (0x00080070, "LO", "rayloom"), (0x0008103E, "LO", "Processed preview"), (0x00082111, "ST", "Processed preview for visualization"),
        (0x0020000D, "UI", study_uid.strip() or uid()), (0x0020000E, "UI", uid()), (0x00200011, "IS", "999"), (0x00200013, "IS", "1"),
    ]
    dataset = {t[0]: text_element(*t) for t in texts}
    for tag, vr, values in preserved:
        vr = vr.strip().upper()
        if tag >> 16 == 2:
            raise ValueError("preserved element cannot target file meta information")
        if vr not in TEXT_VRS:
            raise ValueError(f"unsupported preserved element VR {vr!r}")
        dataset[tag] = text_element(tag, vr, *values)
    dataset |= {e[0]: e for e in pixel_module(samples)}
    meta = b"".join(
        element_bytes(*e)
        for e in (
            (0x00020001, "OB", b"\0\1"), text_element(0x00020002, "UI", SECONDARY_CAPTURE), text_element(0x00020003, "UI", instance),
            text_element(0x00020010, "UI", EXPLICIT_LE), text_element(0x00020012, "UI", IMPLEMENTATION[0]), text_element(0x00020013, "SH", IMPLEMENTATION[1]),
        )
    )
    body = b"".join(element_bytes(*dataset[t]) for t in sorted(dataset))
    return bytes(128) + b"DICM" + element_bytes(0x00020000, "UL", struct.pack("<I", len(meta))) + meta + body
