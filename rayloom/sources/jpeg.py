"""Baseline JPEG kernels on bytes, for use inside tasks.

Blocks are transformed, quantised and packed as NumPy arrays; Huffman codes are made
for each image from its own symbols. Decoding takes 8-bit sequential files with
Huffman codes: gray or three components, any sampling factors, restart intervals,
fill bytes. Progressive, lossless and arithmetic ones, 12 bits and four components are a
``ValueError``, as are files that are cut off.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

#: Fixed value: the quality of previews.
QUALITY = 92
#: Quantisation of brightness and of colour, row by row (ITU T.81, Annex K.1).
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of a block along its diagonals, whose direction alternates.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K, _N = np.mgrid[0:8, 0:8]
COSINES = np.where(_K == 0, np.sqrt(1 / 8), np.cos((2 * _N + 1) * _K * np.pi / 16) / 2)
LONGEST = 16


def _steps(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 200 - 2 * quality if quality >= 50 else 5000 // max(1, quality)
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) of a plane whose edges are repeated to whole blocks."""
    height, width = plane.shape
    padded = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
    return padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of at most 16 bits that give the fewest bits (package merge); no symbol gets ones alone."""
    single = sorted((n, (symbol,)) for symbol, n in {**counts, 256: 0}.items())
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(LONGEST):
        merged = sorted(single + packages)
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2])]
    lengths = Counter(symbol for _, symbols in packages[: len(single) - 1] for symbol in symbols)
    return {symbol: lengths[symbol] for symbol in counts}


def canonical(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code), codes rising with the length and in the order given."""
    made, code, before = [], 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda item: item[1]):
        code <<= length - before
        made.append((symbol, length, code))
        code, before = code + 1, length
    return made


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _symbols(zigzagged: np.ndarray, component: int, components: int) -> list[np.ndarray]:
    """(order, table, symbol, extra, extra bits) of a component's blocks; order is block by block, component by component."""
    size = lambda v: np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1])
    extra = lambda v, bits: np.where(v < 0, v + (1 << bits) - 1, v)
    place = (np.arange(len(zigzagged)) * components + component) * 66
    first = np.diff(zigzagged[:, 0], prepend=0)
    bits = size(first)
    colour = int(component > 0)
    parts = [(place, np.full(len(place), 2 * colour), bits, extra(first, bits), bits)]
    block, at = zigzagged[:, 1:].nonzero()
    value, at = zigzagged[:, 1:][block, at], at + 1
    before = np.where(np.diff(block, prepend=-1) == 0, np.concatenate([[0], at[:-1]]), 0) if len(at) else at
    run, bits = at - before - 1, size(value)
    parts.append((place[block] + at, np.full(len(at), 2 * colour + 1), (run % 16) << 4 | bits, extra(value, bits), bits))
    # a run of 16 zeros comes before the value; several keep to its place by a stable sort
    long = np.repeat(np.arange(len(at)), run // 16)
    zero = np.zeros(len(long), np.int64)
    parts.append((place[block[long]] + before[long] + 1 if len(long) else zero, zero + 2 * colour + 1, zero + 0xF0, zero, zero))
    ended = np.flatnonzero(zigzagged[:, 63] == 0)
    zero = np.zeros(len(ended), np.int64)
    parts.append((place[ended] + 65, zero + 2 * colour + 1, zero, zero, zero))
    return [np.concatenate(columns) for columns in zip(*parts)]


def encode(samples: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JPEG file of (height, width) gray or (height, width, 3 or 4) colour samples; opacity is left out."""
    height, width = samples.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise ValueError(f"a JPEG can't be {width}x{height}")
    wide = samples.astype(np.float64)
    if samples.ndim == 3:
        r, g, b = wide[:, :, 0], wide[:, :, 1], wide[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    else:
        planes = [wide]
    steps = [_steps(LUMINANCE, quality), _steps(CHROMINANCE, quality)][: len(planes)]
    streams = []
    for component, plane in enumerate(planes):
        levels = COSINES @ (_blocks(plane) - 128.0) @ COSINES.T
        own = steps[int(component > 0)]
        streams.append(_symbols(np.rint(levels.reshape(-1, 64) / own).astype(np.int64)[:, ZIGZAG], component, len(planes)))
    order, table, symbol, extra, bits = (np.concatenate(columns) for columns in zip(*streams))
    sort = np.argsort(order, kind="stable")
    table, symbol, extra, bits = table[sort], symbol[sort], extra[sort], bits[sort]
    codes = np.zeros((4, 256, 2), np.int64)
    head = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    head += [_segment(0xDB, bytes([number, *own[ZIGZAG].tolist()])) for number, own in enumerate(steps)]
    head.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, 0x11, int(c > 0)]) for c in range(len(planes)))))
    for number in range(2 * len(steps)):
        counts = np.bincount(symbol[table == number], minlength=1)
        made = canonical(code_lengths({int(s): int(counts[s]) for s in counts.nonzero()[0]}))
        for own, length, code in made:
            codes[number, own] = code, length
        of_length = Counter(length for _, length, _ in made)
        # tables 0 to 3: first and other values of brightness, then of colour
        head.append(_segment(0xC4, bytes([(number % 2) << 4 | number // 2, *(of_length[n] for n in range(1, 17)), *(own for own, _, _ in made)])))
    head.append(_segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 * int(c > 0)]) for c in range(len(planes))) + b"\0\x3f\0"))
    value, length = codes[table, symbol, 0] << bits | extra, codes[table, symbol, 1] + bits
    ends = np.cumsum(length)
    which = np.repeat(np.arange(len(length)), length)
    stream = (value[which] >> (ends[which] - 1 - np.arange(ends[-1]))) & 1
    packed = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.int64)]).astype(np.uint8)).tobytes()
    return b"".join(head) + packed.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _lookup(body: bytes) -> list[int]:
    """length << 8 | symbol for every 16 bits that may come; 0 where no code begins so."""
    table, code, at = [0] * 65536, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            span = 1 << (16 - length)
            if at >= len(body) or code * span + span > 65536:
                raise ValueError("invalid JPEG: bad Huffman table")
            table[code * span : code * span + span] = [length << 8 | body[at]] * span
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _scan(data: bytes, layout: list[tuple[int, list[int], list[int]]], units: int, at: int, levels: list[np.ndarray]) -> None:
    """Fills in the levels of ``units`` units from ``at``; ``layout`` has (component, its tables) for each block of a unit."""
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    held = (padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]).tolist()
    end, p = len(data) * 8, 0
    before, per_unit = [0] * len(levels), Counter(component for component, _, _ in layout)
    places: list[list[int]] = [[] for _ in levels]
    values: list[list[int]] = [[] for _ in levels]
    block = [at * per_unit[c] * 64 for c in range(len(levels))]
    for _ in range(units):
        for c, first, other in layout:
            k, base, into, got = 0, block[c], places[c], values[c]
            table = first
            while k < 64:
                found = table[(held[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
                if not found:
                    raise ValueError("invalid JPEG: unknown code")
                p += found >> 8
                size, run = found & 15, (found & 255) >> 4
                if k == 0:
                    run, size = 0, found & 255
                    if size > 11:
                        raise ValueError("invalid JPEG: bad difference")
                elif not size:
                    if run != 15:
                        break
                    k += 16
                    continue
                k += run
                value = 0
                if size:
                    value = ((held[p >> 3] >> (16 - (p & 7))) & 0xFFFF) >> (16 - size)
                    p += size
                    if value < 1 << (size - 1):
                        value -= (1 << size) - 1
                if p > end or k > 63:
                    raise ValueError("invalid JPEG: cut off" if p > end else "invalid JPEG: too many values in a block")
                if k == 0:
                    value += before[c]
                    before[c] = value
                    table = other
                into.append(base + k)
                got.append(value)
                k += 1
            block[c] += 64
            if p > end:
                raise ValueError("invalid JPEG: cut off")
    for c, own in enumerate(levels):
        own[places[c]] = values[c]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3) samples of a baseline JPEG file."""
    steps: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    frame, restart, adobe, at = None, 0, None, 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("invalid JPEG: cut off" if at + 4 > len(data) else "invalid JPEG: expected a marker")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if len(body) < length - 2:
            raise ValueError("invalid JPEG: cut off")
        at += 2 + length
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    own = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    steps[body[0] & 15], body = own, body[65 + 64 * bool(wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]], body = _lookup(body[1:n]), body[n:]
            elif marker in (0xC0, 0xC1):
                depth, height, width, count = struct.unpack_from(">BHHB", body)
                frame = (depth, height, width, [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(count)])
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError(f"unsupported JPEG: coding {marker - 0xC0}")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif marker == 0xDA:
                return _image(data, at, frame, [(body[1 + 2 * c], body[2 + 2 * c]) for c in range(body[0])], steps, tables, restart, adobe)
            elif marker == 0xD9:
                raise ValueError("invalid JPEG: no image")
        except (IndexError, KeyError, struct.error) as problem:
            raise ValueError(f"invalid JPEG: {problem}") from None


def _image(data: bytes, at: int, frame, chosen: list[tuple[int, int]], steps: dict, tables: dict, restart: int, adobe: int | None) -> np.ndarray:
    if frame is None:
        raise ValueError("invalid JPEG: image before its frame")
    depth, height, width, components = frame
    if depth != 8 or len(components) not in (1, 3) or not height or not width:
        raise ValueError(f"unsupported JPEG: {len(components)} components of {depth} bits, {width}x{height}")
    if [c[0] for c in components] != [c[0] for c in chosen]:
        raise ValueError("unsupported JPEG: components in several scans")
    if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in components):
        raise ValueError("invalid JPEG: bad sampling factors")
    if len(components) == 1:  # the factors of a sole component mean nothing
        components = [(components[0][0], 1, 1, components[0][3])]
    most_h, most_v = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    layout = [(c, tables[tables_of >> 4], tables[0x10 | tables_of & 15]) for c, ((_, h, v, _), (_, tables_of)) in enumerate(zip(components, chosen)) for _ in range(h * v)]
    levels = [np.zeros(across * down * h * v * 64, np.int64) for _, h, v, _ in components]
    total = across * down
    if (len(data) - at) * 8 < 2 * total * len(layout):  # a block takes two bits at the least
        raise ValueError("invalid JPEG: cut off")
    for start in range(0, total, restart or total):
        stop = at
        while (stop := data.find(b"\xff", stop)) >= 0 and data[stop + 1 : stop + 2] in (b"\0", b"\xff"):
            stop += 1 + (data[stop + 1] == 0)
        stop = len(data) if stop < 0 else stop
        _scan(data[at:stop].rstrip(b"\xff").replace(b"\xff\0", b"\xff"), layout, min(restart or total, total - start), start, levels)
        at = stop + 2
    planes = []
    for own, (_, h, v, number) in zip(levels, components):
        blocks = np.empty((len(own) // 64, 64))
        blocks[:, ZIGZAG] = own.reshape(-1, 64) * steps[number]
        values = np.clip(np.rint(COSINES.T @ blocks.reshape(-1, 8, 8) @ COSINES + 128), 0, 255)
        plane = values.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        rows, columns = np.arange(height) * v // most_v, np.arange(width) * h // most_h
        planes.append(plane[rows[:, None], columns])
    if len(planes) == 1 or adobe == 0:
        return np.stack(planes, axis=2).astype(np.uint8)
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
