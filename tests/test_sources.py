import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.errors import CommandError
from rayloom.functions.text import EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE
from rayloom.operators import corpus, images
from rayloom.sources import dicom, raster, studies, writers
from rayloom.sources.stores import RangedBytes

JPEG = "1.2.840.10008.1.2.4.50"


def build(
    pixels=b"\0\x64", rows=1, columns=2, bits=8, samples=1, photometric="MONOCHROME2", syntax=EXPLICIT_LE, part10=True, frames=None, planar=None, stored=None,
    signed=0, slope=None, intercept=None, window=None, spacing=None, imager=None, nominal=None, name=None, fragments=None, before=b"",
):
    order, explicit = (">" if syntax == EXPLICIT_BE else "<"), syntax != IMPLICIT_LE

    def element(tag, vr, value):
        value += (b"\0" if vr in ("UI", "OB", "OW") else b" ") * (len(value) % 2)
        head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
        if not explicit:
            return head + struct.pack(order + "I", len(value)) + value
        if vr in dicom.LONG_VRS:
            return head + vr.encode() + b"\0\0" + struct.pack(order + "I", len(value)) + value
        return head + vr.encode() + struct.pack(order + "H", len(value)) + value

    u16 = lambda n: struct.pack(order + "H", n)
    parts = {0x00280010: ("US", rows and u16(rows)), 0x00280011: ("US", columns and u16(columns)), 0x00280002: ("US", u16(samples)), 0x00280100: ("US", u16(bits)), 0x00280103: ("US", u16(signed))}
    texts = {
        0x00280004: ("CS", photometric), 0x00280008: ("IS", frames), 0x00281053: ("DS", slope), 0x00281052: ("DS", intercept), 0x00280030: ("DS", spacing),
        0x00181164: ("DS", imager), 0x00182010: ("DS", nominal), 0x00100010: ("PN", name), 0x00281050: ("DS", window and window[0]), 0x00281051: ("DS", window and window[1]),
    }
    parts |= {t: (vr, str(v).encode()) for t, (vr, v) in texts.items() if v is not None}
    parts |= {0x00280006: ("US", u16(planar))} if planar is not None else {}
    parts |= {0x00280101: ("US", u16(stored))} if stored else {}
    body = before + b"".join(element(t, *parts[t]) for t in sorted(parts) if parts[t][1])
    if fragments is not None:
        body += struct.pack(order + "HH", 0x7FE0, 0x10) + (b"OB\0\0" if explicit else b"") + struct.pack(order + "I", dicom.UNDEFINED)
        for item in [b"", *fragments]:
            body += struct.pack(order + "HHI", 0xFFFE, 0xE000, len(item)) + item
        body += struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0)
    elif pixels is not None:
        body += element(dicom.PIXELS, "OW" if bits > 8 else "OB", pixels)
    if not part10:
        return body
    uid = syntax.encode() + b"\0" * (len(syntax) % 2)
    return bytes(128) + b"DICM" + struct.pack("<HH", 2, 0x10) + b"UI" + struct.pack("<H", len(uid)) + uid + body


def test_monochrome1_with_everything():
    study = dicom.read(build(photometric="MONOCHROME1", slope=2, intercept=-10, window=(100, 200), spacing="0.25\\0.50", name="A^B"), True)
    assert study.pixels.tolist() == [-10, 190] and study.invert and study.window == (100.0, 200.0)
    assert study.scale() == (0.25, 0.5, "PixelSpacing")
    assert study.preserved_elements() == [(0x00100010, "PN", ["A^B"]), (0x00280030, "DS", ["0.25", "0.50"])]


def test_spacing_precedence_and_syntaxes():
    every = dict(spacing="0.2\\0.3", imager="0.4\\0.5", nominal="0.6\\0.7")
    assert dicom.read(build(**every)).scale() == (0.2, 0.3, "PixelSpacing")
    assert dicom.read(build(**(every | {"spacing": "0\\1"}))).scale() == (0.4, 0.5, "ImagerPixelSpacing")
    big = dicom.read(build(syntax=EXPLICIT_BE, rows=321, columns=654))
    assert (big.get("rows"), big.get("columns"), big.get("pixel_data_encoding")) == (321, 654, "native")
    raw = dicom.read(build(syntax=IMPLICIT_LE, part10=False, rows=128, columns=256))
    assert (raw.get("rows"), raw.get("columns"), raw.transfer_syntax_uid) == (128, 256, IMPLICIT_LE)
    packed = dicom.read(build(syntax=JPEG, samples=3, frames=2, fragments=[b"xx"]))
    assert packed.get("pixel_data_encoding") == "encapsulated" and packed.get("number_of_frames") == 2


def test_nested_undefined_lengths_are_skipped():
    item = struct.pack("<HHI", 0xFFFE, 0xE000, dicom.UNDEFINED) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    sequence = struct.pack("<HH", 8, 0x1140) + b"SQ\0\0" + struct.pack("<I", dicom.UNDEFINED) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert dicom.read(build(before=sequence)).get("columns") == 2


@pytest.mark.parametrize(
    "options, text",
    [
        ({"columns": 0}, "Columns"), ({"pixels": None}, "PixelData"), ({"pixels": b""}, "bytes"), ({"bits": 12}, "BitsAllocated"),
        ({"bits": 16, "samples": 3, "photometric": "RGB", "pixels": bytes(12)}, "16-bit color"), ({"samples": 3, "photometric": "YBR_FULL", "pixels": bytes(6)}, "YBR_FULL"),
        ({"samples": 3, "photometric": "RGB", "planar": 2, "pixels": bytes(6)}, "planar"), ({"fragments": [], "syntax": JPEG}, "frame bytes"),
        ({"fragments": [b"ab"], "frames": 2, "syntax": JPEG}, "multi-frame"), ({"fragments": [b"\xff\xd8"], "syntax": JPEG}, "JPEG"), ({"syntax": "1.2.840.10008.1.2.1.99"}, "deflated"),
    ],
)
def test_errors(options, text):
    with pytest.raises(ValueError, match=text):
        dicom.read(build(**options), True)


def test_depths_and_colour():
    assert dicom.read(build(struct.pack("<2H", 0x0FFF, 0x8001), bits=16, stored=12, signed=1), True).pixels.tolist() == [-1, 1]
    assert dicom.read(build(struct.pack(">2H", 258, 3), bits=16, syntax=EXPLICIT_BE), True).pixels.tolist() == [258, 3]
    assert dicom.read(build(struct.pack("<2I", 2**31, 7), bits=32), True).pixels.tolist() == [-(2**31), 7]
    mixed = dict(samples=3, photometric="RGB", columns=2, slope=5)
    a = dicom.read(build(bytes([255, 0, 0, 0, 255, 0]), planar=0, **mixed), True).pixels.tolist()
    b = dicom.read(build(bytes([255, 0, 0, 255, 0, 0]), planar=1, **mixed), True).pixels.tolist()
    assert a == b == [76, 150]


def test_png_round_trips_and_filters():
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (4, 6, 3), (2, 7, 4)):
        samples = rng.integers(0, 256, shape).astype(np.uint8)
        assert (raster.decode(raster.encode_png(samples)).samples.reshape(shape) == samples).all()
    rows = rng.integers(0, 256, (5, 8)).astype(np.int32)
    raw, above = b"", np.zeros(8, np.int32)
    for kind, row in enumerate(rows):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        guess = [0, left, above, (left + above) // 2, np.choose(d.argmin(0), [left, above, corner])][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (raster.decode(png).samples[:, :, 0] == rows).all()
    study = dicom.read(build(fragments=[png[:20], png[20:]], syntax=JPEG, rows=9, columns=9, slope=3), True)
    assert (study.width, study.height) == (8, 5) and study.pixels.tolist() == rows.ravel().tolist()


def tiff(samples, order="<", packing=1):
    height, width = samples.shape
    data = samples.astype(order + "u2").tobytes()
    data = zlib.compress(data) if packing == 8 else data
    tags = [(256, 3, width), (257, 3, height), (258, 3, 16), (259, 3, packing), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, height), (279, 4, len(data))]
    entry = lambda t, k, v: struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data))
    return head + data + struct.pack(order + "H", len(tags)) + b"".join(entry(*t) for t in tags) + bytes(4)


@pytest.mark.parametrize("order, packing", [("<", 1), (">", 1), ("<", 8)])
def test_tiff(order, packing):
    image = raster.decode(tiff(np.array([[0, 65535]]), order, packing))
    assert raster.gray_values(image).tolist() == [0, 65535]


def bmp(rgb):
    height, width, _ = rgb.shape
    pitch = (width * 3 + 3) // 4 * 4
    rows = b"".join(r[:, ::-1].tobytes().ljust(pitch, b"\0") for r in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_files_as_dataframes(spark, tmp_path):
    (tmp_path / "a.dcm").write_bytes(build(spacing="0.2\\0.3", name="A^B"))
    (tmp_path / "b.bmp").write_bytes(bmp(np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8)))
    (tmp_path / "c.dcm").write_bytes(b"nothing")
    (tmp_path / "d.png").write_bytes(raster.encode_png(np.zeros((1, 2), np.uint8)))
    meta = {r.path.rsplit("/", 1)[1]: r for r in studies.read_metadata(spark, str(tmp_path), strict=False).collect()}
    assert meta["a.dcm"].error is None and tuple(meta["a.dcm"].scale) == (0.2, 0.3, "PixelSpacing")
    assert meta["b.bmp"].samples_per_pixel == 3 and meta["b.bmp"].scale is None
    assert meta["c.dcm"].error and meta["d.png"].error
    with pytest.raises(Exception, match="c.dcm"):
        studies.read_metadata(spark, str(tmp_path / "c.dcm")).collect()
    pixels = studies.read_pixels(spark, str(tmp_path), strict=False).filter("error is null")
    assert {r.path[-5:]: list(r.pixels) for r in pixels.collect()} == {"a.dcm": [0, 100], "b.bmp": [76, 150]}


def test_corpus_summary(spark, tmp_path):
    (tmp_path / "a.dcm").write_bytes(build())
    (tmp_path / "b.dcm").write_bytes(build(bytes(6), samples=3, photometric="RGB"))
    row = corpus.summarize(studies.read_metadata(spark, str(tmp_path))).first()
    assert (row.study_count, row.color_count, row.encapsulated_count) == (2, 1, 0) and len(row.warnings) == 4
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "c.dcm").write_bytes(build(syntax=JPEG, frames=4, fragments=[b"xx"]))
    row = corpus.summarize(studies.read_metadata(spark, str(tmp_path / "x"))).first()
    assert (row.encapsulated_count, row.compressed_count, row.multi_frame_count) == (1, 1, 1)
    assert row.warnings == ["sample set contains one transfer syntax"]
    assert corpus.summarize(studies.read_metadata(spark, str(tmp_path / "x")).limit(0)).first().warnings == ["no studies inspected"]


def test_render_and_export_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dcm").write_bytes(build(bytes([0, 64, 128, 255]), rows=2, spacing="0.2\\0.3", name="A^B"))
    shown = images.render(studies.as_images(studies.read_pixels(spark, str(tmp_path / "in"))))
    when = datetime(2024, 5, 6, 7, 8, 9)
    out = writers.encode_secondary_capture(shown, "gray", when, "seed")
    first, again = out.first(), out.first()
    assert first.dicom == again.dicom and first.error is None
    back = dicom.read(bytes(first.dicom), True)
    assert back.pixels.tolist() == first.gray and first.gray == [0, 64, 128, 255] and back.window == (127.5, 255.0) and back.scale() == (0.2, 0.3, "PixelSpacing")
    assert back.preserved[0x00100010] == ("PN", ["A^B"]) and back.study_uid == first.study_uid
    toned = images.palette(shown, "bone")
    png = writers.encode_png(toned, writers.flat_values("rgba")).withColumn("file", F.lit("sub/a.png"))
    assert writers.save_files(png, "file", "png", str(tmp_path / "out")) == 1
    assert raster.decode((tmp_path / "out" / "sub" / "a.png").read_bytes()).samples.shape == (2, 2, 4)
    rgb = dicom.read(dicom.secondary_capture(np.zeros((1, 1, 4), np.uint8), "1.2", [], when), True)
    assert rgb.get("samples_per_pixel") == 3 and len(rgb.pixels) == 1


def test_export_errors():
    with pytest.raises(ValueError, match="file meta"):
        dicom.secondary_capture(np.zeros((1, 1), np.uint8), "1.2", [(0x00020010, "UI", ["1"])], datetime.now())
    with pytest.raises(ValueError, match="VR"):
        dicom.secondary_capture(np.zeros((1, 1), np.uint8), "1.2", [(0x00100010, "OB", ["1"])], datetime.now())
    with pytest.raises(ValueError, match="16-bit"):
        dicom.element_bytes(0x00100010, "LO", bytes(70_000))


def test_catalog_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("/in/a.dcm", "a.dcm", None, "2024-01-01T00:00:00Z")], "inputPath string, inputName string, measurementScale struct<rowSpacingMm:double,columnSpacingMm:double,source:string>, lastOpenedAt string")
    writers.write_catalog(rows.limit(0), str(tmp_path / "catalog.json"))
    writers.write_catalog(rows, f"file://{tmp_path}/catalog.json")
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["catalog.json"]
    studies_, corrupt = studies.read_catalog(spark, str(tmp_path / "catalog.json"))
    assert [r.inputName for r in studies_.collect()] == ["a.dcm"] and corrupt.collect() == []
    assert studies.load_catalog(spark, str(tmp_path / "catalog.json")).count() == 1


def test_catalogs_that_are_missing_null_or_corrupt(spark, tmp_path):
    path = tmp_path / "catalog.json"
    for side in studies.read_catalog(spark, str(path)):
        assert side.collect() == []
    assert studies.load_catalog(spark, str(path)).count() == 0
    path.write_text('{"recentStudies": null}')
    assert studies.load_catalog(spark, str(path)).count() == 0
    path.write_text("{not json")
    recent, corrupt = studies.read_catalog(spark, str(path))
    assert recent.collect() == [] and [r[0] for r in corrupt.collect()] == ["{not json"]
    with pytest.raises(CommandError) as caught:
        studies.load_catalog(spark, str(path))
    assert caught.value.code == "cacheCorrupted" and not path.exists() and (tmp_path / "catalog.corrupt.json").read_text() == "{not json"
    assert studies.load_catalog(spark, str(path)).count() == 0


def test_header_scans_do_not_read_pixels(spark, tmp_path):
    taken = {}
    for side in (10, 2000):
        path = tmp_path / f"{side}.dcm"
        path.write_bytes(build(bytes(side * side), rows=side, columns=side, spacing="0.2\\0.3", before=struct.pack("<HH", 8, 0x1140) + b"UN\0\0" + struct.pack("<I", side * side) + bytes(side * side)))
        data = RangedBytes(str(path), path.stat().st_size)
        assert studies.metadata_row(str(path), data)["columns"] == side
        taken[side] = data.taken
    assert taken[2000] <= 2 * (1 << 16) < 2000 * 2000
    bmp_path = tmp_path / "b.bmp"
    bmp_path.write_bytes(bmp(np.full((900, 900, 3), 200, np.uint8)))
    data = RangedBytes(str(bmp_path), bmp_path.stat().st_size)
    assert studies.metadata_row(str(bmp_path), data)["rows"] == 900 and data.taken <= 1 << 17
    ranged = studies.read_metadata(spark, str(tmp_path)).orderBy("path").collect()
    assert ranged == studies.read_metadata(spark, str(tmp_path), ranged=False).orderBy("path").collect() and len(ranged) == 3


def test_a_header_in_a_file_of_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.dcm"
    with path.open("wb") as out:
        out.write(build(b"\0\0", rows=40_000, columns=60_000))
        out.seek(2_400_000_000)
        out.write(b"\0")
    row = studies.read_metadata(spark, str(path)).first()
    assert (row.rows, row.columns, row.error) == (40_000, 60_000, None)


def test_saved_files_never_clash_and_go_when_the_write_fails(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("b/x.bin", b"2"), (None, b"3"), ("c.bin", None)], "name string, body binary")
    assert writers.save_files(rows, "name", "body", f"file://{out}") == 2
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["a/x.bin", "b/x.bin"]
    with pytest.raises(CommandError, match="2 outputs") as caught:
        writers.save_files(rows.union(rows), "name", "body", str(out))
    assert caught.value.code == "conflict"
    bad = spark.createDataFrame([("ok.bin", b"1"), ("a/x.bin/under-a-file", b"2")], "name string, body binary").coalesce(1)
    with pytest.raises(Exception):
        writers.save_files(bad, "name", "body", str(out))
    assert not (out / "ok.bin").exists() and not list(out.rglob("*.part"))
