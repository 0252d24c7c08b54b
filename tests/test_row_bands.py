"""Bands of rows against whole images."""

import numpy as np
import pytest

from rayloom.functions.text import EXPLICIT_BE
from rayloom.operators import images
from rayloom.sources import row_bands, studies
from rayloom.sources.row_bands import Bands

from .test_sources import JPEG, bmp, build

RNG = np.random.default_rng(5)


@pytest.fixture
def folder(tmp_path):
    rows, columns = 37, 23
    wide = RNG.integers(0, 4000, (rows, columns)).astype("<u2")
    rgb = RNG.integers(0, 256, (rows, columns, 3)).astype(np.uint8)
    shape = dict(rows=rows, columns=columns)
    made = {
        "gray8": build(RNG.integers(3, 90, rows * columns).astype(np.uint8).tobytes(), spacing="0.2\\0.3", **shape),
        "gray16": build(wide.tobytes(), bits=16, stored=12, slope=2, intercept=-10, window=(1500, 900), photometric="MONOCHROME1", **shape),
        "signed": build((wide.astype(">i2") - 2000).tobytes(), bits=16, signed=1, syntax=EXPLICIT_BE, **shape),
        "rgb": build(rgb.tobytes(), samples=3, photometric="RGB", planar=0, **shape),
        "planar": build(rgb.transpose(2, 0, 1).tobytes(), samples=3, photometric="RGB", planar=1, **shape),
        "flat": build(bytes([7]) * (rows * columns), **shape),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.dcm").write_bytes(data)
    return str(tmp_path)


def joined(spark, rows, column):
    """{file name: all bands in order}"""
    held = {}
    for row in rows.orderBy("path", "first_row").collect():
        held.setdefault(row.path.rsplit("/", 1)[-1], []).append(np.frombuffer(row[column], np.uint8) if column == "gray" else np.array(row[column], np.float32))
    return {name: np.concatenate(parts).tolist() for name, parts in held.items()}


@pytest.mark.parametrize("band_bytes", [1, 400, 8 << 20])
def test_bands_equal_whole_images(spark, folder, band_bytes):
    cut = row_bands.bands(spark, folder, band_bytes=band_bytes)
    whole = studies.as_images(studies.read_pixels(spark, folder))
    name = lambda path: path.rsplit("/", 1)[-1]
    assert joined(spark, row_bands.decode(cut), "pixels") == {name(r.path): r.pixels for r in whole.collect()}
    ranged = row_bands.with_range(cut)
    # 37 rows of 23 or, in 16 bits, 46 or, in colours, 69 bytes
    assert ranged.rows.count() == {1: 37 * 6, 400: 2 * 3 + 2 * 5 + 2 * 8, 8 << 20: 6}[band_bytes]
    for mode, center, width in (("default", None, None), ("full", None, None), ("manual", 60.0, 80.0)):
        shown = images.equalize_packed(images.render(whole, mode, center, width))
        want = {name(r.path): (r.gray, r.equalized) for r in shown.select("path", "gray", "equalized").collect()}
        assert joined(spark, row_bands.render(ranged, mode, center, width), "gray") == {n: w[0] for n, w in want.items()}
        if mode != "full":
            assert joined(spark, row_bands.equalize(ranged, mode, center, width), "gray") == {n: w[1] for n, w in want.items()}


def test_bands_of_one_image_are_read_by_many_tasks(spark, folder):
    ranged = row_bands.with_range(row_bands.bands(spark, folder, glob="gray8.dcm", band_bytes=23, task_bytes=100))
    assert ranged.tasks >= 9 and ranged.rows.count() == 37
    per_task = [len(part) for part in row_bands.equalize(ranged).select("first_row").rdd.glom().collect()]
    assert sum(per_task) == 37 and max(per_task) <= 12


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(70):
        (tmp_path / f"{n}.dcm").write_bytes(build(RNG.integers(0, 200, 24).astype(np.uint8).tobytes(), rows=4, columns=6))
    cut = row_bands.bands(spark, str(tmp_path), band_bytes=12)
    assert cut.tasks == spark.sparkContext.defaultParallelism and cut.rows.count() == 140
    whole = studies.as_images(studies.read_pixels(spark, str(tmp_path)))
    want = {r.path.rsplit("/", 1)[-1]: r.equalized for r in images.equalize_packed(images.render(whole)).select("path", "equalized").collect()}
    shown = row_bands.equalize(row_bands.with_range(cut))
    assert shown.rdd.getNumPartitions() == cut.tasks and joined(spark, shown, "gray") == want
    # a task for each 128 MB of pixels or for each so many bands, whichever is more
    assert row_bands._tasks(spark, 60_000, 0, 128 << 20) == 59 and row_bands._tasks(spark, 30, 30 << 27, 128 << 20) == 30


def test_what_has_no_bands_and_empty_folders(spark, folder, tmp_path):
    odd = tmp_path / "odd"
    odd.mkdir()
    assert row_bands.decode(row_bands.bands(spark, str(odd))).collect() == []
    (odd / "frames.dcm").write_bytes(build(bytes(4), frames=2))
    (odd / "jpeg.dcm").write_bytes(build(syntax=JPEG, fragments=[b"xx"]))
    (odd / "short.dcm").write_bytes(build(bytes(4), rows=5, columns=5))
    (odd / "twelve.dcm").write_bytes(build(bytes(4), bits=12))
    (odd / "plain.bmp").write_bytes(bmp(np.zeros((4, 4, 3), np.uint8)))
    (odd / "good.dcm").write_bytes(build(bytes([5, 6])))
    cut = row_bands.bands(spark, str(odd), strict=False)
    errors = {r.path.rsplit("/", 1)[-1]: r.error for r in cut.rows.collect()}
    assert len(errors) == 6 and [n for n, e in errors.items() if e is None] == ["good.dcm"]
    for name, text in (("frames", "single frame"), ("jpeg", "encapsulated"), ("short", "needs 25"), ("twelve", "BitsAllocated")):
        assert text in errors[f"{name}.dcm"]
    assert joined(spark, row_bands.equalize(row_bands.with_range(cut)), "gray") == {"good.dcm": [0, 255]}
    with pytest.raises(Exception, match="single frame"):
        row_bands.decode(row_bands.bands(spark, str(odd), glob="frames.dcm")).collect()


def test_a_band_deep_in_a_file_of_over_three_gigabytes(spark, tmp_path):
    path = tmp_path / "large.dcm"
    head = build(None, rows=60_000, columns=54_000) + bytes.fromhex("e07f1000") + b"OB\0\0" + (60_000 * 54_000).to_bytes(4, "little")
    with path.open("wb") as out:
        out.write(head)
        out.truncate(len(head) + 60_000 * 54_000)
        out.seek(len(head) + 59_999 * 54_000)
        out.write(bytes([9]) * 54_000)
    cut = row_bands.bands(spark, str(path), band_bytes=54_000 * 100)
    assert cut.rows.count() == 600 and cut.tasks >= 24
    last: Bands = cut.where("first_row >= 59900")
    assert sum(sum(r.pixels) for r in row_bands.decode(last).collect()) == 9 * 54_000
