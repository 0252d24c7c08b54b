"""JPEG against round trips and against the JVM's own codec."""

import struct

import numpy as np
import pytest

from rayloom import api
from rayloom.operators import images
from rayloom.sources import file_sink, jpeg, raster, studies, writers

from .test_sources import JPEG, build

RNG = np.random.default_rng(11)


def smooth(height, width, channels=None):
    """Waves and a few edges."""
    y, x = np.mgrid[0:height, 0:width]
    waves = [128 + 60 * np.sin(x / (9 + c) + c) + 50 * np.cos(y / (13 - c)) for c in range(channels or 1)]
    made = np.clip(np.stack(waves, axis=2), 0, 255).astype(np.uint8)
    made[height // 3 : height // 2, width // 4 : width // 2] = 230
    return made if channels else made[:, :, 0]


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (7, 19), (64, 40), (33, 17, 3), (5, 70, 4)])
def test_round_trips_are_close(shape):
    samples = smooth(shape[0], shape[1], *shape[2:])
    back = jpeg.decode(jpeg.encode(samples))
    want = samples[:, :, None] if samples.ndim == 2 else samples[:, :, :3]
    assert back.shape == want.shape
    off = np.abs(back.astype(int) - want)
    assert off.mean() <= 3 and off.max() <= 40
    assert raster.decode(jpeg.encode(samples)).kind == ("gray" if samples.ndim == 2 else "rgb")


@pytest.mark.parametrize("samples", [RNG.integers(0, 256, (50, 61)).astype(np.uint8), np.full((20, 20), 255, np.uint8), np.zeros((9, 9, 3), np.uint8), RNG.integers(0, 256, (24, 24, 3)).astype(np.uint8)])
def test_noise_and_flat_images_at_the_best_quality(samples):
    back = jpeg.decode(jpeg.encode(samples, 100)).reshape(samples.shape)
    assert np.abs(back.astype(int) - samples).max() <= 3


def test_code_lengths_are_whole_and_bounded():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for counts in ({3: 1}, {0: 5, 1: 5}, dict(enumerate(fibonacci)), {s: int(n) for s, n in enumerate(RNG.integers(1, 1000, 256))}):
        lengths = jpeg.code_lengths(counts)
        assert set(lengths) == set(counts) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1  # room for the code of ones
        codes = jpeg.canonical(lengths)
        assert all(code < (1 << length) - 1 for _, length, code in codes)


@pytest.fixture
def image_io(spark):
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    return jvm


def java_decode(jvm, data):
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    raster_ = image.getRaster()
    bands = raster_.getNumBands()
    flat = np.array(list(raster_.getPixels(0, 0, image.getWidth(), image.getHeight(), int_array(jvm, image.getWidth() * image.getHeight() * bands))))
    return flat.reshape(image.getHeight(), image.getWidth(), bands)


def int_array(jvm, n):
    return jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Integer.TYPE, n)


def java_encode(jvm, samples):
    gray = samples.ndim == 2
    kind = jvm.java.awt.image.BufferedImage(samples.shape[1], samples.shape[0], 10 if gray else 1)
    for y in range(samples.shape[0]):
        for x in range(samples.shape[1]):
            if gray:
                kind.getRaster().setSample(x, y, 0, int(samples[y, x]))
            else:
                r, g, b = map(int, samples[y, x])
                kind.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(kind, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("shape", [(21, 30), (19, 37, 3)])
def test_another_codec_reads_and_writes_the_same(image_io, shape):
    samples = smooth(shape[0], shape[1], *shape[2:])
    own = jpeg.encode(samples)
    assert np.abs(java_decode(image_io, own).astype(int) - jpeg.decode(own)).max() <= 2
    # with halved colours, which it may smooth where this repeats them
    theirs = java_encode(image_io, samples)
    off = np.abs(java_decode(image_io, theirs).astype(int) - jpeg.decode(theirs))
    assert off.mean() <= 2 and (len(shape) == 3 or off.max() <= 2)


def restarted(samples):
    """A gray file whose scan starts anew after each block, made from one-block files of one set of tables."""
    flat = jpeg.encode(np.full((8, 8), samples[0], np.uint8))
    head, scan = flat[: flat.index(b"\xff\xda")], flat[flat.index(b"\xff\xda") :][10:-2]
    size = head.index(b"\xff\xc0") + 5
    head = head[:size] + struct.pack(">HH", 8, 8 * len(samples)) + head[size + 4 :]
    body = b"".join(scan + (b"\xff" + bytes([0xD0 + n % 8]) if n < len(samples) - 1 else b"") for n in range(len(samples)))
    return head + b"\xff\xdd\0\4\0\1" + flat[flat.index(b"\xff\xda") :][:10] + body + b"\xff\xd9"


def test_restart_intervals():
    assert jpeg.decode(restarted([77] * 11)).tolist() == np.full((8, 88, 1), jpeg.decode(jpeg.encode(np.full((8, 8), 77, np.uint8)))[0, 0, 0]).tolist()


def test_odd_files_are_errors():
    good = jpeg.encode(smooth(40, 40))
    start = good.index(b"\xff\xda")
    for data in (b"\xff\xd8", good[:30], good[: start + 4], good[: start + 30], b"\xff\xd8\xff\xd9\0\2", good[:start].replace(b"\xff\xc0", b"\xff\xc2") + good[start:], good[:2] + good[start:], b"\xff\xd8abcdef"):
        with pytest.raises(ValueError, match="JPEG"):
            jpeg.decode(data)
    for _ in range(200):  # any damage is an error or an image, never another exception
        broken = bytearray(good)
        for at in RNG.integers(2, len(good), 3):
            broken[at] = RNG.integers(0, 256)
        try:
            jpeg.decode(bytes(broken[: 4 * len(good)]))
        except ValueError:
            pass


def test_fragments_and_previews_as_dataframes(spark, tmp_path):
    samples = smooth(30, 44)
    packed = jpeg.encode(samples)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dcm").write_bytes(build(syntax=JPEG, rows=30, columns=44, fragments=[packed[:100], packed[100:] + b"\0" * (len(packed) % 2)], photometric="MONOCHROME1", window=(100, 90)))
    (tmp_path / "in" / "b.dcm").write_bytes(build(syntax=JPEG, rows=30, columns=44, fragments=[jpeg.encode(smooth(30, 44, 3))]))
    decoded = studies.as_images(studies.read_pixels(spark, str(tmp_path / "in")))
    gray, colour = decoded.orderBy("path").collect()
    assert np.abs(np.array(gray.pixels).reshape(30, 44) - samples).mean() <= 2 and gray.invert and gray.window_center == 100
    assert (colour.width, colour.height, colour.window_center, colour.invert) == (44, 30, None, False)
    shown = writers.encode_jpeg(images.render(decoded))
    assert file_sink.save(shown.selectExpr("replace(element_at(split(path, '/'), -1), '.dcm', '') stem", "path key", "jpg"), str(tmp_path / "out")) == {"jpg": 2}
    rendered = images.render(decoded).orderBy("path").first().gray
    back = raster.decode((tmp_path / "out" / "a.jpg").read_bytes())
    assert np.abs(back.samples[:, :, 0].astype(int).ravel() - np.array(rendered)).mean() <= 3
    assert api.previews(images.palette(images.render(decoded), "hot"), str(tmp_path / "hot")) == 2
    assert raster.decode((tmp_path / "hot" / "a_processed.jpg").read_bytes()).kind == "rgb"
    odd = spark.createDataFrame([(2, 2, [1, 2, 3]), (0, 0, [])], "width int, height int, gray array<int>")
    assert [r.jpg for r in writers.encode_jpeg(odd).collect()] == [None, None]
