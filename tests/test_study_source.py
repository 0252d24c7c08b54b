"""The study data source and the transactional file sink."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rayloom import api
from rayloom.errors import CommandError
from rayloom.operators import images
from rayloom.sources import file_sink, raster, studies, study_source, writers
from rayloom.sources.stores import RangedBytes
from rayloom.sources.study_source import dealt

from .test_sources import build


@pytest.fixture
def folder(tmp_path):
    for at, name in enumerate(("a/one.dcm", "a/two.dcm", "b/one.dcm", "b/x.txt")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(build(bytes([at, 64, 128, 255]), rows=2, spacing="0.2\\0.3") if name.endswith("dcm") else b"no study")
    (tmp_path / "in" / "a" / ".hidden.dcm").write_bytes(b"x")
    return str(tmp_path / "in")


def test_headers_and_pixels_equal_the_functions(spark, folder):
    plain = lambda df: sorted(((r.path.replace("file:", ""), tuple(r)[1:]) for r in df.collect()), key=str)
    headers = study_source.read(spark, folder, strict=False)
    assert plain(headers) == plain(studies.read_metadata(spark, folder, strict=False)) and headers.count() == 4
    pixels = study_source.read(spark, f"file://{folder}", pixels=True, glob="*.dcm")
    want = studies.read_pixels(spark, folder, glob="*.dcm")
    assert pixels.schema == want.schema and sorted(map(str, (tuple(r)[1:9] for r in pixels.collect()))) == sorted(map(str, (tuple(r)[1:9] for r in want.collect())))
    assert images.render(studies.as_images(pixels)).count() == 3
    narrow = spark.read.format("study").schema("path string, rows int").option("glob", "*.dcm").load(folder)
    assert {r.rows for r in narrow.collect()} == {2}


def test_errors_and_options(spark, folder, tmp_path):
    with pytest.raises(Exception, match="x.txt"):
        study_source.read(spark, folder).collect()
    with pytest.raises(Exception, match="does not exist"):
        study_source.read(spark, f"{folder}/nothing").collect()
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("study").schema("path string, nonsense int").load(folder).collect()
    (tmp_path / "none").mkdir()
    assert study_source.read(spark, str(tmp_path / "none")).count() == 0
    two = study_source.read(spark, [f"{folder}/a/one.dcm", f"{folder}/b"], strict=False, partitions=3)
    assert two.count() == 3 and two.rdd.getNumPartitions() == 3


def test_conditions_on_the_path_prune_before_files_are_opened(spark, folder):
    read = study_source.read(spark, folder)  # strict: x.txt would fail the query
    for condition, n in ((F.col("path") == f"{folder}/a/one.dcm", 1), (F.col("path").endswith("one.dcm"), 2), (F.col("path").startswith(f"{folder}/a/"), 2), (F.col("path").contains("/two"), 1), (F.col("path").isin(f"{folder}/a/two.dcm", f"{folder}/b/one.dcm"), 2)):
        assert read.filter(condition).count() == n
    assert study_source.read(spark, folder, strict=False).filter((F.col("rows") == 2) & F.col("path").endswith("dcm")).count() == 3


def test_partitions_are_balanced_on_ten_thousand_files_of_mixed_size():
    rng = random.Random(1)
    files = [(f"f{i}", rng.choice([2_000, 500_000, 30_000_000])) for i in range(10_000)] + [("large", 2 << 30)]
    parts = dealt(files, lambda s: s, 256 << 20, 5000)
    assert sorted(f for p in parts for f in p) == sorted(files)
    sums = sorted(sum(s for _, s in p) for p in parts)
    assert sums[-1] == 2 << 30 and sums[-2] <= 1.15 * sums[1]
    assert max(map(len, dealt(files, lambda s: 1, 1 << 40, 300))) <= 300
    assert dealt([], len, 1, 1) == [] and len(dealt(files[:3], lambda s: s, 1 << 40, 5000, 8)) == 3


def test_bytes_read_for_headers_do_not_grow_with_images(tmp_path, monkeypatch):
    taken, close = [], RangedBytes.close
    monkeypatch.setattr(RangedBytes, "close", lambda self: taken.append(self.taken) or close(self))
    for side in (10, 1500):
        path = tmp_path / f"{side}.dcm"
        path.write_bytes(build(bytes(side * side), rows=side, columns=side))
        reader = study_source.StudySource({"path": str(path)}).reader(spark_schema())
        (part,) = reader.partitions()
        assert next(iter(reader.read(part))).column("rows")[0].as_py() == side
    assert len(taken) == 2 and max(taken) <= 1 << 17


def spark_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(studies.METADATA)


def files_of(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def test_a_failed_write_leaves_earlier_files_alone(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("old", b"1"), ("sub/old", b"2")], "name string, body binary")
    assert writers.save_files(rows, "name", "body", str(out)) == 2
    before = files_of(out)

    def failing(batches):
        for batch in batches:
            yield batch
            if batch.column(0)[0].as_py() == "bad":
                raise RuntimeError("encoding broke")

    bad = spark.createDataFrame([("old", b"new"), ("more", b"3"), ("bad", b"4")], "name string, body binary").repartition(3).mapInArrow(failing, "name string, body binary")
    with pytest.raises(Exception, match="encoding broke"):
        writers.save_files(bad, "name", "body", str(out))
    assert files_of(out) == before and sorted(os.listdir(out)) == ["old", "sub"]
    for names, text in ((["x", "x"], "2 outputs would be written to x"), (["../x"], "leaves its folder"), (["sub"], "is a folder")):
        with pytest.raises(CommandError, match=text):
            writers.save_files(spark.createDataFrame([(n, b"5") for n in names], "name string, body binary"), "name", "body", str(out))
        assert files_of(out) == before and sorted(os.listdir(out)) == ["old", "sub"]
    assert writers.save_files(spark.createDataFrame([("old", b"new"), (None, b"x"), ("n", None)], "name string, body binary"), "name", "body", str(out)) == 1
    assert files_of(out) == before | {"old": b"new"}


def test_a_repeated_task_leaves_one_file(tmp_path):
    """Two attempts of one task write the same row; Spark commits one of them."""
    from pyspark.sql.types import StructType

    writer = file_sink.FileWriter(StructType.fromDDL("stem string, key string, png binary"), {"path": str(tmp_path)}, False)
    messages = []
    for attempt in (1, 2):
        place = tmp_path / writer.run / str(attempt)
        place.mkdir()
        (place / "0").write_bytes(b"whole" if attempt == 2 else b"cut o")
        messages.append(file_sink.Staged([("a", "k", "png", f"{writer.run}/{attempt}/0")]))
    writer.commit([messages[1], None])
    assert files_of(tmp_path) == {"a.png": b"whole"}


def test_export_decodes_each_file_once(spark, folder, tmp_path):
    log = tmp_path / "decodes"

    def counted(path, data):
        with open(log, "a") as out:
            out.write(f"{path}\n")
        return studies.pixel_row(path, data)

    decoded = studies.as_images(studies._decode(studies.files(spark, folder, "*.dcm"), counted, studies.PIXELS, True))
    done = api.process(images.render(decoded), api.Controls(equalize=True, palette="hot"))
    assert api.export(done, str(tmp_path / "out"), datetime(2024, 1, 1), "s") == {"png": 3, "dicom": 3}
    assert len(log.read_text().splitlines()) == 3 == len(set(log.read_text().splitlines()))
    names = sorted(files_of(tmp_path / "out"))
    assert len(names) == 6 and "two_processed.png" in names and sum(n.startswith("one_processed-") for n in names) == 4
    assert all(raster.decode(data).samples.shape[:2] == (2, 2) for n, data in files_of(tmp_path / "out").items() if n.endswith("png"))
    first = files_of(tmp_path / "out")
    assert api.export(done, str(tmp_path / "out"), datetime(2024, 1, 1), "s") == {"png": 3, "dicom": 3} and files_of(tmp_path / "out") == first
