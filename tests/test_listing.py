"""Listings and names of many files, of which the driver holds none."""

import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from rayloom.errors import CommandError
from rayloom.sources import file_sink, listing, row_bands, studies, study_source, writers

from .test_sources import build


@pytest.fixture
def tree(tmp_path):
    for name in ("a.dcm", "b.bmp", "c.txt", "x/y/d.dcm", "x/y/z/e.DCM", "x/_hidden/f.dcm", "x/.g.dcm", "two words/h.dcm"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty" / "below").mkdir(parents=True)
    os.symlink(tmp_path / "x" / "y", tmp_path / "linked")
    return tmp_path


def test_a_listing_is_what_the_folders_hold(spark, tree):
    def found(*paths, glob=None):
        return sorted(tuple(r) for r in listing.files(spark, paths, glob).collect())

    want = sorted((f"{tree}/{n}", len(b)) for n, b in (
        ("a.dcm", "a.dcm"), ("b.bmp", "b.bmp"), ("c.txt", "c.txt"), ("x/y/d.dcm", "x/y/d.dcm"), ("x/y/z/e.DCM", "x/y/z/e.DCM"),
        ("two words/h.dcm", "two words/h.dcm"), ("linked/d.dcm", "x/y/d.dcm"), ("linked/z/e.DCM", "x/y/z/e.DCM"),
    ))
    assert found(str(tree)) == want == study_source.listed([str(tree)], None)
    assert found(f"file:{tree}/") == [(f"file:{p}", n) for p, n in want]
    assert [p[len(str(tree)) + 1 :] for p, _ in found(str(tree), glob="*.{dcm,bmp}")] == ["a.dcm", "b.bmp", "linked/d.dcm", "two words/h.dcm", "x/y/d.dcm"]
    # overlapping and repeated paths, a file, and a hidden folder that is asked for
    assert found(str(tree), f"{tree}/x", f"{tree}/a.dcm", f"{tree}/a.dcm") == want
    assert found(f"{tree}/x/_hidden") == [(f"{tree}/x/_hidden/f.dcm", 15)]
    assert found(f"{tree}/c.txt", glob="*.dcm") == found(f"{tree}/empty") == found() == []
    with pytest.raises(FileNotFoundError, match="does not exist"):
        found(f"{tree}/none")


def test_bands_don_t_list_files_on_the_driver(spark, tmp_path, monkeypatch):
    for name in ("a/one.dcm", "b/two.dcm", "b/.hidden.dcm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(build(bytes([5, 6])))
    want = sorted(r.path for r in studies.files(spark, str(tmp_path)).select("path").collect())

    def refused(*_):
        raise AssertionError("the driver lists files")

    monkeypatch.setattr(studies, "files", refused)
    assert sorted(r.path for r in row_bands.layouts(spark, str(tmp_path)).collect()) == want and len(want) == 2
    assert row_bands.layouts(spark, [f"{tmp_path}/*/one.dcm", f"{tmp_path}/a"]).count() == 1
    with pytest.raises(FileNotFoundError, match="does not exist"):
        row_bands.layouts(spark, f"{tmp_path}/none")


def test_what_the_driver_gets_of_a_write_does_not_grow_with_files(tmp_path, monkeypatch):
    class Context:
        taskAttemptId = staticmethod(lambda: 7)

    monkeypatch.setattr(file_sink.TaskContext, "get", lambda: Context)
    sizes = []
    for n in (1, 2000):
        writer = file_sink.FileWriter(StructType.fromDDL("stem string, key string, png binary, dcm binary"), {"path": str(tmp_path / str(n))}, False)
        rows = [{"stem": f"image-{i}", "key": f"key-{i}", "png": b"p", "dcm": None if i % 2 else b"dd"} for i in range(n)]
        (told,) = writer.staged(iter(pa.Table.from_pylist(rows, schema=pa.schema([("stem", pa.string()), ("key", pa.string()), ("png", pa.binary()), ("dcm", pa.binary())])).to_batches(100)))
        sizes.append(len(pickle.dumps(told)))
        assert told.num_rows == 1 and told.column("counts")[0].as_py() == [n, (n + 1) // 2]
        with pa.ipc.open_stream(f"{tmp_path}/{n}/{told.column('manifest')[0].as_py()}") as manifest:
            assert manifest.read_all().num_rows == n + (n + 1) // 2
    assert sizes[1] < sizes[0] + 100


def test_names_are_settled_by_tasks_as_by_a_commit(spark, tmp_path, monkeypatch):
    rows = [("one", "a/one", b"1"), ("one", "b/one", b"2"), ("sub/two", "c", b"3"), ("sub/two", "c", None), ("", "d", b"4"), (None, "e", b"5"), ("ünï", None, b"6")]
    names = file_sink.final_names([(s, k or "", "png", str(i)) for i, (s, k, b) in enumerate(rows) if s and b])
    monkeypatch.setattr(file_sink, "final_names", None)
    df = spark.createDataFrame(rows, "stem string, key string, png binary").repartition(3)
    out = str(tmp_path / "out")
    for _ in range(2):
        assert file_sink.save(df, out) == {"png": 4}
        assert {n: open(f"{out}/{n}", "rb").read() for n in names.values()} == {name: rows[int(i)][2] for i, name in names.items()}
        assert sorted(os.listdir(out)) == sorted({n.split("/")[0] for n in names.values()})
    with pytest.raises(CommandError, match="3 outputs would be written to y.png"):
        file_sink.save(spark.createDataFrame([("y", "k", b"1")] * 3 + [("z", "k", b"1")] * 2, "stem string, key string, png binary"), out)
    assert file_sink.save(df.limit(0), out) == {"png": 0} and writers.save_files(df.limit(0), "stem", "png", str(tmp_path / "new")) == 0
    assert ".writing" not in "".join(os.listdir(out))
