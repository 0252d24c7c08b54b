"""The versioned catalog with several writers."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest

from rayloom import api
from rayloom.errors import CommandError
from rayloom.sources import catalog, stores

from .test_sources import build


def entry(path):
    return {"inputPath": path, "inputName": path, "measurementScale": None, "lastOpenedAt": "2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_no_update_of_concurrent_writers_is_lost(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/catalog"
    with ThreadPoolExecutor(8) as writers:
        versions = list(writers.map(lambda n: catalog.commit(spark, folder, lambda held: [entry(f"s{n}")] + held), range(10)))
    assert sorted(versions) == list(range(1, 11))
    assert sorted(r.inputPath for r in catalog.load(spark, folder).collect()) == sorted(f"s{n}" for n in range(10))
    assert [int(n[:20]) for n in stores.names(spark, folder)] == list(range(6, 11))


def test_a_writer_that_was_overtaken_starts_again(spark, tmp_path):
    folder, calls = str(tmp_path / "catalog"), []

    def slow(held):
        calls.append([e["inputPath"] for e in held])
        if len(calls) == 1:
            catalog.commit(spark, folder, lambda own: [entry("other")] + own)
        return [entry("mine")] + held

    assert catalog.commit(spark, folder, slow) == 2 and calls == [[], ["other"]]
    assert [r.inputPath for r in catalog.load(spark, folder).collect()] == ["mine", "other"]
    with pytest.raises(CommandError, match="changed by others 3 times"):
        catalog.commit(spark, folder, lambda held: catalog.commit(spark, folder, lambda own: own) and held, attempts=3)


def test_one_of_two_exclusive_writes_wins(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    assert stores.create_exclusive(spark, folder, "a", "1") and not stores.create_exclusive(spark, folder, "a", "2")
    assert stores.read_text(spark, f"{folder}/a") == "1" and stores.names(spark, folder) == ["a"]
    # the way of other stores, on local files
    hadoop = stores._hadoop

    class Remote:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return (lambda: "hdfs") if name == "getScheme" else getattr(self.system, name)

    monkeypatch.setattr(stores, "_hadoop", lambda spark, path: (Remote(hadoop(spark, path)[0]), hadoop(spark, path)[1]))
    assert stores.create_exclusive(spark, folder, "b", "ä") and not stores.create_exclusive(spark, folder, "b", "2")
    assert stores.read_text(spark, f"{folder}/b") == "ä" and stores.names(spark, folder) == ["a", "b"]


def test_opened_studies_come_first_once_each(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    (tmp_path / "in").mkdir()
    for n in range(12):
        (tmp_path / "in" / f"{n:02d}.dcm").write_bytes(build(spacing="0.2\\0.3" if n else None))
    (tmp_path / "in" / "bad.dcm").write_bytes(b"x")
    opened = api.open_studies(spark, str(tmp_path / "in"), strict=False)
    catalog.record_opened(spark, folder, opened, datetime(2024, 5, 1))
    names = lambda: [r.inputName for r in catalog.load(spark, folder).collect()]
    assert names() == [f"{n:02d}.dcm" for n in range(10)]
    catalog.record_opened(spark, folder, opened.filter("input_name in ('03.dcm', '11.dcm')").union(opened.filter("input_name = '03.dcm'")), datetime(2024, 5, 2))
    assert names() == ["03.dcm", "11.dcm"] + [f"{n:02d}.dcm" for n in (0, 1, 2, 4, 5, 6, 7, 8)]
    rows = catalog.load(spark, folder).collect()
    assert rows[0].measurementScale.asDict() == {"rowSpacingMm": 0.2, "columnSpacingMm": 0.3, "source": "PixelSpacing"} and rows[2].measurementScale is None
    assert [r.lastOpenedAt for r in rows[:3]] == ["2024-05-02T00:00:00Z"] * 2 + ["2024-05-01T00:00:00Z"]
    catalog.record_opened(spark, folder, opened.filter("false"))
    assert names()[:2] == ["03.dcm", "11.dcm"]


def test_missing_null_and_corrupt_catalogs(spark, tmp_path):
    folder = tmp_path / "catalog"
    assert catalog.load(spark, str(folder)).collect() == []
    folder.mkdir()
    (folder / f"{1:020d}.json").write_text(json.dumps({"recentStudies": [entry("kept")]}))
    (folder / f"{2:020d}.json").write_text("{not json")
    with pytest.raises(CommandError) as caught:
        catalog.load(spark, str(folder))
    assert caught.value.code == "cacheCorrupted" and (folder / f"{2:020d}.corrupt.json").read_text() == "{not json"
    assert [r.inputPath for r in catalog.load(spark, str(folder)).collect()] == ["kept"]
    (folder / f"{3:020d}.json").write_text('{"recentStudies": null}')
    assert catalog.load(spark, str(folder)).collect() == []
    (folder / f"{4:020d}.json").write_text("[")
    opened = spark.createDataFrame([("/a", "a", None, None)], "path string, input_name string, scale struct<row:double,col:double,source:string>, error string")
    assert catalog.record_opened(spark, str(folder), opened) == 4
    assert [r.inputPath for r in catalog.load(spark, str(folder)).collect()] == ["/a"]
