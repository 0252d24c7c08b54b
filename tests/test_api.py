from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom import api
from rayloom.functions.contracts import contract_errors
from rayloom.operators.contracts import schema_drift, schema_errors
from rayloom.operators.requests import json_value
from rayloom.sources import dicom, raster

from .test_sources import build

SOURCE = bytes([0, 64, 128, 255, 10, 80, 160, 240])


def study(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dcm").write_bytes(build(SOURCE, rows=2, columns=4, window=(127.5, 255)))
    return str(tmp_path / "in")


def test_process_and_export(spark, tmp_path):
    path = study(tmp_path)
    done = api.process(api.render(spark, path), api.Controls("xray", compare=True))
    row = done.first()
    assert row.gray == [0, 43, 128, 255, 0, 85, 170, 255] and row.width == 8
    assert [p.r for p in row.rgba[:4]] == [0, 64, 129, 255] and tuple(row.rgba[6])[:3] == (112, 120, 128)
    assert row.mode.endswith("with bone palette") and row.mode.startswith("comparison of grayscale and")
    out = tmp_path / "out"
    assert api.export(done, str(out), datetime(2024, 1, 1), "s") == {"png": 1, "dicom": 1}
    assert raster.decode((out / "a_processed.png").read_bytes()).samples.shape == (2, 8, 4)
    back = dicom.read((out / "a_processed.dcm").read_bytes(), True)
    assert (back.width, back.height, back.get("photometric")) == (8, 2, "RGB")


def test_plain_render_and_inspection(spark, tmp_path):
    path = study(tmp_path)
    assert api.process(api.render(spark, path), api.Controls()).first().mode == "grayscale"
    profiles, summary = api.inspect_decode(spark, path)
    assert profiles.count() == 1 and summary.first().study_count == 1
    assert api.open_studies(spark, path).first().input_name == "a.dcm"
    full = api.render(spark, path, "full").first().gray
    assert full == np.array([0, 64, 128, 255, 10, 80, 160, 240]).tolist()


@pytest.mark.parametrize("controls", [api.Controls("missing"), api.Controls(brightness=999), api.Controls(palette="magma"), api.Controls(contrast=float("nan"))])
def test_invalid_controls(controls):
    with pytest.raises(api.CommandError) as caught:
        controls.resolved()
    assert caught.value.code == "invalidInput"


def test_missing_input(spark, tmp_path):
    with pytest.raises(api.CommandError) as caught:
        api.open_studies(spark, str(tmp_path / "nowhere.dcm"))
    assert caught.value.code == "notFound"


def test_one_study_and_output_paths(spark, tmp_path):
    folder = study(tmp_path)
    assert api.open_study(spark, f"{folder}/a.dcm").first().input_name == "a.dcm"
    code = lambda f, *args: pytest.raises(api.CommandError, f, spark, *args).value.code
    assert code(api.open_study, folder) == "invalidInput" and code(api.open_study, f"{folder}/b.dcm") == "notFound" and code(api.open_study, "nostore://x/y") == "internal"
    assert api.output_path(spark, None, "/cache", "f1") == "/cache/artifacts/process/f1.dcm"
    assert api.output_path(spark, f" {folder}/new.dcm ", "/cache", "f1") == f"{folder}/new.dcm"
    assert [code(api.output_path, p, "/cache", "f") for p in (" ", folder, f"{folder}/no/x.dcm", f"{folder}/a.dcm/x.dcm")] == ["invalidInput", "invalidInput", "notFound", "invalidInput"]


def test_files_of_one_name_are_all_exported(spark, tmp_path):
    for name in ("x", "y", "z"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / ("b.dcm" if name == "z" else "a.dcm")).write_bytes(build(SOURCE, rows=2, columns=4, window=(127.5, 255)))
    done = api.process(api.render(spark, str(tmp_path / "in")), api.Controls(equalize=True, brightness=10))
    assert api.export(done, str(tmp_path / "out"), datetime(2024, 1, 1), "s") == {"png": 3, "dicom": 3}
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 6 and "b_processed.png" in names and sum(n.startswith("a_processed-") for n in names) == 4


SCHEMA = {
    "$defs": {
        "scale": {"type": "object", "additionalProperties": False, "required": ["row"], "properties": {"row": {"type": "number", "minimum": 0}, "unit": {"const": "mm"}}},
        "render": {"type": "object", "required": ["kind"], "properties": {"kind": {"const": "render"}}},
        "process": {"type": "object", "required": ["kind"], "properties": {"kind": {"const": "process"}}},
        "job": {
            "type": "object", "additionalProperties": False, "required": ["id", "state"],
            "properties": {
                "id": {"type": "integer"}, "state": {"enum": ["queued", "done"]}, "scale": {"anyOf": [{"$ref": "#/$defs/scale"}, {"type": "null"}]}, "note": {"type": ["string", "null"]},
                "result": {"oneOf": [{"$ref": "#/$defs/render"}, {"$ref": "#/$defs/process"}]}, "points": {"type": "array", "items": {"$ref": "#/$defs/scale"}},
            },
        },
    }
}


def test_schema_errors(spark):
    ok = '"id": 1, "state": "queued"'
    cases = {
        f"{{{ok}}}": [],
        f'{{{ok}, "scale": null, "note": null, "result": {{"kind": "render"}}, "points": [{{"row": 1}}, {{"row": 0.5, "unit": "mm"}}]}}': [],
        '{"id": 1.5, "state": "lost", "x": 1}': ["job.x: unexpected property", "job.id: expected integer, received 1.5", 'job.state: expected one of "queued", "done", received "lost"'],
        '{"id": 2.0}': ["job.state: missing required property"],
        f'{{{ok}, "scale": {{"row": "q"}}}}': ["job.scale: value does not match any allowed shape"],
        f'{{{ok}, "result": {{"kind": "other"}}}}': ["job.result: value does not match any oneOf branch"],
        f'{{{ok}, "note": 3}}': ["job.note: value does not match any allowed type"],
        f'{{{ok}, "points": [{{"row": -1}}, {{}}, 7]}}': ["job.points[0].row: below 0", "job.points[1].row: missing required property", "job.points[2]: expected object, received 7"],
        f'{{{ok}, "points": 4}}': ["job.points: expected array, received 4"],
        "[1]": ["job: expected object, received [1]"], "nonsense {": ["job: not JSON"], None: ["job: not JSON"],
    }
    assert errors(spark, cases, SCHEMA, "job") == [sorted(c) for c in cases.values()]


def errors(spark, payloads, schema, definition):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(payloads)], "i int, payload string")
    found = {}
    for r in schema_errors(df, "i", "payload", schema, definition).collect():
        found.setdefault(r.key, []).append(f"{r.at}: {r.error}")
    return [sorted(found.get(i, [])) for i in range(len(payloads))]


def test_a_schema_that_refers_to_itself(spark):
    tree = {"type": "object", "additionalProperties": False, "required": ["v"], "properties": {"v": {"type": "integer"}, "below": {"type": "array", "items": {"anyOf": [{"$ref": "#/$defs/tree"}, {"type": "null"}]}}, "next": {"$ref": "#/$defs/tree"}}}
    deep = lambda n, end: "{\"v\": 1, \"next\": " * n + end + "}" * n
    payloads = [deep(12, '{"v": 2}'), deep(12, '{"v": "x"}'), '{"v": 1, "below": [null, {"v": 1, "below": [{"v": 0}]}, {"w": 1}, {"v": 1, "below": [7]}]}', '{"v": 1, "a/b": 2}']
    assert errors(spark, payloads, {"$defs": {"tree": tree}}, "tree") == [
        [], ["tree" + ".next" * 12 + '.v: expected integer, received "x"'],
        ["tree.below[2]: value does not match any allowed shape", "tree.below[3]: value does not match any allowed shape"], ["tree.a/b: unexpected property"],
    ]
    both = {"oneOf": [{"type": "number", "minimum": 1}, {"type": "integer"}]}
    assert errors(spark, ["3", "0", "0.5", "\"s\""], {"$defs": {"n": both}}, "n") == [["n: value matches multiple oneOf branches"], [], ["n: value does not match any oneOf branch"], ["n: value does not match any oneOf branch"]]
    assert errors(spark, [], {"$defs": {"n": both}}, "n") == [] and errors(spark, ["5"], {"$defs": {"n": {}}}, "n") == [[]]


def test_drift_counts_repeated_rows(spark):
    schema = "definition string, property string, type string, required boolean"
    old = spark.createDataFrame([("job", "id", "integer", True), ("job", "state", None, False), ("job", "state", None, False)], schema)
    new = spark.createDataFrame([("job", "id", "string", True), ("job", "state", None, False)], schema)
    assert sorted(map(tuple, schema_drift(old, new).collect()), key=str) == [("added", "job", "id", "string", True), ("removed", "job", "id", "integer", True), ("removed", "job", "state", None, False)]


def test_json_of_requests(spark):
    texts = ['plain', 'q"b\\', "tab\tnl\nbell\x07", "<&>\u2028", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(json_value(F.col("t"), "string")).collect()]
    assert got == ['"plain"', '"q\\"b\\\\"', '"tab\\tnl\\nbell\\u0007"', '"\\u003c\\u0026\\u003e\\u2028"', "null"]
    numbers = spark.createDataFrame([(1.4,), (2.0,), (0.1,), (0.0,), (-1.25,), (100.0,), (None,)], "x double")
    assert [r[0] for r in numbers.select(json_value(F.col("x"), "double")).collect()] == ["1.4", "2", "0.1", "0", "-1.25", "100", "null"]


def test_job_snapshots_keep_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "queued", 0), (1, datetime(2024, 1, 2), 2, "running", 5), (2, datetime(2024, 1, 1), 3, "queued", 0)], "job_id long, ts timestamp_ntz, seq long, state string, percent int")
    assert [(r.job_id, r.state) for r in api.job_snapshots(rows, [2, 9, 1, 2]).collect()] == [(2, "queued"), (1, "running"), (2, "queued")]


def test_contract_errors(spark):
    cases = {
        '{"id": 1, "name": "x"}': [], '{"id": 1, "b": 2, "a": 3}': ["unknown field a", "unknown field b"], '{"name": "x"}': ["missing field id"],
        '{"id": "q"}': ["id is not of type integer"], "[1]": ["not a JSON object"], None: ["not a JSON object"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "payload string")
    got = [r[0] for r in df.select(contract_errors(F.col("payload"), {"id": "integer", "name": "string"}, ["id"])).collect()]
    assert got == list(cases.values())
