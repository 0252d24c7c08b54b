import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.llm import hard_negatives as hn

SMALL = {"block_rows": 16, "anchor_rows": 3, "chunk_dims": 5, "batch_anchors": 7}


def brute(rows, every, positives=5, negatives=10, window=(30, 90), scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(np.float32(x).item() * scale) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for a, (label, own) in held.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(own, v)), i, other == label) for i, (other, v) in held.items() if i != a)
        for p in [s for s in scores if s[2]][:positives]:
            inside = [s for s in scores if not s[2] and window[0] * -p[0] <= 100 * -s[0] <= window[1] * -p[0]]
            out += [(a, p[1], rank + 1, s[1], -p[0], -s[0]) for rank, s in enumerate(inside[:negatives])]
    return sorted(out)


def run(spark, rows, every=4, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, row int")
    found = hn.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def cloud(n, seed, dims=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 3]], rng.choice([i % 3, i % 3, 7])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, SMALL, {"positives": 2, "negatives": 3, "window": (50, 80)}])
def test_equals_brute_force(spark, options):
    rows = cloud(130, 2)
    plain = {k: v for k, v in options.items() if k in ("positives", "negatives", "window")}
    want = brute(rows, 4, **plain)
    assert want and run(spark, rows, **options) == want


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [1.0, 0.5], 1 + (i % 2)) for i in range(60)] + [(60 + i, [0.5, 0.25], 3) for i in range(40)]
    assert run(spark, rows, **SMALL) == brute(rows, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(40, 3) + [
        (100, None, 1), (104, [nan, 1.0], 1), (108, [inf], 1), (112, [None, 1.0], 1), (116, [0.5], None), (None, [0.5], 1), (120, [], 1),
        (124, [0.5, 0.5], 1), (128, [-0.5, -0.5], 99), (0, [0.1] * 12, 0), (0, [0.1] * 12, 0), (4, [9.0] * 20, 5), (131, [0.0], 2),
    ]
    assert run(spark, rows, **SMALL) == brute(rows, 4)


def test_components_of_any_size_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 3, 5]) for _ in range(6)], i % 2) for i in range(60)]
    assert run(spark, rows, **SMALL) == brute(rows, 4)
    left, right = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 5.0], [-(2.0**40), 7.0]])
    wide = hn.product(left, right, 3)
    assert wide.tolist() == [[2**80 + 15, -(2**80) + 21]]
    assert hn._unpack(hn._pack(wide), (1, 2)).tolist() == wide.tolist()


def test_a_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="is no 64-bit number"):
        run(spark, [(0, [1e12], 1), (1, [1e12], 1)])


def test_empty_table_and_anchor_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_tiles_are_summed_over_chunks(spark):
    """Every tile equals the plain product of its rows, whatever the chunks."""
    rows = cloud(50, 6, 11)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, row int")
    held = hn.labelled_vectors(df, "vec_id", F.col("label"), "embedding", 256)
    vectors = {r.id: np.array(r.v) for r in held.collect()}
    tiles = hn.score_tiles(held, held.filter("id % 4 = 0"), 3, 2, 3, 4).collect()
    pairs = set()
    for t in tiles:
        anchors, ids = np.frombuffer(t.anchors, np.int64), np.frombuffer(t.ids, np.int64)
        scores = hn._unpack(t.tile, (len(anchors), len(ids)))
        for i, a in enumerate(anchors):
            for j, x in enumerate(ids):
                assert scores[i, j] == vectors[a] @ vectors[x]
                pairs.add((a, x))
    assert len(pairs) == 13 * 50


def test_scores_are_neither_written_nor_shuffled(spark, tmp_path, monkeypatch):
    """1500 anchors with 1500 rows have 2.25 million scores; what is stored and sent grows with the rows."""
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 5) for i in range(1500)]
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in iterate(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = set(stages())
    monkeypatch.setattr("rayloom.llm.common.scratch_dir", lambda spark: str(tmp_path))
    found = run(spark, rows, 1, positives=1, negatives=1, chunk_dims=4)
    assert found == brute(rows, 1, 1, 1)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    sent = sum(size for stage, size in stages().items() if stage not in before)
    assert 0 < written < 500_000 and 0 < sent < 1_500_000


def iterate(scala):
    it = scala.iterator()
    while it.hasNext():
        yield it.next()


@pytest.mark.parametrize("grid", [{"band_anchors": 1}, {"band_anchors": 6, "group_rows": 20}, {"batch_anchors": 1000, "band_anchors": 9, "group_rows": 1}])
def test_any_grid_of_tasks_gives_the_same(spark, grid):
    rows = cloud(130, 11)
    assert run(spark, rows, **(SMALL | grid)) == brute(rows, 4)
