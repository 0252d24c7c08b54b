import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.llm.topk_search import ImpactIndex, Search, exact_top_k


def brute(rows, k, every, scale=1024):
    held = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held[(i, tuple(math.floor(np.float32(x).item() * scale) for x in v))] = 1
    out = []
    for q, qv in held:
        if q % every == 0:
            scores = {(i, sum(a * b for a, b in zip(qv, v))) for i, v in held if i != q}
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted((-s, i) for i, s in scores)[:k]) for s in [-s]]
    return sorted(out)


def run(spark, rows, k=10, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    found = exact_top_k(df, F.col("vec_id") % every == 0, k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block_rows, query_bytes", [(8192, 64_000_000), (40, 800)])
def test_equals_brute_force(spark, block_rows, query_bytes):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 4]], "x", 1) for i in range(300)]
    assert run(spark, rows, block_rows=block_rows, query_bytes=query_bytes) == brute([r[:2] for r in rows], 10, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (5, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, None]), (3, None), (4, [nan, 1.0]),
        (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1e9, -1e9]), (8, [0.0, 0.0]), (9, [0.5, -0.25]), (10, [-0.5, 0.25]),
    ]
    rows = [(*r, "x", 1) for r in rows]
    assert run(spark, rows, k=3) == brute([r[:2] for r in rows], 3, 5)


def test_vectors_of_different_length_and_empty_ones(spark):
    rows = [(0, [1.0], None, None), (1, [1.0, 5.0], None, None), (2, [], None, None), (5, [0.5, 0.5], None, None)]
    assert run(spark, rows, k=2) == [(0, 1, 1, 1024 * 1024), (0, 2, 5, 1024 * 512), (5, 1, 1, 512 * 1024 + 512 * 5120), (5, 2, 0, 512 * 1024)]


def test_components_of_any_size_are_exact(spark):
    rows = [(0, [1.0], None, None), (1, [100000.0], None, None), (2, [200000.0], None, None)]
    assert run(spark, rows, k=2) == [(0, 1, 2, 209715200000), (0, 2, 1, 104857600000)]
    rng = random.Random(9)
    mixed = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 3, 6]) for _ in range(6)], "x", 1) for i in range(90)]
    assert run(spark, mixed, block_rows=25) == brute([r[:2] for r in mixed], 10, 5)


def test_a_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="is no 64-bit number"):
        run(spark, [(0, [1e12], None, None), (1, [1e12], None, None)])


def test_repeated_rows_in_many_blocks(spark):
    rows = [(i % 7, [float(i % 7), 1.0], None, None) for i in range(200)]
    assert run(spark, rows, k=4, every=3, block_rows=10) == brute([r[:2] for r in rows], 4, 3)


@pytest.mark.parametrize("sample", [2, 64])
def test_the_first_pass_changes_nothing(spark, sample):
    """Also where an id has several vectors, scores tie at the threshold, and sums are wide."""
    rng = random.Random(5)
    rows = [(i % 900 if i % 45 else i, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(5)], "x", 1) for i in range(1500)]
    rows += [(i, [rng.uniform(-1, 1) * 10**6 for _ in range(5)], "x", 1) for i in range(2000, 2030)]
    assert run(spark, rows, k=3, every=45, sample=sample, block_rows=60) == brute([r[:2] for r in rows], 3, 45)


def test_tasks_send_nothing_below_what_is_reached():
    rng = np.random.default_rng(2)
    ids, vectors = np.arange(500), rng.integers(-100, 100, (500, 8)).astype(float)
    scores = np.sort(vectors[1:] @ vectors[0])[::-1].astype(int)
    search = Search(ids[:1], vectors[:1], 10, 32, {0: int(scores[3])})
    for at in range(0, 500, 50):
        search.add(ids[at : at + 50], vectors[at : at + 50])
    assert search.best()[2].tolist() == scores[: (scores >= scores[3]).sum()].tolist()


def test_empty_table(spark):
    assert run(spark, []) == []


def test_the_scan_ends_on_proof():
    """With one clear cluster most rows are ruled out before they are rescored."""
    rng = np.random.default_rng(1)
    near, far = rng.integers(600, 700, (20, 16)), rng.integers(-50, 50, (2000, 16))
    index = ImpactIndex(np.concatenate([near, far]).astype(float), 32)
    members, scores = index.search(near[0], np.ones(2020, bool), 10)
    assert len(members) < 200 and set(np.argsort(-(np.concatenate([near, far]) @ near[0]))[:10]) <= set(members)
    assert (scores == np.concatenate([near, far])[members] @ near[0]).all()
