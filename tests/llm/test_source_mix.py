import math
import re
from collections import defaultdict

from rayloom.llm.source_mix import mix


def fill(sizes, weights, epochs):
    """Rounds of clamping and dealing the excess again by weight."""
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        heavy = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / heavy > epochs * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / heavy for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, found, near):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in found:
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-6) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near(s), (s, taken[s], target[s])
    return taken


def test_targets_and_copies(documents):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", ("hot" if i % 3 else f"s{i % 11}")) for i in range(3000)]
    found = rows_of(mix(documents(rows), bucket_rows=500))
    assert len(found) == 3000
    check(rows, found, lambda s: 60 * 5)
    again = rows_of(mix(documents(rows).repartition(7), bucket_rows=500))
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)


def test_clamped_sources(documents):
    rows = [(i, "a b c d", "en", "a") for i in range(5)] + [(i, "x " * 40, "en", "b") for i in range(5, 30)]
    found = rows_of(mix(documents(rows)))
    taken = check(rows, found, lambda s: 40)
    assert taken["a"] == 3 * 20


def test_odd_rows(odd):
    from .conftest import ODD

    found = rows_of(mix(odd))
    assert len(found) == len(ODD)
    check(ODD, found, lambda s: 30_002)
    assert [r["size"] for r in found if r["doc_id"] == 0] == [0]


def test_carry_keeps_columns(odd):
    assert mix(odd, carry=tuple(odd.columns)).select("row.*").columns == odd.columns


def test_empty_table(no_documents):
    assert mix(no_documents).count() == 0
