import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rayloom.llm import simhash_dedup as sh
from rayloom.llm.components import connected_components


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    """Smallest member for each node; ``linked`` says whether two are neighbours."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def near(d):
    return lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= d


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Ünï CODE words", "a b c d", "A b\tc\x0bd e f  g " * 9])
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) % 2**64 == slow_fingerprint(text)


def test_components_of_odd_links(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows = [(1, 2), (2, 1), (1, 2), (5, 5), (None, 7), (8, None), (2, 9), (-3, 4)] + [(100, 200 + i) for i in range(300)]
    got = {r.node: r.root for r in connected_components(frame(rows)).collect()}
    assert got == {1: 1, 2: 1, 9: 1, -3: -3, 4: -3, 100: 100} | {200 + i: 100 for i in range(300)}
    assert connected_components(frame([])).count() == 0


def family(rng, size, spread):
    """Fingerprints around one centre, and chains of small steps."""
    base = rng.getrandbits(64)
    out = set()
    while len(out) < size:
        x = base
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("distance, bucket_rows", [(4, 16_384), (4, 40), (7, 16_384), (2, 16_384), (0, 16_384)])
def test_links_connect_as_all_pairs_do(spark, distance, bucket_rows):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(150)} | family(rng, 150, 6) | family(rng, 60, 10) | {0, 1, 3, 7, 2**64 - 1}
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    links = sh.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, bucket_rows)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(near(distance)(a, b) or bucket_rows for a, b in pairs)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert {x: roots.get(x, x) for x in signed} == slow_components(signed, near(distance))


def test_large_bucket_in_blocks():
    rng = random.Random(5)
    fps = np.array(sorted(family(rng, 900, 7) | {rng.getrandbits(64) for _ in range(300)}), np.uint64)
    label = sh._run_labels(fps, 4)
    want = slow_components(list(range(len(fps))), lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 4)
    assert label.tolist() == [want[i] for i in range(len(fps))]


def test_stream_over_batches_finds_what_one_batch_does():
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randint(0, 30), int(np.uint64(x).astype(np.int64))) for x in family(rng, 700, 5))
    table = pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "fp": pa.array([r[1] for r in rows], pa.int64())})
    links = lambda size, limit: [
        tuple(r.values()) for b in sh._stream(4, limit)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()
    ]
    assert sorted(links(10, None)) == sorted(links(1000, None))
    passed = [(a, b) for kind, a, b in links(7, 20) if kind == 1]
    large = {k for k, n in defaultdict(int, {k: sum(r[0] == k for r in rows) for k, _ in rows}).items() if n > 20}
    assert sorted(passed) == sorted(r for r in rows if r[0] in large)


def expected(rows):
    held = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    roots = slow_components(sorted({f for _, f in held}), near(4))
    least = defaultdict(list)
    for i, f in held:
        least[roots[f]].append(i)
    ids = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    return sorted(((i, f"{f:016x}", ids[roots[f]]) for i, f in held), key=repr)


def found(df):
    out = sh.near_duplicates(df).select("doc_id", sh.fingerprint_hex("fp").alias("f"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_documents(documents):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(60, 160):
        t = rng.choice(texts).split()
        t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    assert found(documents(rows)) == expected(rows)


def test_odd_rows(odd, no_documents):
    from .conftest import ODD

    assert found(odd) == expected(ODD)
    assert found(no_documents) == []


def test_keep_one(odd, no_documents, documents):
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 6]
    assert sh.keep_one(no_documents).count() == 0
    assert sh.keep_one(documents([(None, "x y z"), (None, "x y z")])).count() == 1


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_catches_similar_texts_and_no_others(documents):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 200))) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 160):
        t = base[i % 60].split()
        for _ in range(rng.choice([1, 1, 2, 40])):
            t[rng.randrange(len(t))] = "changed%d" % rng.randrange(10**6)
        rows.append((i, " ".join(t)))
    kept = {r.doc_id for r in sh.keep_one(documents(rows)).collect()}
    texts = dict(rows)
    assert set(range(60)) <= kept
    similar = {i for i in range(60, 160) if jaccard(texts[i], texts[i % 60]) >= 0.8}
    assert len(similar) > 30 and not similar & kept
    linked = {i for i in range(60, 160) if max(jaccard(texts[i], texts[j]) for j in range(i % 60, i, 60) if j != i) >= 0.8}
    assert all(i in linked or near(4)(slow_fingerprint(texts[i]), slow_fingerprint(texts[i % 60])) for i in set(range(60, 160)) - kept)


def test_keep_one_leaves_no_similar_pair(documents):
    """One block of added text moves more pair-fingerprint bits than 7 while the similarity stays above 0.8."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    boilerplate = " ".join(rng.choices(words, k=40))
    base = [" ".join(rng.choices(words, k=rng.randint(150, 400))) for _ in range(60)]
    rows = [(i, f"{t} {boilerplate}") for i, t in enumerate(base)]
    for i in range(60, 240):
        t = rows[i % 60][1].split()
        at, n = rng.randrange(len(t)), int(len(t) * rng.choice([0.08, 0.14, 0.19, 0.22]))
        rows.append((i, " ".join(t[:at] + [f"new{rng.randrange(10**6)}" for _ in range(n)] + t[at:])))
    texts = dict(rows)
    kept = sorted(r.doc_id for r in sh.keep_one(documents(rows), bucket_rows=16, set_rows=16).collect())
    assert [(a, b) for a in kept for b in kept if a < b and jaccard(texts[a], texts[b]) >= 0.8] == []
    assert set(range(60)) <= set(kept)


def near_texts(rng, n, pieces=8):
    """Groups of texts with every kind of edit, from none to many."""
    words, out = [f"w{i}" for i in range(3000)], []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(30, 250))
        out.append(" ".join(base))
        for _ in range(pieces):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            at = rng.randrange(len(t))
            out.append(" ".join(t[: at] + rng.choices(words, k=rng.randint(0, len(t) // 9)) + t[at:]))
    return out


@pytest.mark.parametrize("set_rows, set_entries", [(4096, 4_000_000), (6, 4_000_000), (4096, 300)])
def test_components_equal_those_of_all_pairs(documents, set_rows, set_entries):
    """Recall against brute-force Jaccard over all pairs: every component, links of both kinds."""
    texts = near_texts(random.Random(set_rows), 25)
    fps = [slow_fingerprint(t) for t in texts]
    roots = slow_components(list(range(len(texts))), lambda a, b: near(4)(fps[a], fps[b]) or jaccard(texts[a], texts[b]) >= 0.8)
    kept = {r.doc_id for r in sh.keep_one(documents(list(enumerate(texts))), set_rows=set_rows, set_entries=set_entries).collect()}
    assert kept == set(roots.values()) and 25 <= len(kept) < 0.6 * len(texts)


def test_bands_at_the_threshold():
    """Of pairs with a coefficient just above 0.8, one in 2500 is expected to share no band."""
    rng, bands, met = np.random.default_rng(7), sh.Bands(), 0
    for _ in range(2000):
        sets = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.unique(sets[:180]), np.unique(sets[20:])
        assert len(np.intersect1d(a, b)) / 200 == 0.8
        met += bool((bands(a) == bands(b)).any())
    assert met >= 1994 and len(bands(np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize("size", [3, 5, 1000])
def test_runs_over_batches(size):
    import pyarrow as pa

    rng = random.Random(size)
    keys = sorted(rng.choice([1, 2, 2, 2, 2, 3, 4, 4, 9]) for _ in range(60))
    table = pa.table({"h": pa.array(keys, pa.int64()), "i": pa.array(range(60), pa.int64())})
    batches = lambda: iter(table.to_batches(max_chunksize=size))
    whole = [(c[0].to_pylist(), c[1].to_pylist()) for c, w in sh._runs(batches(), None) if w]
    assert [k[0] for k, _ in whole] == sorted(set(keys)) and sum((i for _, i in whole), []) == list(range(60))
    cut = [(c[0].to_pylist(), c[1].to_pylist(), w) for c, w in sh._runs(batches(), 12)]
    assert sum((i for _, i, _ in cut), []) == list(range(60)) and all(len(set(k)) == 1 for k, _, _ in cut)
    assert {k[0] for k, _, w in cut if w} == {k for k in keys if keys.count(k) <= 12} and all(w or keys.count(k[0]) > 12 for k, _, w in cut)


def test_set_links_are_a_forest_of_the_similar_pairs():
    rng = random.Random(1)
    sets = []
    for _ in range(30):
        base = rng.sample(range(5000), 60)
        sets += [np.unique(np.array([x for x in base if rng.random() > 0.06], np.int32)) for _ in range(5)]
    fps = np.array([i // 2 * 7 for i in range(len(sets))], np.int64)
    a, b = sh.set_links(sets, fps, 0.8)
    alike = lambda i, j: fps[i] == fps[j] or len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    want = slow_components(list(range(len(sets))), alike)
    joined = set(zip(a.tolist(), b.tolist()))
    got = slow_components(list(range(len(sets))), lambda i, j: fps[i] == fps[j] or (fps[i], fps[j]) in joined or (fps[j], fps[i]) in joined)
    assert got == want and len(a) < len(sets)


def test_keep_one_tries_more_than_the_nearest(documents):
    """Texts of few words share all their word pairs, so that only a look at every pair tells which are similar."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdef", k=600))) for i in range(6)]
    for i in range(6, 24):
        t = rows[i % 6][1].split()
        at = rng.randrange(520)
        rows.append((i, " ".join(t[:at] + t[at : at + 45][::-1] + t[at + 45 :])))
    texts = dict(rows)
    alike = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    assert len(alike) >= 18 and sum(not near(4)(slow_fingerprint(texts[a]), slow_fingerprint(texts[b])) for a, b in alike) >= 9
    for order in (rows, rows[::-1]):
        assert sorted(r.doc_id for r in sh.keep_one(documents(order)).collect()) == list(range(6))


def test_links_are_the_same_in_any_order(spark):
    rng = random.Random(6)
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in family(rng, 400, 5))
    links = lambda rows: sorted(tuple(r) for r in sh.fingerprint_links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect())
    assert links(signed) == links(signed[::-1]) == links(rng.sample(signed, len(signed)))


@pytest.mark.parametrize("most", [2, 5, 1000])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_buckets_over_batches_hold_every_run_of_several(most, size):
    random = np.random.default_rng(6)
    keys, texts = np.sort(random.integers(-40, 40, 200)), np.arange(200)
    batches = (pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(texts[i : i + size])], ["h", "text"]) for i in range(0, 200, size))
    got = [r for batch in sh._buckets(most)(batches) for r in batch.to_pylist()]
    runs = [texts[keys == k].tolist() for k in np.unique(keys)]
    whole, cut = {}, {}
    for r in got:
        (whole if r["whole"] else cut).setdefault(r["bucket"], []).append(r["text"])
    assert sorted(whole.values()) == sorted(x for x in runs if 1 < len(x) <= most)
    assert sorted(cut.values()) == sorted(x for x in runs if len(x) > most)
    assert all(keys[x[0]] == k for k, x in cut.items())
