import random
import re

import pytest
from pyspark.sql import functions as F

from rayloom.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, bench, width=10):
    own, hit, items = words(text), set(), set()
    for item, item_text in bench:
        known = words(item_text)
        n = min(width, len(known))
        windows = {tuple(known[i : i + n]) for i in range(len(known) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                items.add(item)
    return len(own), len(hit), sorted(str(i) for i in items if i is not None)


def tables(spark, documents, rows, bench):
    return documents(rows), spark.createDataFrame(bench, "item_id long, text string")


def found(df):
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit for r in df.collect())
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "Dé", "x1"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(12)]
    bench = [b for b in bench if len(b[1].split()) not in (1,)] + [(3, "repeated id with some other words in it as well here"), (None, "no id but words that are long enough to be one window at least"), (50, None)]
    rows = []
    for i in range(80):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            own[rng.randint(0, len(own)) :] = (rng.choice(bench)[1] or "").upper().split()
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(own)))
    return rows + [(900, bench[-2][1] + "! repeated id with some other words in it as well here")], bench


@pytest.mark.parametrize("seed, limit", [(1, 2_000_000), (2, 2_000_000), (3, 60), (1, 20)])
def test_equals_brute_force(spark, documents, seed, limit):
    rows, bench = corpus(seed)
    docs, items = tables(spark, documents, rows, bench)
    assert found(dc.scan(docs, items, max_broadcast_words=limit)) == sorted(((i, *slow(t, bench)) for i, t in rows), key=repr)
    kept = dc.drop_contaminated(docs, items, max_broadcast_words=limit)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if not slow(t, bench)[1]]


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_remove_spans(spark, documents, limit):
    bench = [(1, "one two three four five six seven eight nine ten"), (2, "Ten, eleven ünï thirteen")]
    rows = [(1, "Start. One two THREE four five six seven eight nine ten, eleven ünï thirteen! end"), (2, "clean ten eleven"), (3, None), (4, "")]
    docs, items = tables(spark, documents, rows, bench)
    out = dc.remove_spans(docs, items, max_broadcast_words=limit)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Start. ! end", 2: "clean ten eleven", 3: None, 4: ""}


def test_odd_rows(spark, odd, no_documents):
    from .conftest import ODD

    bench = [(7, "the same text in two rows"), (8, None), (9, "")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert found(dc.scan(odd, items)) == sorted(((r[0], *slow(r[1], bench)) for r in ODD), key=repr)
    assert found(dc.scan(no_documents, items)) == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 for r in found(dc.scan(odd, empty)))
    assert dc.drop_contaminated(odd, empty).count() == len(ODD)


def test_digest(spark):
    import hashlib

    row = spark.createDataFrame([(["1", "10", "2"],), ([],)], "items array<string>").select(dc.items_digest(F.col("items"))).collect()
    assert [r[0] for r in row] == [hashlib.sha256(b"1,10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]
