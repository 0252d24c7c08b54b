import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.llm import quality_nbsvm, toxicity as tx
from rayloom.llm.common import id_fold

BAD = ["blorgh", "snarfel", "quimby"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghéij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        body, toxic = [word() for _ in range(rng.randint(5, 150))], int(rng.random() < 0.2)
        for at in range(0, len(body), 25) if toxic else ():
            body[at] = rng.choice(BAD).title() if rng.random() < 0.3 else rng.choice(BAD)
        rows.append((i, " ".join(body)))
        labels.append((i, 1, toxic))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    framed = " " + " ".join(low.replace("\x0b", " ").replace("\x0c", " ").split()) + " "
    return {framed[i : i + n] for n in tx.WIDTHS for i in range(len(framed) - n + 1)}


def test_features_are_the_distinct_character_ngrams():
    rng = random.Random(2)
    for size in (1, 3, 10, 200, 3000):
        text = "".join(rng.choice("abcdE é日\n\t") for _ in range(size)) + "x"
        plain, found = slow_features(text), tx.features(text.encode())
        assert len(plain) - len(plain) // 100 - 2 <= len(found) <= len(plain) and (np.diff(found) > 0).all() and found.max(initial=0) < tx.BUCKETS
    assert len(tx.features(None)) == len(tx.features(b"")) == len(tx.features(b" \n ")) == 0
    assert len(tx.features(b"\xff\xfe bad")) > 0
    assert (tx.features(b"A b\n c") == tx.features(b" a  B\tc ")).all()


def test_pieces_of_a_long_text_lose_no_ngram(monkeypatch):
    text = ("the quick brown fox é " * 30 + "idle").encode()
    whole = tx.features(text)
    monkeypatch.setattr(tx, "_PIECE", 17)
    assert (tx.features(text) == whole).all()


def test_held_out_accuracy_and_same_model_again(spark, documents):
    rows, labels = corpus(700)
    docs, own = documents(rows), labels_of(spark, labels)
    model = tx.fit(docs, own, ~id_fold("doc_id", 5, 0))
    scored = tx.score(docs, model).join(own, "doc_id").filter(id_fold("doc_id", 5, 0)).collect()
    assert len(scored) > 100
    assert all((r.score >= 0.5) == bool(r.toxic) for r in scored)
    again = tx.fit(docs.repartition(6), own.repartition(3), ~id_fold("doc_id", 5, 0))
    assert np.allclose(again.weights, model.weights) and again.offset == pytest.approx(model.offset)


def test_scores_follow_a_plain_model(spark, documents):
    """A model over n-grams as strings, fitted by projected gradient steps on the dual, orders documents as the operator does."""
    rows, labels = corpus(160, 4)
    model = tx.fit(documents(rows), labels_of(spark, labels), F.lit(True))
    got = {r.doc_id: r.score for r in tx.score(documents(rows), model).collect()}
    sets, y = [slow_features(t) for _, t in rows], np.array([x[2] for x in labels])
    names = {f: k for k, f in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(rows), len(names)))
    for i, s in enumerate(sets):
        x[i, [names[f] for f in s]] = 1
    ratio = np.log((1 + x[y == 1].sum(0)) / y.sum()) - np.log((1 + x[y == 0].sum(0)) / (1 - y).sum())
    z = x * ratio
    z /= np.linalg.norm(z, axis=1)[:, None]
    signs, cost = y * 2.0 - 1, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    alpha, gram = np.zeros(len(y)), (z * signs[:, None]) @ (z * signs[:, None]).T
    for _ in range(4000):
        alpha = np.clip(alpha - 0.02 * (gram @ alpha - 1), 0, cost)
    margin = z @ (z.T @ (alpha * signs))
    scores = np.array([got[i] for i, _ in rows])
    assert np.mean((margin > 0) == (scores > 0.5)) > 0.97


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels = corpus(200)
    docs = documents(rows)
    held = [r[0] for r in labels_of(spark, labels).orderBy("doc_id").select(id_fold("doc_id", 5, 0)).collect()]
    flipped = [(i, q, 1 - t if h else t) for (i, q, t), h in zip(labels, held)]
    a, b = (tx.fit(docs, labels_of(spark, x), ~id_fold("doc_id", 5, 0)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset


def test_features_bound_the_sample(spark, documents):
    rows, labels = corpus(200)
    seen = []
    keep, quality_nbsvm.fit_sets = quality_nbsvm.fit_sets, lambda sets, labels, **k: seen.append(sets) or keep(sets, labels, **k)
    try:
        tx.fit(documents(rows), labels_of(spark, labels), F.lit(True), sample_features=40_000)
        tx.fit(documents(rows), labels_of(spark, labels), F.lit(True), sample_features=0)
    finally:
        quality_nbsvm.fit_sets = keep
    assert 20_000 < sum(map(len, seen[0])) <= 40_000 and seen[1] == []


@pytest.mark.parametrize("labels, least, most", [([], 0.5, 0.5), ([(3, 1, 1), (4, 0, 1)], 0.7, 1.0), ([(3, 0, 0)], 0.0, 0.3), ([(3, 0, None), (4, 0, 7), (None, 0, 1)], 0.5, 0.5)])
def test_few_labels(spark, odd, labels, least, most):
    from .conftest import ODD

    model = tx.fit(odd, labels_of(spark, labels), ~id_fold("doc_id", 5, 0))
    scores = [r.score for r in tx.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(least <= s <= most for s in scores)


def test_odd_rows_and_columns(spark, odd, no_documents, documents):
    rows, labels = corpus(200)
    model = tx.fit(documents(rows), labels_of(spark, labels), F.lit(True))
    scored = {(r.row.doc_id, r.row.text): r.score for r in tx.score(odd, model, carry=tuple(odd.columns)).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and scored[(0, None)] == scored[(1, "")] == scored[(2, " \n\t ")]
    assert tx.score(no_documents, model).count() == 0
    assert tx.fit(no_documents, labels_of(spark, labels), F.lit(True)).slope == 0
