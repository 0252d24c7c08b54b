import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayloom.llm import quality_nbsvm as nb
from rayloom.llm.common import id_fold


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        body = [word() for _ in range(rng.randint(3, 120))]
        good = rng.random() < 0.7
        if not good:
            body = rng.choice([[w + "%%%" for w in body], [body[0]] * len(body), [w.upper() + "!!" for w in body]])
        rows.append((i, " ".join(body)))
        labels.append((i, int(good), 0))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(900)
    docs, own = documents(rows), labels_of(spark, labels)
    model = nb.fit(docs, own, ~id_fold("doc_id", 4, 2))
    scored = nb.score(docs, model).join(own, "doc_id").filter(id_fold("doc_id", 4, 2)).collect()
    assert len(scored) > 150
    assert np.mean([(r.score >= 0.7) == bool(r.quality) for r in scored]) > 0.97
    again = nb.fit(docs.repartition(6), own.repartition(3), ~id_fold("doc_id", 4, 2))
    assert np.allclose(again.weights, model.weights) and again.offset == pytest.approx(model.offset)


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, 1 - q if held else q, t) for (i, q, t), held in zip(labels, held_out(spark, labels))]
    a = nb.fit(documents(rows), labels_of(spark, labels), ~id_fold("doc_id", 4, 2))
    b = nb.fit(documents(rows), labels_of(spark, flipped), ~id_fold("doc_id", 4, 2))
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset


def held_out(spark, labels):
    return [r[0] for r in labels_of(spark, labels).orderBy("doc_id").select(id_fold("doc_id", 4, 2)).collect()]


def test_sample_is_bounded(spark, documents):
    rows, labels = corpus(200)
    seen = []
    keep, nb.fit_sets = nb.fit_sets, lambda sets, labels, **k: seen.append(labels) or keep(sets, labels, **k)
    try:
        nb.fit(documents(rows), labels_of(spark, labels), F.lit(True), sample_rows=20)
    finally:
        nb.fit_sets = keep
    assert sorted(seen[0].tolist()) == [0] * 20 + [1] * 20


def test_repeated_ids_reach_the_driver_once(spark, documents):
    rows, labels = corpus(60)
    seen = []
    keep, nb.fit_sets = nb.fit_sets, lambda sets, labels, **k: seen.append(len(sets)) or keep(sets, labels, **k)
    try:
        nb.fit(documents(rows + [(3, "the same id again")] * 5000 + rows * 3), labels_of(spark, labels * 50), F.lit(True), sample_rows=40)
    finally:
        nb.fit_sets = keep
    assert seen == [min(40, sum(x[1] for x in labels)) + min(40, sum(1 - x[1] for x in labels))]


def slow_features(text):
    """Word and shape n-grams as tuples, with no hashing into buckets."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shape = lambda w: re.sub(r"([aA0])\1+", r"\1", "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else "0" if c.isdigit() else c for c in w))
    shapes = [shape(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    shapes = [s if i == 0 or words[i] != words[i - 1] else "=" for i, s in enumerate(shapes)]
    out = {("w", *words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}
    return out | {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def test_scores_follow_a_plain_nbsvm(spark, documents):
    """A model over tuples, fitted by projected gradient steps on the dual, agrees with the operator on nearly all documents."""
    rows, labels = corpus(240, 4)
    model = nb.fit(documents(rows), labels_of(spark, labels), F.lit(True))
    got = {r.doc_id: r.score for r in nb.score(documents(rows), model).collect()}
    sets, y = [slow_features(t) for _, t in rows], np.array([x[1] for x in labels])
    names = {f: k for k, f in enumerate(sorted(set().union(*sets), key=repr))}
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
    assert np.mean((margin > 0) == (scores > 0.5)) > 0.98
    assert np.corrcoef(margin, np.log(scores / (1 - scores)))[0, 1] > 0.97


def test_dual_descent_reaches_the_optimum():
    """The duality gap closes on a small dense problem."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    signs = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    rows = [(np.arange(6), r) for r in x]
    w = nb.dual_descent(rows, signs, np.ones(40), 3000, 1)[:6]
    primal = 0.5 * w @ w + np.maximum(0, 1 - signs * (x @ w)).sum()
    better = min(0.5 * v @ v + np.maximum(0, 1 - signs * (x @ v)).sum() for v in (w + 0.02 * rng.normal(size=6) for _ in range(500)))
    assert primal <= better + 1e-3


@pytest.mark.parametrize("labels, least, most", [([], 0.5, 0.5), ([(3, 1, 0), (4, 1, 0)], 0.7, 1.0), ([(3, 0, 0)], 0.0, 0.3), ([(3, None, 0), (4, 7, 0), (None, 1, 0)], 0.5, 0.5)])
def test_few_labels(spark, odd, labels, least, most):
    from .conftest import ODD

    model = nb.fit(odd, labels_of(spark, labels), ~id_fold("doc_id", 4, 2))
    scores = [r.score for r in nb.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(least <= s <= most for s in scores)


def test_odd_rows_and_columns(spark, odd, no_documents, documents):
    rows, labels = corpus(200)
    model = nb.fit(documents(rows), labels_of(spark, labels), F.lit(True))
    out = nb.score(odd, model, carry=tuple(odd.columns))
    assert out.select("row.*").columns == odd.columns
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert nb.score(no_documents, model).count() == 0
    assert nb.fit(no_documents, labels_of(spark, labels), F.lit(True)).slope == 0
