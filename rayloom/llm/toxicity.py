"""Toxicity classifier: a linear model over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its character n-grams (``WIDTHS`` characters, over the
whole text): A-Z are lower-cased, each run of white space becomes one blank, and
the text is framed by blanks, so that an n-gram knows whether it begins or ends a
word. N-grams are hashed into ``BUCKETS`` features. Their indicators are scaled by
the log-count ratio of the classes, normalised to unit length, and a linear
hinge-loss model is fitted, as for quality (``quality_nbsvm.fit``): on a bounded
sample of labelled rows, the same in every run, with a logistic curve from margins
to scores. The classes are balanced in the sample, so 0.5 is where both fit alike,
however rare toxic text is.

Every document is scored in whole, in one pass without shuffle; what is broadcast
for it is two numbers per bucket.

Defined results for odd input: null and empty texts have no n-gram and get the
score of the curve at margin 0 plus bias; rows whose label is null or neither 0
nor 1 teach nothing; with labels of one class only the score is that class
(smoothed), with none it is 0.5; repeated rows score alike; bytes that are no UTF-8
count as one replacement character each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame

from rayloom.llm import quality_nbsvm
from rayloom.llm.quality_nbsvm import Model

BUCKETS = 1 << 20
WIDTHS = (3, 4, 5)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
#: Characters of a text that are hashed at a time; pieces overlap by the widest n-gram less one.
_PIECE = 1 << 20


def features(text: bytes | None) -> np.ndarray:
    """The sorted feature numbers of a whole text."""
    if not text or not (text := text.strip(b" \t\n\v\f\r")):
        return np.zeros(0, np.int32)
    framed = b" " + _BLANKS.sub(b" ", text.translate(_LOWER)) + b" "
    points = np.frombuffer(framed.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    found = [_hashes(points[at : at + _PIECE + WIDTHS[-1] - 1]) for at in range(0, len(points), _PIECE)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _hashes(points: np.ndarray) -> np.ndarray:
    """The feature numbers of the n-grams in a run of code points."""
    mixed, out = np.zeros(len(points), np.uint64), []
    for n in range(1, WIDTHS[-1] + 1):
        mixed = mixed[: len(points) - n + 1]
        if not len(mixed):
            break
        mixed = (mixed ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in WIDTHS:
            out.append(((mixed + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = 2000, label_col: str = "toxic", **options) -> Model:
    """Fits on at most ``sample_rows`` rows of ``labels`` per class for which ``may_learn`` holds; options as in ``quality_nbsvm.fit``."""
    return quality_nbsvm.fit(docs, labels, may_learn, sample_rows, label_col=label_col, features=features, buckets=BUCKETS, **options)


def score(docs: DataFrame, model: Model, **options) -> DataFrame:
    """(doc_id, score) for every document; options as in ``quality_nbsvm.score``."""
    return quality_nbsvm.score(docs, model, **options)
