"""Quality classifier: naive Bayes support vectors (NBSVM).

A document is the set of its n-grams: word n-grams (one and two words) and
n-grams of word shapes (one to three; runs of letters collapse, symbols stay, a
word equal to the one before becomes ``=``), hashed into ``BUCKETS`` features.
Indicators are scaled by the log-count ratio of the classes, normalised to unit
length, and a linear hinge-loss model is fitted to them by dual coordinate
descent. A logistic curve, fitted on documents that the descent has not seen,
turns margins into scores from 0 to 1.

The model is fitted on a bounded sample: of the labelled rows that may be learnt
from, the ``sample_rows`` per class with the smallest hash of the id; rows above a
hash bound that the counts give are left out before anything is ordered, and
repeated labels count once. Only the sample is joined with texts (a broadcast of
bounded size), one text for each id, and their feature sets are written. Those go
to the driver in the order of the hashes, as many of each class as hold
``sample_features`` features together, so that very long texts bound the number of
rows and not the driver's memory.
Every document is scored in whole, in one pass without shuffle;
what is broadcast for it is one weight per bucket.

Defined results for odd input: null and empty texts have no n-gram and get the
score of the curve at margin 0 plus bias; rows whose quality is null or neither 0
nor 1 teach nothing; with labels of one class only the score is that class
(smoothed), with none it is 0.5; repeated rows score alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from rayloom.llm.common import materialise, working_tables

BUCKETS = 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Character classes of a shape: letters to a or A (all beyond ASCII is a letter), digits to 0.
_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
_RUNS = re.compile(rb"([aA0])\1+")


def _ngrams(tokens: np.ndarray, widths: tuple[int, ...], salt: int) -> list[np.ndarray]:
    """Hashes of the runs of so many tokens."""
    out = []
    for n in widths:
        if len(tokens) >= n:
            value = np.full(len(tokens) - n + 1, salt * 8 + n, np.uint64)
            for k in range(n):
                value = (value ^ tokens[k : len(tokens) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            out.append(value)
    return out


def features(text: bytes | None) -> np.ndarray:
    """The sorted feature numbers of a whole text."""
    if not text:
        return np.zeros(0, np.int32)
    words = text.translate(_LOWER).split()
    n = len(words)
    tokens = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    shapes = np.fromiter(map(zlib.crc32, _RUNS.sub(rb"\1", text.translate(_SHAPE)).split()), np.uint64, n)
    if n > 1:
        shapes[1:][tokens[1:] == tokens[:-1]] = zlib.crc32(b"=")
    found = [*_ngrams(tokens, (1, 2), 1), *_ngrams(shapes, (1, 2, 3), 2)]
    if not found:
        return np.zeros(0, np.int32)
    return np.unique((np.concatenate(found) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    """Weight per bucket, squared ratio per bucket (for the length), bias, and the curve."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float
    features: Callable[[bytes | None], np.ndarray] = features

    def margin(self, found: np.ndarray) -> float:
        length = float(self.squares[found].sum()) ** 0.5
        return float(self.weights[found].sum()) / length if length else 0.0

    def score(self, text: bytes | None) -> float:
        z = self.slope * self.margin(self.features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(sets: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, buckets: int = BUCKETS) -> np.ndarray:
    """log of the smoothed share of a feature among class 1 over that among class 0."""
    good, bad = np.full(buckets, alpha), np.full(buckets, alpha)
    for found, label in zip(sets, labels):
        (good if label else bad)[found] += 1
    n_good, n_bad = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    ratio = np.log(good / n_good) - np.log(bad / n_bad)
    ratio[(good == alpha) & (bad == alpha)] = 0.0
    return ratio


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, costs: np.ndarray, epochs: int, seed: int, buckets: int = BUCKETS) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent (unit rows)."""
    weights, alpha = np.zeros(buckets), np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, value = rows[i]
            if not len(at):
                continue
            gradient = signs[i] * float(weights[at] @ value) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), costs[i])
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * signs[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps on smoothed labels."""
    n_good, n_bad = labels.sum(), len(labels) - labels.sum()
    wanted = np.where(labels == 1, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    theta = np.array([1.0, 0.0])
    x = np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - wanted) + 1e-6 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def fit_sets(
    sets: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7, features: Callable = features, buckets: int = BUCKETS
) -> Model:
    zeros = np.zeros(buckets)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(zeros, zeros, 0.0, float(np.log(share / (1 - share))), features)
    held = np.arange(len(sets)) % 5 == 4 if len(sets) >= 50 else np.zeros(len(sets), bool)
    if any(len(set(labels[m].tolist())) < 2 for m in (held, ~held)):
        held[:] = False
    learn = np.flatnonzero(~held)
    ratio = log_count_ratios([sets[i] for i in learn], labels[learn], buckets=buckets)
    rows = []
    for i in learn:
        value = ratio[sets[i]]
        length = np.sqrt(value @ value)
        rows.append((sets[i], value / length) if length else (sets[i][:0], value[:0]))
    share = labels[learn].mean()
    costs = np.where(labels[learn] == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    weights = dual_descent(rows, labels[learn] * 2.0 - 1.0, costs, epochs, seed, buckets)
    model = Model(weights * ratio, ratio * ratio, 1.0, 0.0, features)
    curve = np.flatnonzero(held) if held.any() else learn
    margins = np.array([model.margin(sets[i]) for i in curve])
    model.slope, model.offset = logistic_curve(margins, labels[curve])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    sample_rows: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    features: Callable[[bytes | None], np.ndarray] = features,
    buckets: int = BUCKETS,
    sample_features: int = 24_000_000,
) -> Model:
    """Fits on at most ``sample_rows`` labelled rows of each class, with ``sample_features`` features in all.

    ``may_learn`` is a condition on ``labels``. The order is by a hash of the id,
    so the sample is the same in every run. Of documents that share an id the one
    whose text has the smallest hash is learnt. ``features`` gives the sorted feature
    numbers, below ``buckets``, of a text.
    """
    own = labels.filter(may_learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.lit("nbsvm"), id_col).alias("place")
    )
    different = {r.label: r.n for r in own.groupBy("label").agg(F.approx_count_distinct("place").alias("n")).collect()}
    parts = []
    for label in (0, 1):
        # more than are wanted lie below the bound, so that the sample is full but for rare cases
        share = min(1.0, 1.2 * (sample_rows + 200) / max(1, different.get(label, 1)))
        low = own.filter((F.col("label") == label) & (F.col("place") <= int(-(2**63) + share * (2**64 - 1025))))
        parts.append(low.dropDuplicates().orderBy("place", "label_id").limit(sample_rows))
    chosen = F.broadcast(parts[0].union(parts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [features(text).tolist() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sets, pa.list_(pa.int32()))], ["place", "label", "features"]
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    matched = texts.join(chosen, F.col("doc_id") == F.col("label_id")).groupBy("place", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with working_tables(docs.sparkSession):
        found = materialise(matched.mapInArrow(run, "place long, label int, features array<int>"), "nbsvm")
        sizes = found.select("place", "label", F.size("features").alias("n")).toArrow().to_pandas().sort_values(["place", "label"])
        within = sizes[sizes.groupby("label")["n"].cumsum() <= sample_features // 2]
        last = {label: int(within[within["label"] == label]["place"].max()) for label in set(within["label"])}
        kept = F.lit(False)
        for label, place in last.items():
            kept = kept | ((F.col("label") == label) & (F.col("place") <= place))
        rows = found.filter(kept).toArrow().sort_by([("place", "ascending"), ("label", "ascending")])
    lists = rows.column("features").combine_chunks()
    sets = [x.values.to_numpy() for x in lists] if len(rows) else []
    return fit_sets(sets, rows.column("label").to_numpy().astype(np.int64), features=features, buckets=buckets)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score), and the columns ``carry`` names in a struct ``row``, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.struct(*carry).alias("row")] if carry else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            scores = pa.array([fitted.score(text) for text in batch.column(1).to_pylist()], pa.float64())
            columns = [batch.column(0), scores, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", *["row"] * bool(carry)])

    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *narrow.schema.fields[2:]])
    return narrow.mapInArrow(run, schema)
