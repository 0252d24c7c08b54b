"""Exact top-k search by inner product over an impact-ordered index.

Queries go to the candidates: they are broadcast in batches of bounded bytes, and
each task streams its own candidates in blocks, which never move. A block sorts
the postings of every dimension by quantised value into segments and answers the
queries score at a time: segments come in descending order of the impact they
can have on the query's score, whatever dimension they belong to. After each
round every candidate has an upper bound (what it has gathered plus the most
that its unseen dimensions can still give). The scan of a block ends only when
those bounds prove that all but a few candidates are out; the possible members
are then rescored exactly. A task carries each query's best from block to block
as the threshold to beat, and sends on its best ``k`` only; one window merges
the tasks.

A first pass answers the queries over about one row in ``sample`` and so proves a
score that each query's ``k`` best reach. Tasks begin with it and send nothing
below, so that what meets in the window of a query is about ``sample * k`` rows,
however many tasks there are. The result is exact with any sample.

Scores are exact at any size. Vectors whose components could take a sum beyond
2**50 are kept out of the index and scored in integers of any width.

Defined results for odd input
-----------------------------
* vectors that are null, or hold a null or non-finite component, and rows with
  a null id take no part;
* vectors of different length: missing trailing components count as 0;
* repeated rows (same id, same vector) count once; rows that share the query's
  id are the query's own; one id with several vectors can appear once per score;
* a score among the best that is no 64-bit number is an error that names it;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

RESULT = "query_id long, vec_id long, score long"
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x), a whole number held as double, for each component of every vector that takes part."""
    x = lambda c: c.cast("double")
    whole = F.transform(vec_col, lambda c: F.when(F.abs(x(c)) < 2.0**50, F.floor(x(c) * scale).cast("double")).otherwise(x(c) * scale))
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c) * scale) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    block_rows: int = 8192,
    query_bytes: int = 64_000_000,
    levels: int = 32,
    sample: int = 64,
) -> DataFrame:
    """The ``k`` best candidates of each query row, ties to the smaller id.

    ``is_query`` is a condition on the id column. ``block_rows`` bounds what a
    task indexes at a time, ``query_bytes`` what is broadcast: more queries make
    more passes over the candidates. ``levels`` is the number of quantised
    impacts per dimension.
    """
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    queries = rows.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    held = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    batches = max(1, math.ceil(held / query_bytes))
    some = rows.sample(1 / sample, seed=1).repartition(F.rand(2))
    found = []
    for number in range(batches):
        own = _matrix(queries.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == number).distinct().toArrow())
        best = _pass(rows, own, k, block_rows, levels, _reached(_pass(some, own, k, block_rows, levels, {}), k))
        found.append(materialise(best, "topk") if batches > 1 else best)
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    return _merged(best, k)


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query of what its tasks have sent."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score").dropDuplicates()


def _reached(best: DataFrame, k: int) -> dict[int, int]:
    """The least of each query's ``k`` best scores, where there are as many; one number per query of a batch."""
    full = _merged(best, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    rows = full.select("query_id", "score").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def _pass(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, block_rows: int, levels: int, reached: dict[int, int]) -> DataFrame:
    """Each task's best ``k`` of every query of one batch that are not below what the query has ``reached``."""
    shared = rows.sparkSession.sparkContext.broadcast((*queries, k, levels, reached))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, n = Search(*shared.value), [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= block_rows:
                search.add(*_matrix(pa.Table.from_batches(held)))
                held, n = [], 0
        if held:
            search.add(*_matrix(pa.Table.from_batches(held)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.best()], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, RESULT)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and one row of whole doubles for each distinct (id, vector), by id."""
    ids = rows.column("id").to_numpy().astype(np.int64)
    if len(ids) == 0:
        return ids, np.zeros((0, 0))
    lists = pa.concat_arrays(rows.column("v").chunks)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ids), max(1, lengths.max())))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    order = np.lexsort((*out.T[::-1], ids))
    ids, out = ids[order], out[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (out[1:] != out[:-1]).any(axis=1)
    return ids[new], out[new]


def _plain(vectors: np.ndarray) -> np.ndarray:
    """Which rows are small enough for sums of products to be exact as doubles."""
    if not vectors.size:
        return np.ones(len(vectors), bool)
    return np.abs(vectors).max(axis=1) <= math.isqrt(2**50 // vectors.shape[1])


class Search:
    """The best ``k`` of every query over the blocks seen so far, from the score on that it has ``reached`` elsewhere."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, levels: int, reached: dict[int, int]):
        self.ids, self.queries, self.k, self.levels = ids, queries, k, levels
        self.reached = [reached.get(int(i)) for i in ids]
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        dims = max(vectors.shape[1], self.queries.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
        vectors, queries = wide(vectors), wide(self.queries)
        plain, plain_queries = _plain(vectors), _plain(queries)
        index = ImpactIndex(vectors[plain], self.levels) if plain.any() else None
        inside, outside = ids[plain], ids[~plain]
        repeated = inside if len(np.unique(inside)) < len(inside) else None
        for at, (own, query) in enumerate(zip(self.ids, queries)):
            if not plain_queries[at]:
                self._take(at, ids, _exact_scores(vectors, query))
                continue
            if index:
                best, reached = self.held[at][1], self.reached[at]
                known = [int(best[-1])] if len(best) == self.k else []
                known += [] if reached is None else [reached]
                beat = float(max(known)) if known and abs(max(known)) < 2**53 else None
                members, scores = index.search(query, inside != own, self.k, beat, repeated)
                self._take(at, inside[members], scores.astype(np.int64))
            if len(outside):
                self._take(at, outside, _exact_scores(vectors[~plain], query))

    def _take(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges a query's candidates into its best, each (id, score) once."""
        others = ids != self.ids[at]
        if self.reached[at] is not None:
            others &= (scores >= self.reached[at]).astype(bool)
        ids, scores = np.concatenate([self.held[at][0], ids[others]]), np.concatenate([self.held[at][1], scores[others]])
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)
        ids, scores = ids[order], scores[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        ids, scores = ids[new][: self.k], scores[new][: self.k]
        for i, score in zip(ids, scores) if scores.dtype == object else ():
            if not -(2**63) < score < 2**63:
                raise ValueError(f"the score of query {self.ids[at]} and vector {i} is no 64-bit number: {score}")
        self.held[at] = ids, scores.astype(np.int64)

    def best(self) -> Hits:
        counts = [len(ids) for ids, _ in self.held]
        joined = lambda n: np.concatenate([np.zeros(0, np.int64), *[x[n] for x in self.held]])
        return np.repeat(self.ids, counts), joined(0), joined(1)


def _exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles of any size, as Python integers."""
    own = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(v, own) if a and b) for v in vectors] + [None], object)[:-1]


class ImpactIndex:
    """Postings of a block, each dimension cut into segments of equal quantised value."""

    #: Shares of the postings after which the bounds are looked at.
    ROUNDS = (0.15, 0.3, 0.5, 0.75, 1.0)

    def __init__(self, vectors: np.ndarray, levels: int):
        n, self.dims = vectors.shape
        self.vectors = vectors
        self.postings = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        dim, start, end, low, high = [], [], [], [], []
        for d in range(self.dims):
            values = vectors[self.postings[d], d]
            width = (values[-1] - values[0]) // levels + 1
            level = (values - values[0]) // width
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [n]])
            dim += [d] * (len(cuts) - 1)
            start += cuts[:-1].tolist()
            end += cuts[1:].tolist()
            low += values[cuts[:-1]].tolist()
            high += values[cuts[1:] - 1].tolist()
        self.dim, self.start, self.end = np.array(dim), np.array(start), np.array(end)
        self.low, self.high = np.array(low), np.array(high)
        self.first = np.searchsorted(self.dim, np.arange(self.dims))
        self.size = self.end - self.start

    def search(
        self, query: np.ndarray, allowed: np.ndarray, k: int, beat: float | None = None, ids: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers that hold the best ``k`` of the allowed rows that reach ``beat``, with exact scores.

        ``ids`` is needed where ids repeat: rows of one id may count once only, so
        they prove no threshold together.
        """
        n, positive = len(self.vectors), query[self.dim] >= 0
        q = query[self.dim]
        most = np.where(positive, q * self.high, q * self.low)
        least = np.where(positive, q * self.low, q * self.high)
        floor = np.minimum.reduceat(least, self.first) if self.dims else least
        impact = most - floor[self.dim]
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.size[order])
        gathered, seen = np.zeros(n), np.zeros(n, np.int64)
        base, threshold, at = float(floor.sum()), beat, 0
        possible = np.flatnonzero(allowed)
        for share in self.ROUNDS:
            upto = int(np.searchsorted(done, share * n * self.dims, side="left")) + 1
            segments = order[at:upto]
            at = max(at, min(upto, len(order)))
            if len(segments):
                rows = np.concatenate(
                    [self.postings[d, a:b] for d, a, b in zip(self.dim[segments], self.start[segments], self.end[segments])]
                )
                gathered += np.bincount(rows, np.repeat(impact[segments], self.size[segments]), n)
                seen += np.bincount(rows, minlength=n)
            rest = float(impact[order[at]]) if at < len(order) else 0.0
            bound = base + gathered + (self.dims - seen) * rest
            if len(possible) > k:
                likely = possible[np.argpartition(-gathered[possible], k - 1)[:k]]
                if ids is None or len(np.unique(ids[likely])) == k:
                    reached = float((self.vectors[likely] @ query).min())
                    threshold = reached if threshold is None else max(threshold, reached)
            if threshold is not None:
                possible = possible[bound[possible] >= threshold]
            if at >= len(order) or len(possible) <= max(4 * k, n // 32):
                break
        return possible, self.vectors[possible] @ query
