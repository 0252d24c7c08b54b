"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

The scores are the product of the anchors' matrix and the transposed matrix of all
rows. Both are sharded: rows by a hash of the id into blocks, components into
chunks. Tasks form a grid: a task gets the blocks of one band of anchors and of one
group of rows, multiplies a block of each chunk by chunk and adds the partial int64
tiles where they are. So what is shuffled are the panels of both sides (rows once per
band, anchors once per group), never scores, and a task holds one tile at a time.

The product is taken twice: once for each anchor's positives (the best rows of its
label), and, once those are known, for the best negatives in the window of scores
that each positive opens. Both times a task keeps the best of all its tiles and sends
on only those.

Anchors go in batches of at most ``batch_anchors``: that bounds how often the rows
are sent (once per band of a batch) and what is broadcast (the positives of one batch).

Defined results for odd input
-----------------------------
* rows with a null id, label or vector, or a null or non-finite component (before
  or after scaling) take no part;
* vectors of different length: missing trailing components count as 0;
* of rows that share an id the one with the least (label, vector) takes part, so
  repeated rows count once;
* an anchor without another row of its label has no positive and gives no rows; a
  positive whose window holds no row of another label gives none either;
* scores are exact at any size: tiles whose sums could pass 2**62 hold Python
  integers; a score among a task's best that is no 64-bit number is an error that
  names it;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

TILE = "anchor_block int, row_block int, anchors binary, anchor_labels binary, ids binary, labels binary, tile binary"
BEST = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def labelled_vectors(rows: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v): v is floor(scale * x), a whole number held as double, for each component."""
    x = lambda c: c.cast("double")
    whole = F.transform(vec_col, lambda c: F.when(F.abs(x(c)) < 2.0**50, F.floor(x(c) * scale).cast("double")).otherwise(x(c) * scale))
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c) * scale) < F.lit(float("inf"))))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    own = kept.select(F.col(id_col).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), whole.alias("v")).alias("row"))
    return own.filter("row.label IS NOT NULL").groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = 2048,
    anchor_rows: int = 256,
    chunk_dims: int = 32,
    batch_anchors: int = 20_000,
    band_anchors: int = 4096,
    group_rows: int = 1 << 18,
) -> DataFrame:
    """The best ``negatives`` of each anchor and positive.

    ``is_anchor`` is a condition on the id column, ``label`` an expression over
    ``rows``. A negative has another label and a score from ``window[0]`` to
    ``window[1]`` hundredths of the positive's. Higher scores come first, ties by
    smaller id.
    """
    named = labelled_vectors(rows, id_col, label, vec_col, scale).withColumnRenamed("id", id_col)
    held = materialise(named.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))).withColumnRenamed(id_col, "id"), "negatives-rows")
    n, anchors, dims = held.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    chunks, batches = max(1, math.ceil((dims or 0) / chunk_dims)), max(1, math.ceil(anchors / batch_anchors))
    row_blocks, anchor_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(anchors / batches / anchor_rows))
    bands = min(anchor_blocks, max(1, math.ceil(anchors / batches / band_anchors)))
    # each group of rows sends its best, so there are no more than the tasks or the size of a task ask for
    asked = max(math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / bands), math.ceil(n / group_rows))
    grid = Grid(row_blocks, anchor_blocks, chunks, chunk_dims, bands, min(row_blocks, asked))
    found = []
    for batch in range(batches):
        own = held.filter(F.col("is_anchor") & (F.pmod(F.xxhash64(F.lit("batch"), "id"), F.lit(batches)) == batch))
        best = materialise(top_positives(held, own, grid, positives), "negatives-positives")
        best_negatives = top_negatives(held, own, grid, best, negatives, window)
        found.append(materialise(best_negatives, "negatives-batch") if batches > 1 else best_negatives)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@dataclass(frozen=True)
class Grid:
    """How both sides are cut into blocks and chunks, and blocks dealt to tasks: ``bands`` of anchors times ``groups`` of rows."""

    row_blocks: int
    anchor_blocks: int
    chunks: int
    chunk_dims: int
    bands: int
    groups: int


def through_tiles(rows: DataFrame, anchors: DataFrame, grid: Grid, function: Callable, schema: str) -> DataFrame:
    """``function(tiles)`` gives, as record batches, the rows of a task from all of its tiles; see ``_tiles``."""

    def panel(side: DataFrame, anchor: bool) -> DataFrame:
        """The blocks of one side, cut into chunks, sent to every task of their band or group."""
        blocks, parts, copies = (grid.anchor_blocks, grid.bands, grid.groups) if anchor else (grid.row_blocks, grid.groups, grid.bands)
        dealt = side.select(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "v")
        sent = dealt.select("*", F.pmod("block", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("other"))
        cell = F.col("part") * grid.groups + F.col("other") if anchor else F.col("other") * grid.groups + F.col("part")
        cut = sent.select(cell.cast("int").alias("cell"), F.lit(not anchor).alias("is_row"), "block", "id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(grid.chunks - 1))).alias("chunk"))
        return cut.select("cell", "is_row", "block", "chunk", "id", "label", F.slice("v", F.col("chunk") * grid.chunk_dims + 1, F.lit(grid.chunk_dims)).alias("part"))

    panels = panel(anchors, True).union(panel(rows, False)).repartitionById(grid.bands * grid.groups, F.col("cell"))
    ordered = panels.sortWithinPartitions("is_row", "block", "chunk", "id").drop("cell")
    return ordered.mapInArrow(lambda batches: function(_tiles(batches, grid.chunks)), schema)


def score_tiles(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, chunks: int, chunk_dims: int) -> DataFrame:
    """One row per anchor block and row block: ids and labels of both sides and the summed scores."""

    def run(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor_block", pa.int32()), ("row_block", pa.int32()), *((n, pa.binary()) for n in ("anchors", "anchor_labels", "ids", "labels", "tile"))])
        for anchor_block, row_block, *cells, scores in tiles:
            narrow = scores.dtype != object and np.abs(scores).max(initial=0) < 2**31
            values = [anchor_block, row_block, *(x.tobytes() for x in cells), _pack(scores, np.int32 if narrow else np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return through_tiles(rows, anchors, Grid(row_blocks, anchor_blocks, chunks, chunk_dims, anchor_blocks, row_blocks), run, TILE)


def _matrix(parts: pa.ChunkedArray) -> np.ndarray:
    """One row of whole doubles per list; missing trailing components are 0."""
    lists = parts.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(1, lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def product(left: np.ndarray, right: np.ndarray, chunks: int) -> np.ndarray:
    """left @ right.T of whole doubles, exactly: int64 where the sum over all chunks of this size fits, else Python integers."""
    dims = max(left.shape[1], right.shape[1])
    left, right = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (left, right))
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * dims
    if most < 2**53 and most * chunks < 2**62:
        return (left @ right.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()] + [None], object)[:-1]
    left, right = (np.stack(whole(m)) if len(m) else np.zeros((0, dims), object) for m in (left, right))
    exact = left.astype(object) @ right.astype(object).T
    return exact.astype(np.int64) if most * chunks < 2**62 else exact


def _pack(tile: np.ndarray, dtype: type = np.int64) -> bytes:
    if tile.dtype == object:
        return b"w" + pickle.dumps(tile.tolist())
    return np.dtype(dtype).char.encode() + tile.astype(dtype).tobytes()


def _unpack(cell: bytes, shape: tuple[int, int]) -> np.ndarray:
    if cell[:1] == b"w":
        return np.array(pickle.loads(cell[1:]), object).reshape(shape)
    return np.frombuffer(cell, cell[:1].decode(), offset=1).astype(np.int64, copy=False).reshape(shape)


def _panels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(is_row, block, chunk, ids, labels, matrix) of each panel; rows come in this order."""
    last, held = None, []

    def whole() -> tuple:
        rows = pa.Table.from_batches(held)
        return (*last, rows.column("id").to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(np.int64), _matrix(rows.column("part")))

    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("is_row", "block", "chunk")])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for start, stop in zip([0, *cuts], [*cuts, len(batch)]):
            if start == stop:
                continue
            if held and tuple(keys[:, start]) != last:
                yield whole()
                held = []
            last = tuple(keys[:, start].tolist())
            held.append(batch.slice(start, stop - start))
    if held:
        yield whole()


def _tiles(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[tuple]:
    """Anchor block, row block, anchors, their labels, ids, labels and scores of each tile of a task.

    Anchors come first and are kept; the rows of one block are kept at a time.
    """
    anchors: dict[int, list] = {}
    rows: list = []

    def multiplied() -> Iterator[tuple]:
        block, ids, labels, right = rows
        for anchor_block, (_, own, own_labels, left) in anchors.items():
            total = sum((product(left[chunk], right[chunk], chunks) for chunk in sorted(left)), np.int64(0))
            yield anchor_block, block, own, own_labels, ids, labels, total

    for is_row, block, chunk, ids, labels, matrix in _panels(batches):
        if not is_row:
            anchors.setdefault(block, [block, ids, labels, {}])[3][chunk] = matrix
            continue
        if rows and rows[0] != block:
            yield from multiplied()
            rows = []
        rows = rows or [block, ids, labels, {}]
        rows[3][chunk] = matrix
    if rows:
        yield from multiplied()


#: Below every score of a tile of 64-bit numbers.
_NONE = -(2**62)


class Best:
    """The best ``k`` candidates of each of so many pairs seen so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, pairs: int):
        self.k = k
        self.pairs, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0
        # the k-th score of a pair that has so many: what is below needn't be kept
        self.least = np.full(pairs, _NONE)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray, mask: np.ndarray) -> None:
        """Candidates of the pairs from ``first`` on: a row of ``scores`` each, where ``mask`` is true."""
        if scores.dtype == object and self.least.dtype != object:
            self.least = np.array([-math.inf if x == _NONE else x for x in self.least.tolist()] + [None], object)[:-1]
        mask = mask & (scores >= self.least[first : first + len(scores), None])
        if scores.dtype != object and mask.sum(axis=1).max(initial=0) > 4 * self.k:
            # all that reach the k-th score of this tile, so that ties are decided by id
            kth = np.partition(np.where(mask, scores, _NONE), scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            mask &= scores >= kth[:, None]
        at, column = mask.nonzero()
        if len(at):
            self.waiting.append((at + first, ids[column], scores[at, column]))
            self.rows += len(at)
            if self.rows > max(4096, len(self.pairs)):
                self.settle()

    def settle(self) -> None:
        pairs, ids, scores = (np.concatenate(parts) for parts in zip((self.pairs, self.ids, self.scores), *self.waiting))
        self.waiting, self.rows = [], 0
        if scores.dtype != object:
            order = np.lexsort((ids, -scores, pairs))
        else:
            order = np.array(sorted(range(len(ids)), key=lambda i: (pairs[i], -scores[i], ids[i])), np.int64)
        pairs, ids, scores = pairs[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        place = np.arange(len(pairs)) - np.repeat(starts, np.diff(starts, append=len(pairs)))
        full = place == self.k - 1
        if scores.dtype == object and self.least.dtype != object:
            self.least = self.least.astype(object)
        self.least[pairs[full]] = scores[full]
        kept = place < self.k
        self.pairs, self.ids, self.scores = pairs[kept], ids[kept], scores[kept]

    def batches(self, anchors: np.ndarray, positives: list[list[tuple[int, int]]], named: str) -> Iterator[pa.RecordBatch]:
        """The rows of ``BEST``; pair p is anchor ``p % len(anchors)`` and its positive number ``p // len(anchors)``."""
        self.settle()
        for at in range(0, len(self.pairs), 10_000):
            rows = []
            for pair, other, score in zip(*(x[at : at + 10_000].tolist() for x in (self.pairs, self.ids, self.scores))):
                slot, i = divmod(pair, len(anchors))
                if abs(score) >= 2**63:
                    raise ValueError(f"the score of {named} {anchors[i]} and {other} is no 64-bit number: {score}")
                rows.append((int(anchors[i]), *positives[i][slot], other, score))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _whole(values: list[int]) -> np.ndarray:
    return np.array(values, np.int64) if all(abs(v) < 2**62 for v in values) else np.array([*values, None], object)[:-1]


def _merged(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_positives(rows: DataFrame, anchors: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best ``k`` other rows of its label."""

    def run(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, np.ndarray]] = {}
        for block, _, anchors, anchor_labels, ids, labels, scores in tiles:
            best, _ = held.setdefault(block, (Best(k, len(anchors)), anchors))
            best.add(0, ids, scores, (labels == anchor_labels[:, None]) & (ids != anchors[:, None]))
        for best, anchors in held.values():
            yield from best.batches(anchors, [[(0, 0)]] * len(anchors), "anchor")

    merged = _merged(through_tiles(rows, anchors, grid, run, BEST), k)
    return merged.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))


def top_negatives(rows: DataFrame, anchors: DataFrame, grid: Grid, positives: DataFrame, k: int, window: tuple[int, int]) -> DataFrame:
    """The best ``k`` rows of another label inside each positive's window.

    ``positives`` are those of one batch of anchors, so what is broadcast is bounded.
    """
    found = positives.select("anchor_id", "positive_id", "positive_score").toArrow()
    opened: dict[int, list[tuple[int, int]]] = {}
    for anchor, positive, score in zip(*(found.column(n).to_pylist() for n in found.column_names)):
        opened.setdefault(anchor, []).append((positive, score))
    shared = rows.sparkSession.sparkContext.broadcast(opened)
    low, high = window

    def run(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for block, _, anchors, anchor_labels, ids, labels, scores in tiles:
            if block not in held:
                known = [shared.value.get(anchor, []) for anchor in anchors.tolist()]
                slots = max(map(len, known), default=0)
                # the least and the largest whole score inside; a positive that is missing has no such scores
                own = lambda slot, bound, none: _whole([bound(p[slot][1]) if slot < len(p) else none for p in known])  # noqa: E731, B023
                bounds = [(own(slot, lambda s: -(-low * s // 100), 1), own(slot, lambda s: high * s // 100, 0)) for slot in range(slots)]
                held[block] = (Best(k, slots * len(anchors)), anchors, known, bounds)
            best, _, _, bounds = held[block]
            other = (labels != anchor_labels[:, None]) & (ids != anchors[:, None])
            for slot, (least, most) in enumerate(bounds):
                best.add(slot * len(anchors), ids, scores, other & (scores >= least[:, None]) & (scores <= most[:, None]))
        for best, anchors, known, _ in held.values():
            yield from best.batches(anchors, known, "anchor")

    merged = _merged(through_tiles(rows, anchors, grid, run, BEST), k)
    return merged.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        F.col("positive_score").cast("long"), F.col("score").cast("long").alias("negative_score"),
    )
