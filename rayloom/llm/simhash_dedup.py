"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of a text's
word shingles. Two fingerprints that differ in at most ``distance`` bits agree
up to one bit in at least one of ceil((distance + 1) / 2) segments. So each
distinct fingerprint is indexed under the variants of every segment with one bit
wild: fingerprints that share such a key are candidates and are verified over
all 64 bits. Four bits take three segments and 64 keys in all, whatever the
distance.

Candidates meet by a shuffle on the key, sorted, and are streamed: a bucket
emits a spanning forest of its links and never all pairs. A bucket of more than
``bucket_rows`` fingerprints is passed on instead, cut into chunks, and every
pair of chunks is compared in a task of its own, so nothing is dropped and no
task holds more than two chunks. Equal fingerprints are one node throughout:
thousands of copies cost one row. Components come from ``components``.

Defined results for odd input: a null or empty text has no words and fingerprint
zero, linked like any other; repeated rows are documents of their own in the same
component; the component id is the smallest non-null id (null if there is none);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.llm.common import materialise, working_tables
from rayloom.llm.components import connected_components

SEED = 42
BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles voted on at once, which bounds the memory that one long text takes.
_VOTES = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased; ``split()`` parts at the six ASCII white spaces."""
    return text.translate(_LOWER).split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by spaces; of all words if there are fewer."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _VOTES):
        part = hashes[at : at + _VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint over word shingles, repeats included; 0 without words."""
    words = words_of(text)
    return _majority(shingle_hashes(words, width)) if words else 0


def with_fingerprints(
    docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", bands: Callable | None = None, shingle: int = 5
) -> DataFrame:
    """(doc_id, key, fp) for every document, whole texts; the key is the same for equal rows.

    ``bands`` adds ``text_key``, which equal texts share, and what it makes of the hashes of the distinct shingles of ``shingle`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, made = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                fps.append(fingerprint(text, width))
                if bands:
                    made.append(bands(shingle_set(text, shingle)))
            columns = [*batch.columns[:-1], pa.array(fps, pa.int64()), *([pa.array(made, pa.list_(pa.int64()))] if bands else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), *[F.xxhash64(text_col).alias("text_key")] * bool(bands),
        F.col(text_col).cast("binary").alias("text"),
    )
    schema = "doc_id long, key long, text_key long, fp long, bands array<long>" if bands else "doc_id long, key long, fp long"
    names = [field.split()[0] for field in schema.split(", ")]
    return narrow.mapInArrow(run, schema)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the fewest segments, two at least, of which one differs by one bit at most."""
    n = max(2, (distance + 2) // 2)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variant_keys(distance: int) -> list[Column]:
    """For each segment and each of its bits: the segment without that bit, numbered."""
    out = []
    for number, (first, width) in enumerate(segments(distance)):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            out.append(part.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((number * BITS + bit) << 42)))
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] and b[i]: each node points to its component's least node."""
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        live = high != low
        a, b = a[live], b[live]
        np.minimum.at(label, high[live], low[live])
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal keys (sorted)."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(starts)
    label = np.arange(len(keys))
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 256), sizes))
    ends = np.repeat(starts[1:], sizes)
    step, found_a, found_b = 1, [], []
    while len(small := small[small + step < ends[small]]):
        near = small[_near(fps[small], fps[small + step], distance)]
        found_a.append(near)
        found_b.append(near + step)
        step += 1
    if found_a:
        label = _merge(label, np.concatenate(found_a), np.concatenate(found_b))
    for run in np.flatnonzero(sizes > 256):
        label[starts[run] : starts[run + 1]] = _run_labels(fps[starts[run] : starts[run + 1]], distance) + starts[run]
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return fps[moved], fps[label[moved]]


def _run_labels(fps: np.ndarray, distance: int) -> np.ndarray:
    """Labels in one large bucket, in blocks; it ends early once all are one component."""
    n, label = len(fps), np.arange(len(fps))
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        if not label.any():
            break
        block = slice(at, at + step)
        near = _near(fps[block, None], fps[None, at:], distance) & (label[block, None] != label[None, at:])
        a, b = np.nonzero(near)
        label = _merge(label, a + at, b + at)
    return label


def _stream(distance: int, bucket_rows: int | None) -> Callable:
    """Over rows sorted by key: links (0, fp, fp), or (1, key, fp) for buckets that are too large."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(a), kind, np.int32), a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, passing = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([held_k, batch.column(0).to_numpy()])
            fps = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if passing is not None and (n := int(np.searchsorted(keys, passing, "right"))):
                yield rows(1, keys[:n], fps[:n])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    held_k, held_f = keys, fps
                    continue
            passing = None
            last = int(np.searchsorted(keys, keys[-1], "left"))
            yield from complete(keys[:last], fps[:last])
            held_k, held_f = keys[last:], fps[last:]
            if bucket_rows and len(held_k) > bucket_rows:
                yield rows(1, held_k, held_f)
                passing, held_k, held_f = int(held_k[0]), held_k[:0], held_f[:0]
        yield from complete(held_k, held_f)

    def complete(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bucket_rows and len(keys):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            large = np.repeat(np.diff(cuts) > bucket_rows, np.diff(cuts))
            if large.any():
                yield rows(1, keys[large], fps[large])
                keys, fps = keys[~large], fps[~large]
        a, b = bucket_links(keys, fps, distance) if len(keys) > 1 else (fps[:0], fps[:0])
        if len(a):
            yield rows(0, a, b)

    return run


def fingerprint_links(fps: DataFrame, distance: int = 4, bucket_rows: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within ``distance``."""
    keyed = fps.select(F.explode(F.array(*variant_keys(distance))).alias("key"), "fp")
    schema = "kind int, a long, b long"
    met = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stream(distance, bucket_rows), schema)
    met = materialise(met, "simhash-links")
    linked = met.filter("kind = 0").select("a", "b")
    large = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return linked.distinct()
    chunk_rows = bucket_rows // 2
    chunks = large.groupBy("key").agg(F.ceil(F.count("*") / chunk_rows).alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = (
        large.join(chunks, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    )
    more = pairs.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stream(distance, None), schema)
    return linked.union(more.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 16_384
) -> DataFrame:
    """(doc_id, key, fp, component_id, best) for every document.

    ``best`` is the (no_id, doc_id, key) of the component's first row: the one
    with the smallest id, rows without an id last.
    """
    prints = materialise(with_fingerprints(docs, width, id_col, text_col), "simhash-prints")
    return _components(prints, distance, bucket_rows)


def _first_row() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")


def _components(prints: DataFrame, distance: int, bucket_rows: int, more: DataFrame | None = None) -> DataFrame:
    """``more`` adds links between fingerprints."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(_first_row()).alias("least")), "simhash-nodes")
    links = fingerprint_links(nodes.select("fp"), distance, bucket_rows)
    roots = connected_components(links.union(more) if more is not None else links)
    placed = materialise(
        nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    best = materialise(placed.groupBy("root").agg(F.min("least").alias("best")), "simhash-best")
    classes = placed.join(best, "root").select(F.col("fp").alias("node"), "best")
    return prints.join(classes, F.col("fp") == F.col("node")).select("doc_id", "key", "fp", F.col("best.doc_id").alias("component_id"), "best")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; none without words."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, shingle)) if words else np.zeros(0, np.uint64)


class Bands:
    """MinHash bands: sets of Jaccard coefficient t share a band with probability 1 - (1 - t ** rows) ** bands.

    20 bands of 5 rows give 0.9996 at 0.8 and more above it.
    """

    def __init__(self, bands: int = 20, rows: int = 5, seed: int = 20_11):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = random.integers(0, 2**63, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = random.integers(0, 2**63, bands * rows).astype(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """One hash for each band, with the band's number in it; none for an empty set."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(self.bands * self.rows, 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 256):
            part = hashes[at : at + 256, None] * self.factors + self.offsets
            np.minimum(least, part.min(axis=0), out=least)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            out = (out ^ least[k :: self.rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[list[pa.Array], bool]]:
    """Runs of equal first columns (sorted) over batches, as (columns, whole).

    A run of more than ``most`` rows comes in pieces, which are not whole.
    """
    held: list[pa.RecordBatch] = []
    passing = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield _joined(held), passing is None
                held, passing = [], None
            held.append(part)
            if most and sum(map(len, held)) > most:
                passing = keys[a]
                yield _joined(held), False
                held = []
            if passing is not None and keys[a] != passing:
                passing = None
    if held:
        yield _joined(held), passing is None


def _joined(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)]


def _buckets(bucket_rows: int) -> Callable:
    """Over (h, text) sorted by h: (bucket, text, whole) of the runs of more than one text.

    A bucket's number is made of its texts: texts that share many bands with the
    same others meet once. Pieces of a run that is too large keep the band's hash.
    """

    def rows(bucket: np.ndarray, text: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, text, whole)], ["bucket", "text", "whole"])

    def complete(h: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
        sizes = np.diff(np.append(starts, len(h)))
        whole = np.repeat(sizes <= bucket_rows, sizes)
        number = h.copy()
        for i in np.flatnonzero((sizes > 1) & (sizes <= bucket_rows)):
            run = slice(starts[i], starts[i] + sizes[i])
            number[run] = np.uint64(xxhash.xxh64_intdigest(text[run].tobytes())).view(np.int64)
        several = np.repeat(sizes > 1, sizes)
        if several.any():
            yield rows(number[several], text[several], whole[several])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_t, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            h = np.concatenate([held_h, batch.column(0).to_numpy()])
            text = np.concatenate([held_t, batch.column(1).to_numpy()])
            if passing is not None and (n := int(np.searchsorted(h, passing, "right"))):
                yield rows(h[:n], text[:n], np.zeros(n, bool))
                h, text = h[n:], text[n:]
            held_h, held_t = h, text
            if not len(h):
                continue
            passing = None
            last = int(np.searchsorted(h, h[-1], "left"))
            if last:
                yield from complete(h[:last], text[:last])
            held_h, held_t = h[last:], text[last:]
            if len(held_h) > bucket_rows:
                yield rows(held_h, held_t, np.zeros(len(held_h), bool))
                passing, held_h, held_t = int(held_h[0]), held_h[:0], held_t[:0]
        if len(held_h):
            yield from complete(held_h, held_t)

    return run


def set_links(sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as fingerprints, of the pairs of ``sets`` whose Jaccard coefficient is ``similarity`` or more.

    An inverted index counts what each set shares with all others; pairs are
    looked at one set at a time and never held.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    _, group, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(group, kind="stable")]
    starts = np.cumsum(counts) - counts
    _, label = np.unique(fps, return_inverse=True)
    found_a, found_b = [], []
    for i in range(len(sets)):
        if (label == label[0]).all():
            break
        own = group[ends[i] - sizes[i] : ends[i]]
        n = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        alike = (common >= similarity * (sizes[i] + sizes - common) - 1e-9) & (label != label[i])
        for j in np.flatnonzero(alike):
            if label[j] != label[i]:
                found_a.append(fps[i])
                found_b.append(fps[j])
                label[label == label[j]] = label[i]
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def _bucket_sets(similarity: float) -> Callable:
    """Over (bucket, text, fp, set) sorted by bucket: the links (a, b) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, fp, held), _ in _runs(batches, None):
            sets = [x.values.to_numpy() for x in held]
            if len(sets) > 1:
                a, b = set_links(sets, fp.to_numpy(), similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


#: So many keys of texts that meet another are broadcast; beyond, the texts are shuffled.
BROADCAST_KEYS = 2_000_000


def similar_links(
    docs: DataFrame, prints: DataFrame, similarity: float, width: int, shingle: int, bucket_rows: int, set_entries: int, id_col: str, text_col: str
) -> DataFrame:
    """(a, b): links between the fingerprints of texts that share a band and whose shingles are similar.

    ``prints`` has (key, text_key, bands). Each distinct text stands once in the
    bucket of each of its bands. Buckets of several get the texts' fingerprints
    and shingle sets, as 32-bit hashes, and every pair in them is checked; a
    bucket emits a spanning forest. One of more than ``bucket_rows`` texts, or whose
    sets hold more than ``set_entries`` hashes together, is cut into chunks, of which
    every pair is a task's work.
    """
    texts = prints.groupBy("text_key").agg(F.min("key").alias("text"), F.first("bands").alias("bands"))
    entries = texts.select(F.explode("bands").alias("h"), "text")
    met = entries.repartition("h").sortWithinPartitions("h", "text").mapInArrow(_buckets(bucket_rows), "bucket long, text long, whole boolean")
    met = materialise(met.distinct(), "similar-buckets")
    needed = met.select("text").distinct()
    few = needed.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for text in batch.column(1).to_pylist():
                fps.append(fingerprint(text, width))
                sets.append(np.unique((shingle_set(text, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], ["text", "fp", "set"])

    own = docs.select(row_key(id_col, text_col).alias("text"), F.col(text_col).cast("binary").alias("body"))
    own = own.join(F.broadcast(needed) if few else needed, "text")
    sets = own.mapInArrow(shingles, "text long, fp long, set array<int>").groupBy("text").agg(F.first("fp").alias("fp"), F.first("set").alias("set"))
    sets = materialise(sets, "similar-sets")

    def meet(rows: DataFrame) -> DataFrame:
        filled = rows.join(sets, "text").select("bucket", "text", "fp", "set")
        return filled.repartition("bucket").sortWithinPartitions("bucket", "text").mapInArrow(_bucket_sets(similarity), "a long, b long")

    met = met.select("bucket", "text").distinct()
    weighed = met.join(sets.select("text", F.size("set").alias("n")), "text").groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    halves = F.greatest(F.col("texts") / (bucket_rows / 2), F.col("n") / (set_entries / 2))
    chunks = materialise(weighed.filter((F.col("texts") > bucket_rows) | (F.col("n") > set_entries)).select("bucket", F.ceil(halves).alias("chunks")), "similar-chunks")
    links, large = meet(met), met.join(chunks, "bucket", "left_semi")
    if not chunks.isEmpty():
        links = meet(met.join(chunks, "bucket", "left_anti"))
        mine, other = F.pmod(F.xxhash64("text"), F.col("chunks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        cut = large.join(chunks, "bucket").withColumn("mine", mine).withColumn("other", other)
        links = links.union(meet(cut.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "text").distinct()))
    return materialise(links.distinct(), "similar-links")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, bucket_rows: int = 16_384,
    similarity: float = 0.8, shingle: int = 5, set_rows: int = 4096, set_entries: int = 4_000_000,
) -> DataFrame:
    """``docs``, all columns, with one document of each group: its first row, by id.

    Two texts are linked if their fingerprints differ in at most ``distance`` bits
    or the Jaccard coefficient of their sets of ``shingle``-word shingles is
    ``similarity`` or more (see ``similar_links``): fingerprints of a few hundred
    shingles differ in more bits well before that falls below 0.8. Groups are the
    components over both kinds of links.

    Null and empty texts are one group; of rows that share the smallest id the
    one with the smaller key stays, rows without an id come last; rows repeated
    in full are reduced to one. The texts are joined with the keys of the rows
    that go only.
    """
    with working_tables(docs.sparkSession):
        prints = materialise(with_fingerprints(docs, width, id_col, text_col, Bands(), shingle), "simhash-prints")
        links = similar_links(docs, prints, similarity, width, shingle, set_rows, set_entries, id_col, text_col)
        found = _components(prints.select("doc_id", "key", "fp"), distance, bucket_rows, links)
        found = materialise(found.select("key", (F.col("key") == F.col("best.key")).alias("stays")), "simhash-stays")
        gone = materialise(found.filter("not stays").select("key").distinct(), "simhash-gone", lasting=True)
        again = materialise(found.filter("stays").groupBy("key").count().filter("count > 1").select("key"), "simhash-again", lasting=True)
    kept = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(gone, "key", "left_anti")
    if not again.isEmpty():
        one = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(again, "key", "left_anti").select("key", "row").union(one)
    return kept.select("row.*")


def fingerprint_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
