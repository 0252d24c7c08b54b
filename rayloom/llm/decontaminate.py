"""Benchmark decontamination with a broadcast hash set of test n-grams.

Benchmark items and documents are normalised alike: A-Z lower-cased, words are
runs of letters, digits and anything beyond ASCII. Every run of ``width`` words
of an item is a window; an item of fewer words, but not none, is one window of
its own length. Documents are scanned in whole: words become numbers of the
benchmark's vocabulary, a rolling hash of each run of numbers is looked up in the
sorted window hashes, and each hit is verified word for word. Every word inside
an occurrence is hit.

The set is broadcast only after its words have been counted and found to be at
most ``max_broadcast_words``. A larger benchmark is cut into parts of at most so
many words by a hash of the item id (``parts``), each scanned in turn, and the
hits are united per document, so the answer is the same at any size.

Defined results for odd input: a null or empty text has no words; a null item
text has no window; item ids that repeat count once, null ids are left out of the
item list but still mark words; repeated documents are scanned alike; an empty
benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rayloom.llm.common import materialise

#: Fixed value: what separates words, as UTF-8 bytes; multi-byte characters never match it.
_GAPS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Every byte that separates words becomes a space, A-Z becomes a-z.
_FLAT = bytes(32 if _GAPS.match(_LOWER[i : i + 1]) else _LOWER[i] for i in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FLAT).split() if text else []


class WindowSet:
    """Windows of the benchmark items by length, as sorted hashes of word numbers."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                by_length[n][tuple(words[i : i + n])].add(item_id)
        self.windows = {n: dict(x) for n, x in by_length.items()}
        self.hashes = {n: np.unique([_hash(np.array(w, np.uint64), n)[0] for w in x]) for n, x in self.windows.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        known = self.numbers.get
        numbers = np.fromiter((known(w, 0) for w in words), np.uint64, len(words))
        for n, hashes in self.hashes.items():
            if len(words) < n or np.count_nonzero(numbers) < n:
                continue
            values = _hash(numbers, n)
            at = np.searchsorted(hashes, values)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == values).tolist():
                found = self.windows[n].get(tuple(numbers[i : i + n].tolist()))
                if found:
                    items |= found
                    hit[i] += 1
                    hit[i + n] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def _hash(numbers: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of each run of ``n`` numbers."""
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MULTIPLIER + numbers[k : len(numbers) - n + 1 + k]
    return out


_SPANS = "array<struct<first:int,last:int>>"
_HITS = f"key long, doc_id long, n_words long, n_hit long, spans {_SPANS}, items array<string>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text): the key is the same for rows of the same id and text, which are scanned alike."""
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return row.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


class Benchmark:
    """Items in parts of about ``max_broadcast_words`` words at most, collected one at a time.

    An item of more than a quarter of that is cut into pieces, which overlap by
    the words of a window less one, so that they have the same windows.
    """

    def __init__(self, items: DataFrame, max_broadcast_words: int, width: int, item_col: str, text_col: str):
        most = max(width, max_broadcast_words // 4)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                    words = words_of(text)
                    starts = range(0, max(1, len(words) - width + 1), most - width + 1)
                    pieces = [b" ".join(words[i : i + most]) for i in starts] if len(words) > most else [text]
                    yield pa.RecordBatch.from_arrays([pa.array([item_id.as_py()] * len(pieces), batch.schema[0].type), pa.array(pieces, pa.binary())], ["item_id", "text"])

        given = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
        self.items = given.mapInArrow(cut, given.schema)
        # a word takes a byte and a gap at least, so half the bytes bound the words
        size = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2) + 1
        total = self.items.agg(F.sum(size)).first()[0] or 0
        self.parts = max(1, -(-int(total) // max_broadcast_words))

    def broadcast(self, part: int):
        mine = self.items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.parts)) == part)
        rows = [(r.item_id, None if r.text is None else bytes(r.text)) for r in mine.collect()]
        return self.items.sparkSession.sparkContext.broadcast(rows)


def _pass(keyed: DataFrame, shared, width: int) -> DataFrame:
    """One part of the benchmark over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value, width)
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                hit, found = windows.scan(words)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                spans.append([{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()])
                items.append(sorted({str(i) for i in found if i is not None}))
            columns = [*batch.columns[:2], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            columns += [pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_words", "n_hit", "spans", "items"])

    return keyed.mapInArrow(run, _HITS)


def _merge_spans(spans: Column) -> Column:
    """Runs of the positions that any span covers."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))))
    firsts = F.array_except(places, F.transform(places, lambda p: p + 1))
    lasts = F.array_except(places, F.transform(places, lambda p: p - 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _scan_keyed(docs: DataFrame, benchmark: Benchmark, width: int, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    first = _pass(keyed, benchmark.broadcast(0), width)
    if benchmark.parts == 1:
        return first
    first = materialise(first, "leak-words")
    hits = first.filter("n_hit > 0")
    for part in range(1, benchmark.parts):
        shared = benchmark.broadcast(part)
        hits = hits.union(materialise(_pass(keyed, shared, width).filter("n_hit > 0"), "leak-hits"))
        shared.unpersist()
    merged = hits.groupBy(F.col("key").alias("hit_key")).agg(
        _merge_spans(F.flatten(F.collect_set("spans"))).alias("merged"), F.flatten(F.collect_set("items")).alias("found")
    )
    length = F.aggregate("merged", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return first.join(merged, F.col("key") == F.col("hit_key"), "left").select(
        "key", "doc_id", "n_words",
        F.coalesce(length, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("merged", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce(F.array_sort(F.array_distinct("found")), F.array().cast("array<string>")).alias("items"),
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    max_broadcast_words: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every document.

    ``spans`` are the hit runs as word positions (first, last); ``items`` the ids,
    as strings in order, of the items with occurring windows.
    """
    items = Benchmark(benchmark, max_broadcast_words, width, item_col, item_text_col)
    return _scan_keyed(docs, items, width, id_col, text_col).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the documents in which any window occurs (options as for ``scan``)."""
    return _with_hits(docs, benchmark, **options).filter(F.coalesce(F.size("hit_spans"), F.lit(0)) == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with each hit run cut from the text, from its first word's to its last word's byte."""
    row = _with_hits(docs, benchmark, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(text, spans) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["row", "clean"])

    schema = StructType([row.schema["row"], StructField("clean", StringType())])
    cut = row.select("row", F.col(f"row.{text_col}").cast("binary").alias("text"), "hit_spans").mapInArrow(run, schema)
    return cut.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _with_hits(docs, benchmark, width=10, max_broadcast_words=2_000_000, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """(row, hit_spans): each document with its hit runs, null where there is none.

    Only documents with hits are joined back; they are written once and found by
    the hash of id and text, so that the texts of clean documents need no Python twice.
    """
    items = Benchmark(benchmark, max_broadcast_words, width, item_col, item_text_col)
    hits = _scan_keyed(docs, items, width, id_col, text_col).filter("n_hit > 0")
    hits = materialise(hits.select(F.col("key").alias("hit_key"), F.col("spans").alias("hit_spans")), "leaks").dropDuplicates(["hit_key"])
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(hits, F.col("key") == F.col("hit_key"), "left").select("row", "hit_spans")


#: Fixed value: the words of ``words_of`` in a text whose A-Z are as written.
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _cut(text: bytes | None, spans: list[dict] | None) -> str | None:
    if not spans:
        return None if text is None else text.decode()
    places = [m.span() for m in _WORDS.finditer(text)]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["first"]][0]])
        at = places[span["last"]][1]
    return b"".join([*kept, text[at:]]).decode()


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
