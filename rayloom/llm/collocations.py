"""Phrase collocations: which words occur together more than their own counts explain.

Texts are cut into pieces at punctuation and line ends and those into words; every
run of 1 to ``max_words`` words of a piece becomes a row (lang, phrase, f), and a hash
aggregate per language adds the rows up. Phrases with ``min_count`` occurrences are
candidates. A candidate is cut after each of its words; the counts of both parts are
joined, and the cut with the lowest score floor(10^6 a^2 / (l r)), in Decimal,
counts. Candidates that mostly occur inside a candidate one word longer are dropped
by an anti join, and a window ranks the rest of each language. (A longer candidate
that covers half of a phrase makes every phrase between the two a candidate that
does so too, so one more word is enough.)

What is shuffled is added up and packed before: a task counts its phrases in parts of
``part_words`` words, and all phrases of a part with the same first word travel as
one row of sorted lines, which is exploded into rows behind the shuffle. First words
that make a thousandth of all words or more (at most a thousand, found by a pass over
all texts) are spread over many rows by the words behind them. No text or piece is
held as rows or arrays of its own, however long it is. Only counts from
``min_count`` on are written; all later joins are between tables of such counts.

Defined results for odd input: a null text is empty and has no words; a null
language is ``und`` and shares its counts; repeated rows count each time; texts and
pieces of any length are taken whole; ties go to more occurrences, then to the
phrase in UTF-8 byte order; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

#: A-Z to a-z, tabs to blanks, and what ends a piece to line feeds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\v\f\r" else c for c in range(256))


#: Exact for counts below 10^15.
_SCORE = "1000000BD * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
#: Bytes of a text that are split at a time; such a stretch ends between two words.
_STRETCH = 1 << 20


def stretches(text: bytes, size: int = _STRETCH) -> Iterator[bytes]:
    """A folded text in stretches that end between words."""
    at = 0
    while len(text) - at > size:
        ends = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


class _Vocabulary(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Part:
    """The words of one language since the last counts, as numbers, and where pieces begin."""

    def __init__(self):
        self.vocabulary, self.numbers, self.begins, self.size = _Vocabulary(), [], [], 0
        #: Words at the front that have been counted before; phrases only end behind them.
        self.counted = 0

    def add(self, stretch: bytes, new: bool) -> None:
        """Adds the words of a stretch; ``new``: it begins a text."""
        number = self.vocabulary.__getitem__
        for piece in stretch.split(b"\n"):
            if new:
                self.begins.append(self.size)
            new = True
            if words := piece.split():
                self.numbers.append(np.fromiter(map(number, words), np.int32, len(words)))
                self.size += len(words)

    def packs(self, most: int, spread: dict[bytes, int]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """The phrases of 1 to ``most`` words that begin with one word, as lines "other words, tab, count".

        Heads, salts and lines of each pack. The salt follows from the other words; a head
        has as many salts as ``spread`` says, or one.
        """
        numbers = np.concatenate([np.zeros(0, np.int32), *self.numbers])
        spelt = pa.array(list(self.vocabulary), pa.binary())
        order = pc.sort_indices(spelt).to_numpy().astype(np.int64)
        words, place = spelt.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers, piece = place[numbers], np.zeros(len(numbers) + 1, np.int64)
        np.add.at(piece, np.array(self.begins, np.int64), 1)
        piece = np.cumsum(piece[:-1])
        checks = np.array([zlib.crc32(w) for w in words.to_pylist()], np.int64)
        salts = np.array([spread.get(w, 1) for w in words.to_pylist()], np.int64)
        rank, mix, heads, dealt, tails, found = numbers, np.zeros(len(words), np.int64), [], [], [], []
        for n in range(1, most + 1):
            begin = np.arange(max(0, len(numbers) - n + 1))
            if n == 1:
                head, tail = np.arange(len(words)), pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(words), np.int64)))
            else:
                begin = begin[piece[begin] == piece[begin + n - 1]]
                different, at = np.unique(rank[begin] * len(words) + numbers[begin + n - 1], return_inverse=True)
                before, last = different // max(1, len(words)), different % max(1, len(words))
                added = words.take(pa.array(last))
                tail = added if n == 2 else pc.binary_join_element_wise(tail.take(pa.array(before)), added, b" ")
                head, mix = head[before], (mix[before] * 31 + checks[last]) % 2**40
                rank = np.zeros(len(numbers), np.int64)
                rank[begin] = at
            times = np.bincount(rank[begin[begin + n - 1 >= self.counted]], minlength=len(head))
            kept = np.flatnonzero(times)
            heads.append(head[kept])
            dealt.append(mix[kept] % salts[head[kept]])
            tails.append(tail.take(pa.array(kept)))
            found.append(times[kept])
        head, salt, times = (np.concatenate(x) for x in (heads, dealt, found))
        order = np.lexsort((salt, head))
        head, salt = head[order], salt[order]
        counts = pc.cast(pc.cast(pa.array(times[order]), pa.string()), pa.binary())
        lines = pc.binary_join_element_wise(pa.chunked_array(tails).combine_chunks().take(pa.array(order)), counts, b"\t")
        lines = pc.binary_join_element_wise(lines, b"", b"\n")
        first = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (salt[1:] != salt[:-1])])) if len(head) else np.zeros(0, np.int64)
        ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset :][np.append(first, len(head))]
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), lines.buffers()[2]])
        return words.take(pa.array(head[first])), salt[first], packed

    def rest(self, most: int) -> Part:
        """A new part, which begins with the last words of a piece that goes on."""
        after, open_from = Part(), max([0, *self.begins[-1:]])
        last = np.concatenate([np.zeros(0, np.int32), *self.numbers])[open_from:][max(0, self.size - open_from - most + 1) :]
        names = list(self.vocabulary)
        after.numbers = [np.array([after.vocabulary[names[x]] for x in last], np.int32)]
        after.size = after.counted = len(last)
        after.begins = [0]
        return after


def _parts(batches: Iterator[pa.RecordBatch], part_words: int, most: int) -> Iterator[dict[str, Part]]:
    """The parts of each language, whenever they hold ``part_words`` words together, and at the end."""
    parts: dict[str, Part] = {}
    held = 0
    for batch in batches:
        for lang, cell in zip(batch.column("lang").to_pylist(), batch.column("text")):
            new = True
            for stretch in stretches(cell.as_py().translate(_FOLD)):
                part = parts.setdefault(lang, Part())
                before = part.size
                part.add(stretch, new)
                held, new = held + part.size - before, False
                if held >= part_words:
                    yield parts
                    parts, held = {lang: part.rest(most)}, 0
    yield parts


def word_shares(texts: DataFrame, part_words: int, least: int = 1000) -> DataFrame:
    """(lang, word, n): how often words occur; only words that make 1 of 2 * ``least`` words of a part, and all words together as the word null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _parts(batches, part_words, 1):
            total = sum(part.size for part in parts.values())
            for lang, part in parts.items():
                times = np.bincount(np.concatenate([np.zeros(0, np.int32), *part.numbers]), minlength=len(part.vocabulary))
                often = np.flatnonzero(times * 2 * least >= total)
                words = list(part.vocabulary)
                columns = [lang] * (len(often) + 1), [None, *(words[x] for x in often)], [part.size, *times[often].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hot_words(shares: DataFrame, least: int = 1000, pieces: int = 2000) -> dict[bytes, int]:
    """Words that make 1 of ``least`` words at least (so many at most), and how many salts each gets."""
    total = shares.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    often = shares.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * least >= total)
    return {bytes(r.word): -(-r.n * pieces // total) for r in often.collect()}


def phrase_packs(texts: DataFrame, max_words: int, part_words: int, spread: dict[bytes, int]) -> DataFrame:
    """(lang, head, salt, lines) of all texts (lang string, text binary), in parts of about ``part_words`` words."""
    shared = texts.sparkSession.sparkContext.broadcast(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _parts(batches, part_words, max_words):
            for lang, part in parts.items():
                heads, salts, lines = part.packs(max_words, shared.value)
                for at in range(0, len(heads), 10_000):
                    own = heads.slice(at, 10_000)
                    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(own), np.int64)))
                    yield pa.RecordBatch.from_arrays([langs, own, pa.array(salts[at : at + 10_000], pa.int32()), lines.slice(at, 10_000)], ["lang", "head", "salt", "lines"])

    return texts.mapInArrow(run, "lang string, head binary, salt int, lines binary")


def phrase_counts(packs: DataFrame) -> DataFrame:
    """(lang, phrase, f): packs, shuffled by language, head and salt, exploded into rows and added up."""
    text = packs.select("lang", F.col("head").cast("string").alias("head"), "salt", F.col("lines").cast("string").alias("lines"))
    dealt = text.repartition("lang", "head", "salt")
    rows = dealt.select("lang", "head", "salt", F.explode(F.split(F.rtrim("lines", F.lit("\n")), "\n")).alias("line"))
    tail, count = F.substring_index("line", "\t", 1), F.substring_index("line", "\t", -1).cast("long")
    sums = rows.groupBy("lang", "head", "salt", tail.alias("tail")).agg(F.sum(count).alias("f"))
    return sums.select("lang", F.when(F.col("tail") == "", F.col("head")).otherwise(F.concat_ws(" ", "head", "tail")).alias("phrase"), "f")


def mine_phrases(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    covered_percent: int = 50,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
    part_words: int = 1_000_000,
) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shares = materialise(word_shares(texts, part_words), "collocations-words")
    sums = phrase_counts(phrase_packs(texts, max_words, part_words, hot_words(shares)))
    counts = materialise(sums.filter(F.col("f") >= min_count), "collocations-counts")
    scored = best_cuts(counts, min_count)
    longer = counts.filter(F.col("f") >= min_count).withColumn("words", _words("phrase")).filter(F.size("words") > 2)
    shorter = lambda begin: _joined(F.slice("words", F.lit(begin), F.size("words") - 1))
    inner = longer.select("lang", "f", F.explode(F.array(shorter(1), shorter(2))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(covered, (scored.lang == covered.lang) & (scored.phrase == covered.phrase) & (F.col("longer") * 100 >= F.col("a") * covered_percent), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = shares.filter("word IS NULL").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _words(column: str) -> Column:
    return F.split(column, " ")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def best_cuts(counts: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words and more, at the cut with the lowest score."""
    size = F.size(_words("phrase"))
    candidates = counts.filter(F.col("f") >= min_count).withColumn("words", _words("phrase")).filter(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"), _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("last"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r"))
    both = parts.join(left, ["lang", "first"]).join(right, ["lang", "last"])
    scored = both.withColumn("score", F.expr(_SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
