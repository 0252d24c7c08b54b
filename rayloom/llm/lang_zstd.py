"""Language identification by compression.

Every language has a zstandard raw-content dictionary of its own texts. A text,
reduced to lower-case letters with their marks and single spaces, is encoded in pieces with each
dictionary; the language with the fewest bytes is chosen. The margin to the
second says how sure that is: below ``min_margin`` the choice is marked as
rejected.

Dictionaries are cut from a bounded sample: of every language ``sample_docs``
distinct documents with the smallest hash of id and text give up to ``piece_chars``
letters from their middle, up to ``dictionary_bytes`` in all. All dictionaries
together hold ``total_bytes`` at the most, which bounds what is broadcast: of very
many languages each gets a shorter one, and none is left out. Rows above a hash bound that the counts give are left
out before anything is ranked, so no task ranks a whole language, and repeated
rows count once. Every document is encoded in whole, in one pass without shuffle.

Defined results for odd input: a text that is null or has no letter is ``und``
with score 0 (superscripts, fractions and marks alone are no letters); equal sizes go to the language with more documents, then to the
smaller name; with one language only the score is 1; with none every text is
``und``; repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
_WORDS = regex.compile(r"(?:\p{L}\p{M}*+)++")
#: Bytes that a text is encoded in at a time, so that its own history doesn't outgrow the dictionary's.
PIECE = 2048


def letters_of(text: str | None) -> bytes:
    """The runs of letters (Unicode category L, with the marks M on them), lower-cased, one space between."""
    return " ".join(_WORDS.findall(text.lower())).encode() if text else b""


def dictionaries(
    docs: DataFrame,
    may_learn: Column,
    sample_docs: int = 400,
    piece_chars: int = 512,
    dictionary_bytes: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    total_bytes: int = 25_600_000,
) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more documents first.

    Pieces are cut and joined on the executors; the driver gets ``total_bytes`` at the most.
    """
    own = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    placed = own.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("zstd"), id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    counted = placed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("different"))
    langs = counted.orderBy(F.desc("n"), "lang").collect()
    if not langs:
        return []
    # half as many again as are wanted lie below the bound, so that the sample is full but for rare cases
    shares = [(r.lang, min(1.0, 1.5 * (sample_docs + 50) / max(1, r.different))) for r in langs]
    bounds = docs.sparkSession.createDataFrame([(lang, int(-(2**63) + share * (2**64 - 1025))) for lang, share in shares], "lang string, bound long")
    low = placed.join(F.broadcast(bounds), "lang").filter("place <= bound").select("lang", "place", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for text in batch.column(2).to_pylist():
                letters = letters_of(text).decode()
                at = max(0, (len(letters) - piece_chars) // 2)
                pieces.append(letters[at : at + piece_chars])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pieces, pa.string())], ["lang", "place", "piece"])

    pieces = low.mapInArrow(cut, "lang string, place long, piece string").groupBy("lang", "place").agg(F.min("piece").alias("piece"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    kept = ranked.filter((F.col("rank") <= sample_docs) & (F.col("piece") != "")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("pieces"))
    size = min(dictionary_bytes, total_bytes // len(langs))
    joined = kept.select("lang", F.substring(F.array_join("pieces.piece", " ").cast("binary"), 1, size).alias("content"))
    contents = {r.lang: bytes(r.content) for r in joined.collect()}
    return [(r.lang, contents[r.lang]) for r in langs if contents.get(r.lang)]


class Encoder:
    """The compressors of one Python worker."""

    def __init__(self, contents: list[tuple[str, bytes]], level: int):
        self.langs, self.compressors = [], []
        for lang, content in contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.langs.append(lang)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=known, **options))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is the share of bytes saved against the second best."""
        letters = letters_of(text)
        if not letters or not self.langs:
            return UNDETERMINED, 0.0, 0.0
        pieces = [letters[i : i + PIECE] for i in range(0, len(letters), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.langs[best], margin / (margin + 0.05), margin


def identify(
    docs: DataFrame,
    contents: list[tuple[str, bytes]],
    min_margin: float = 0.01,
    level: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, level)
        for batch in batches:
            found = [encoder.judge(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            columns.append(pa.array([x[2] < min_margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
