"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns documents with the columns of ``documents``; the last returns the
placement of every kept document. A runner writes each result as Parquet and
reads it again as the next stage's documents.

Defined results for odd input, in every stage: nulls in any column pass through
unless the stage's own rule drops the row; empty and very long texts are judged
whole; repeated rows are documents of their own until near_dedup keeps one of
them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.llm import decontaminate, quality_nbsvm, queries, simhash_dedup, source_mix
from rayloom.llm.common import id_fold, materialise, table

#: Documents that score below are rejected.
KEEP_AT = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below ``KEEP_AT``; null and empty texts get the score of no features, ties stay."""
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"), ~id_fold("doc_id", 4, 2))
    scored = quality_nbsvm.score(docs, model, carry=tuple(docs.columns))
    return scored.filter(F.col("score") >= KEEP_AT).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (four bits, or 0.8 of five-word shingles) the smallest id stays.

    Texts without words are one group; of rows with the same id one stays, rows
    without an id go before others. Similar texts are candidates if they share
    one of 20 MinHash bands: at 0.8 exactly one pair in 2500 shares none.
    """
    return simhash_dedup.keep_one(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of the benchmark occurs; texts without words have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until the sources stand in their target proportions; a null source is one of its own, and last."""
    mixed = source_mix.mix(docs, carry=tuple(docs.columns))
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix out to shards of near equal bytes; rows that are alike spread too."""
    return queries.sharded(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", clean_benchmark),
    ("mix", mix),
    ("shard", shards),
]

#: SQL can say neither the classifier nor XXH64 fingerprints; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
