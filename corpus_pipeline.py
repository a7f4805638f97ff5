"""Corpus preparation: language ID, exact dedup, near dedup, packing; each stage works on what the one before kept.

Defined results: the first stage drops texts without letters (null and empty ones too) and undecided ones; the two dedup
stages leave exactly one row of each group, so rows without identifier, or with one that others share, go only as
copies; repeated rows are copies; empty tables pass through; other columns stay as they are until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import exact_dedup, langid, packing, simhash
from eventide.llm.base import discard, materialise

#: Documents whose best language has less than this multiple of the chance probability are undecided and go.
MIN_LIFT = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Undetermined and undecided documents go; clean text of any learned language stays."""
    net = langid.train(docs)
    return langid.keep_identified(docs, net, min(0.9, MIN_LIFT / len(net.labels)) if net else 0.0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("packing", packed)]

#: Learned and iterative stages have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
