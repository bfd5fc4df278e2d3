"""A corpus pipeline: language, exact and near duplicates, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``.

All stages pass null ids and other columns, whatever their names, and give no rows for an empty table; very long texts are
read whole, and none is cut before the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import exact, language, minhash, mixing, packing
from claimloom.llm.store import discard, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null, empty and blank texts go; repeated rows share their decision; of equally likely languages the first by name is taken.
    """
    return language.kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: that of most code points, then of the smallest id (null last).

    Null texts equal empty ones; of repeated rows one stays.
    """
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates (five words, similarity 0.8 or more): that of the smallest id (null last).

    Null and empty texts are near nothing and stay; rows that agree in id and text stay or go together.
    """
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their targets; a document may come up to three times.

    Texts without a word, null ones too, are never taken; a null source is one source; repeated rows are separate documents; ties go by source, reading, shuffled key and id.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    A null text gives its end id only; repeated rows are packed apart; a long text is cut into pieces of several sequences.
    """
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Training, hashing and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
