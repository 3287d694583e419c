"""Corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``documents``.

Documents with a null id are kept by the filtering stages and never merged as near-duplicates of one
another by id; rows that share an id and a component are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewatch.llm import packing, quality, simhash, suffix_dedup, toxicity
from pricewatch.llm.common import stored, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every SimHash component."""
    return simhash.representatives(docs, words_per_shingle=3, distance=3)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 400-byte strings; ``n_chars`` follows the text."""
    return suffix_dedup.cleaned(docs, length=400)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack),
]

#: SQL states neither the learned lexicon nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
