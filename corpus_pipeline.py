"""Training-data pipeline: from ``documents`` to a mix of clean, distinct texts.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. All but the last return the columns of
``docs``; the last returns one row per document that is left, with the words that the mix takes of it.

No SQL states the result, because the first stage is a fitted classifier; the tests hold the pipeline against a
brute-force version of the other stages.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import decontaminate, exactdedup, jaccard, mixing, toxicity
from loreweave.llm.common import remainder, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold of the toxicity query; the model is fitted on the labelled rows of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, labels, remainder(F.col("doc_id"), 3) != 1)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id."""
    return exactdedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more on five-word shingles, the row with the smallest doc_id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by ``benchmark``."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` that lead to the row, and size, source_size, target, copies and taken of the mix."""
    return mixing.mix(docs).select("row.doc_id", "row.source", "row.lang", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
