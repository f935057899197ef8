"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as
the next stage's input. Rows with nulls go through every stage as the operators' docstrings say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, paragraphs, simhash, toxicity
from tidemark.llm.common import shared_dir, table

#: Weights that the sources take in turn in the last stage.
WEIGHTS = [1, 2, 3]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.fit(docs, toxicity.training_labels(spark, sf_dir))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near-duplicates."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in a document of a smaller id."""
    return paragraphs.dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in training order, with the words that the mix takes of each."""
    return mixing.in_order(mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))), WEIGHTS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Trained scores and near-duplicate classes have no SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
