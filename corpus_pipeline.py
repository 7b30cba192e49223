"""From raw documents to token ids: five stages, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from tidemark.llm.common import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents of an Arrow batch. Spark's 10,000 are all that a task reads: their texts would lie whole beside the heap
#: and in the Python worker at the same time.
BATCH = 1000


def in_batches(stage: Stage) -> Stage:
    """The stage, after the session's Arrow batches have been limited to ``BATCH`` rows; a smaller limit stays."""

    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, str(BATCH))
        return stage(spark, docs, sf_dir)

    return limited


@in_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_batches
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or nearly equal lines the first stays; all documents stay, if need be with an empty text."""
    return line_dedup.dedup(docs)


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


@in_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_batches
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.report(docs, path, public_tokenizers.PATTERN, remember=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Trained trees, numpy merging and edit joins are not SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
