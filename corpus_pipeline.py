"""Corpus pipeline over ``documents``: quality classifier, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which ``run``
writes as parquet into the cluster's shared folder and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.core.stage import ensure_checkpoint_dir
from driftline.llm import dedup, mixing, queries, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier scores 0.5 or higher; it is fitted on the labelled rows of ``documents``."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies; a similarity of 0.8 or more links."""
    return dedup.keep_first(docs, link=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to whole documents; wordless rows, of which a mix takes no words, once.

    The schedule takes a source's stream in rounds, so rounding concerns about one document a source.
    """
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in packed sequences."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Neither compressed sizes nor tokens can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
