"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of bytes other than ASCII white space. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def utf8(text: str) -> Column:
    """The text's bytes; a null text has none."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def bounded_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """Texts go to Python workers in Arrow batches of at most ``rows`` rows, a bound on the session's own setting: with the usual
    10,000 a batch of long texts takes hundreds of MB on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= rows:
        df.sparkSession.conf.set(key, rows)
    return df


def pieces(n: int, target: int, least: int = 1) -> int:
    """How many groups of about ``target`` rows ``n`` rows make."""
    return max(least, math.ceil(n / target))
