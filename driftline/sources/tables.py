"""The driver's parquet tables as signals, events and dimensions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..core.axis import WIDTH_CONF, Axis, fit_axis

_AXES: dict[tuple, Axis] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; zone-less timestamps are UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a two-channel signal: entity ``user_id``, order ``(ts, event_id)``, channels value and k."""
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def signal_axis(spark: SparkSession, sf_dir: str) -> Axis:
    """Chunked axis of ``signals``; the width probe runs once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, spark.conf.get(WIDTH_CONF, None))
    if key not in _AXES:
        _AXES[key] = fit_axis(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return _AXES[key]
