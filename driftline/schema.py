"""Canonical table layouts and the boundary step that maps foreign column names onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ID = [T.StructField("dataset_id", T.StringType()), T.StructField("deployment_id", T.StringType())]

SIGNAL_LONG = T.StructType([
    *ID, T.StructField("signal", T.StringType()), T.StructField("channel", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])

EVENTS = T.StructType([
    *ID, T.StructField("ts", T.TimestampType()), T.StructField("end_ts", T.TimestampType()),
    T.StructField("type", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("short_description", T.StringType()), T.StructField("long_description", T.StringType())])

SEGMENTS = T.StructType([
    *ID, T.StructField("start_index", T.LongType()), T.StructField("end_index", T.LongType()),
    T.StructField("start_ts", T.TimestampType()), T.StructField("end_ts", T.TimestampType()),
    T.StructField("duration_s", T.DoubleType())])

LOCATION_ALIASES = {
    "latitude": ["latitude", "lat", "location_lat", "gps_lat"],
    "longitude": ["longitude", "lon", "lng", "long", "location_lon", "gps_lon"],
}


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]], required: bool = True) -> dict[str, str | None]:
    """Canonical name -> first matching column, case-insensitively, in alias order (schema only, no job)."""
    by_lower = {c.lower(): c for c in df.columns}
    found = {k: next((by_lower[a.lower()] for a in al if a.lower() in by_lower), None) for k, al in aliases.items()}
    missing = [k for k, v in found.items() if v is None]
    if required and missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    return found


def canonical(df: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rename foreign columns to canonical ones; absent ones take a default or null."""
    defaults = defaults or {}
    found = resolve_columns(df, aliases, required=False)
    used = {v for v in found.values() if v}
    return df.select(
        *[(F.col(v) if v else defaults.get(k, F.lit(None))).alias(k) for k, v in found.items()],
        *[c for c in df.columns if c not in used and c not in found])


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end as DOUBLE, at microsecond resolution."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(e) - F.unix_micros(s)) / F.lit(1_000_000.0)


def add_seconds(ts: Column | str, seconds: Column | float) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(t) + F.round(s * 1_000_000).cast("bigint"))
