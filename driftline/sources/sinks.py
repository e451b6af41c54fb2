"""Parquet and CSV sinks, and windowed loads from them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..core.facts import with_facts
from ..schema import seconds_between


def write_signals(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Long signals as parquet partitioned by dataset, signal and UTC day; an export without rows is refused.

    The rows are counted while they are written. Days split a long recording over many files.
    """
    obs = Observation()
    d = df.withColumn("date", F.to_date("ts")).observe(obs, F.count(F.lit(1)).alias("n"))
    d.repartition("dataset_id", "signal", "date", "deployment_id").write.mode(mode).partitionBy("dataset_id", "signal", "date").parquet(path)
    try:
        n = obs.get["n"]
    except Py4JJavaError:  # an empty plan reports nothing
        n = 0
    if n == 0:
        raise ValueError("refusing to publish an export without signal rows")
    return n


def load_window(spark: SparkSession, path: str, start: str, end: str, signals: list[str] | None = None, deployment: str | None = None) -> DataFrame:
    """Samples with ``start ≤ ts ≤ end``: day partitions are pruned and the time range is pushed to the files."""
    df = spark.read.parquet(path)
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    df = df.where((F.col("date") >= F.to_date(a)) & (F.col("date") <= F.to_date(b)) & (F.col("ts") >= a) & (F.col("ts") <= b))
    if signals:
        df = df.where(F.col("signal").isin(signals))
    return df.where(F.col("deployment_id") == deployment) if deployment else df


def load_events_window(events: DataFrame, start: Column, end: Column, ts: str = "ts", stop: str = "end_ts") -> DataFrame:
    """Events that begin in the window or reach into it."""
    return events.where((F.coalesce(F.col(stop), F.col(ts)) >= start) & (F.col(ts) <= end))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with ISO instants in UTC."""
    out = df.select(*[F.date_format(c.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c.name) if c.dataType.typeName() == "timestamp" else F.col(c.name)
                      for c in df.schema.fields])
    out.write.mode(mode).option("header", True).csv(path)


def parquet_friendly(df: DataFrame) -> DataFrame:
    """Void columns become strings so that every table can be written."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = parquet_friendly(df).write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def flatten_metadata(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nested structs as rows (keys, name, value) with joined names ``a_b_c``."""
    def leaves(schema, prefix, name):
        for f in schema.fields:
            p, n = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`", f"{name}_{f.name}" if name else f.name
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, p, n)
            else:
                yield n, p
    cells = [F.struct(F.lit(n).alias("name"), F.col(p).cast("string").alias("value")) for n, p in leaves(df.schema, "", "") if n not in keys]
    return df.select(*keys, F.inline(F.array(*cells)))


def publish_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df``; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load_runs(spark: SparkSession, path: str, ids: list[str], column: str = "deployment_id") -> DataFrame:
    """Segments of a merged run table for some deployments; the id filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(column).isin(ids))


# States by the class that older run outputs carry.
STATE_OF_CLASS = {"surface_sleep": "putative_rest.surface_sleep", "long_flat": "putative_rest.benthic_sleep", "long_drift": "putative_rest.drift_sleep", "not_sleep": "find_rest.not_sleep"}
UNNAMED_STATE = "putative_rest.unfiltered"
OLDER_NAMES = {"start_datetime": "start_ts", "end_datetime": "end_ts", "datetime": "ts"}


def standard_segments(df: DataFrame) -> DataFrame:
    """A run's segments under today's column names, whatever version wrote them.

    Times are renamed; ``duration_s`` comes from ``duration`` or the times, ``segment_midpoint_ts`` from the times or ``ts``, ``keep_filtered`` from
    ``context_keep`` (kept without either), ``base_keep_filtered`` from ``keep_filtered``. ``label_name`` is taken, where it is missing or blank on every row, from
    ``state_name``, ``base_state_key`` or the class; a named label also names the state, whose first part is the group.
    """
    df = df.withColumnsRenamed({a: b for a, b in OLDER_NAMES.items() if a in df.columns and b not in df.columns})
    has = set(df.columns)
    times = {"start_ts", "end_ts"} <= has
    add: dict[str, Column] = {}
    if "duration_s" not in has:
        add["duration_s"] = F.expr("try_cast(duration AS double)") if "duration" in has else seconds_between("start_ts", "end_ts") if times else F.lit(None).cast("double")
    if "segment_midpoint_ts" not in has:
        middle = F.timestamp_micros(F.unix_micros("start_ts") + F.expr("(unix_micros(end_ts) - unix_micros(start_ts)) div 2")) if times else F.col("ts") if "ts" in has else F.lit(None).cast("timestamp")
        add["segment_midpoint_ts"] = middle
    if "keep_filtered" not in has:
        add["keep_filtered"] = F.col("context_keep") if "context_keep" in has else F.lit(True)
    df = df.withColumns(add)
    if "base_keep_filtered" not in has:
        df = df.withColumn("base_keep_filtered", F.col("keep_filtered"))
    known = F.create_map(*[F.lit(x) for kv in STATE_OF_CLASS.items() for x in kv])
    state = F.col("state_name") if "state_name" in has else F.col("base_state_key") if "base_state_key" in has else (
        F.coalesce(known[F.col("nominal_class")], F.lit(UNNAMED_STATE)) if "nominal_class" in has else F.lit(UNNAMED_STATE))
    if "label_name" not in has:
        df = df.withColumn("label_name", state.cast("string"))
    else:
        blank = with_facts(df, df.agg((F.count_if(F.coalesce(F.col("label_name").cast("string"), F.lit("")) != "") == 0).alias("__blank")))
        df = blank.withColumn("label_name", F.when(F.col("__blank"), state.cast("string")).otherwise(F.col("label_name"))).drop("__blank")
    label = F.trim(F.coalesce("label_name", F.lit("")))
    df = df.withColumn("state_name", F.when(label == "", F.col("state_name")).otherwise(label) if "state_name" in has else F.col("label_name"))
    if "group_label" not in has:
        df = df.withColumn("group_label", F.substring_index("state_name", ".", 1))
    return df.withColumn("group_label", F.coalesce("group_label", F.lit("")))


def load_segments(spark: SparkSession, path: str, ids: list[str] | None = None, column: str = "deployment_id") -> DataFrame:
    """A run's segments, of some deployments if ``ids`` are given, under today's names."""
    return standard_segments(load_runs(spark, path, ids, column) if ids else spark.read.parquet(path))
