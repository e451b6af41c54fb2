"""Schema standardisation: channel renaming, splitting into signals, unit handling, metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..core.axis import Axis
from ..functions import units


def rename_plan(columns: list[str], mapping: dict[str, tuple[str, str | None]], local_time: bool = True) -> dict[str, str]:
    """Column -> standard name from a channel mapping {original: (standard, parent signal)}; schema-sized, no job.

    Units in brackets are ignored when matching; unmapped time columns get a ``_local``/``_utc`` suffix;
    a clash is resolved by ``__<parent>`` and then by ``__dup<N>``.
    """
    key = lambda s: re.sub(r"[\s\-]+", "_", re.sub(r"\s*[\[\(][^\]\)]*[\]\)]\s*$", "", s).strip().lower())
    by_key = {key(k): v for k, v in mapping.items()}
    taken: set[str] = set()
    plan = {}
    for c in columns:
        name, parent = by_key.get(key(c), (key(c), None))
        if name in ("date", "time") and key(c) not in by_key:
            name += "_local" if local_time else "_utc"
        if name in taken and parent:
            name = f"{name}__{parent}"
        base, i = name, 1
        while name in taken:
            name, i = f"{base}__dup{i}", i + 1
        taken.add(name)
        plan[c] = name
    return plan


def rename_channels(df: DataFrame, mapping: dict[str, tuple[str, str | None]], local_time: bool = True) -> DataFrame:
    plan = rename_plan(df.columns, mapping, local_time)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in plan.items()])


def split_signals(df: DataFrame, keys: list[str], ts: str, mapping: dict[str, str]) -> DataFrame:
    """Wide logger frame to long rows (signal, channel, value); non-numeric and unmapped channels are skipped.

    ``mapping``: channel -> parent signal. Narrow: no shuffle.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name in mapping]
    long = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([*keys, ts], numeric, "channel", "value")
    sig = F.create_map(*[F.lit(x) for c in numeric for x in (c, mapping[c])])
    return long.withColumn("signal", sig[F.col("channel")]).where(F.col("value").isNotNull())


def signal_stats(long: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One metadata row per signal and channel: extent, count, min, max, mean."""
    return long.groupBy(*keys, "signal", "channel").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("value").alias("n"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def standardize_acceleration(df: DataFrame, columns: list[str], unit: str, target: str = "m/s^2") -> DataFrame:
    """Acceleration in the target unit; the unit column is rewritten, so a second call changes nothing."""
    return df.withColumns({c: units.convert(F.col(c).cast("double"), F.col(unit), target) for c in columns}).withColumn(unit, F.lit(target))


def standardize_rate(df: DataFrame, column: str, unit: str, target: str = "spm") -> DataFrame:
    """Stroke or beat rates per minute from counts per 5 s or Hz; other units are left as they are."""
    known = units.unit_token(F.col(unit)).isin("count/5s", "hz", target)
    return df.withColumn(column, units.convert(F.col(column), F.col(unit), target, strict=False)).withColumn(
        unit, F.when(known, F.lit(target)).otherwise(F.col(unit)))


def clean_archival(df: DataFrame, depth: str, velocity: str, light: str, max_light: float = 60000.0, max_velocity: float = 2.0) -> DataFrame:
    """Depth sign inverted; velocity zeroed where strong light says the animal is at the surface."""
    bad = (F.col(light) > max_light) & (F.col(velocity) > max_velocity)
    return df.withColumns({depth: -F.col(depth), velocity: F.when(F.coalesce(bad, F.lit(False)), 0.0).otherwise(F.col(velocity))})


def calibrate_angle(df: DataFrame, keys: list[str], column: str, threshold: float, scale: float, offset: float) -> DataFrame:
    """Raw converter counts to degrees, for entities in which any value exceeds ``threshold``."""
    raw = df.groupBy(*keys).agg((F.max(F.abs(column)) > threshold).alias("__raw"))
    return df.join(raw, keys).withColumn(column, F.when(F.col("__raw"), F.col(column) * scale + offset).otherwise(F.col(column))).drop("__raw")


# Rates in Hz to which dense signal types are brought on import.
TARGET_HZ = {"eeg": 100.0, "eog": 100.0, "emg": 100.0, "ecg": 250.0}


def decimation_step(signal_type: Column, fs: Column) -> Column:
    """Integer factor down to the target rate of a signal type; 1 where the factor is not whole or not above 1."""
    t = F.create_map(*[F.lit(x) for kv in TARGET_HZ.items() for x in kv])[F.lower(signal_type)]
    f = fs / t
    return F.when((f > 1) & (f == F.floor(f)), F.floor(f)).otherwise(F.lit(1)).cast("int")


def group_by_rate(info: DataFrame, keys: list[str], signal: str, fs: str) -> DataFrame:
    """Signals that end up on one rate, as a sorted array per rate (a handful of signals per entity)."""
    rate = F.col(fs) / decimation_step(F.col(signal), F.col(fs))
    return info.groupBy(*keys, rate.alias("rate_hz")).agg(F.array_sort(F.collect_set(signal)).alias("signals"))


def frames_by_rate(frames: dict[str, DataFrame], fs: dict[str, float], axis: Axis) -> dict[int, DataFrame]:
    """One frame per whole rate: each signal is decimated to its type's target, brought to the whole rate by means if it is none, and merged
    with the others that land on the same rate by an outer merge on time.

    ``frames``: signal -> its recording (keys, time, one column named like the signal). Signals are a recorder's channels, a handful.
    """
    from .joins import outer_merge
    from .rolling import decimate
    from .timebase import resample
    groups: dict[int, list[DataFrame]] = {}
    on = [*axis.keys, axis.ts]
    for name, df in frames.items():
        hz, target = fs[name], TARGET_HZ.get(name.lower())
        step = int(hz / target) if target and hz > target and hz % target == 0 else 1
        d = decimate(df, axis, step, {name: name}) if step > 1 else df
        rate = int(hz / step)
        if rate and rate != hz / step:
            d = resample(d, axis, 1.0 / rate, {name: ("mean", name)}, fill_grid=False).withColumnRenamed("bin_ts", axis.ts)
        groups.setdefault(rate, []).append(d.select(*on, name))
    return {rate: outer_merge(parts, on) for rate, parts in sorted(groups.items(), reverse=True)}


def recomputed_name(signal: Column, logger: Column) -> Column:
    """Signals recomputed by derived loggers get the suffix ``_2``."""
    return F.when(F.lower(logger).contains("derived"), F.concat(signal, F.lit("_2"))).otherwise(signal)


def attach_metadata(df: DataFrame, key: str, fallback: str, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Description columns by key, else by fallback key; the first non-blank entry of a key wins.

    ``meta``: key, position, columns.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = meta.groupBy("key").agg(*[F.min_by(blank(F.col(c)), F.when(blank(F.col(c)).isNotNull(), F.col("position"))).alias(c) for c in columns])
    a = m.select(F.col("key").alias("__ka"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = m.select(F.col("key").alias("__kb"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    j = df.join(a, F.col(key) == F.col("__ka"), "left").join(b, F.col(fallback) == F.col("__kb"), "left")
    return j.withColumns({c: F.coalesce(f"__a_{c}", f"__b_{c}") for c in columns}).select(*df.columns, *columns)


def drop_intermediate(long: DataFrame, names: list[str], signal: str = "signal") -> DataFrame:
    return long.where(~F.col(signal).isin(names))


def layered_parameters(deployment: DataFrame, dataset: DataFrame, dataset_key: str, names: list[str]) -> DataFrame:
    """Deployment parameters over dataset defaults; non-null wins."""
    d = dataset.select(dataset_key, *[F.col(n).alias(f"__d_{n}") for n in names])
    return deployment.join(d, dataset_key, "left").withColumns({n: F.coalesce(n, f"__d_{n}") for n in names}).drop(*[f"__d_{n}" for n in names])
