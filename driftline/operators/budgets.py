"""Time budgets, rollups and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core.axis import Axis
from ..core.scan import scan
from ..core.stats import median
from ..functions.special import correlation_p
from ..schema import seconds_between
from .timebase import best_lag, lag_curve


def sample_weights(df: DataFrame, axis: Axis, default_s: float = 60.0, out: str = "weight_s") -> DataFrame:
    """Seconds until the next sample; the last sample gets the entity's median step (or the default)."""
    keys = list(axis.keys)
    s = scan(df, axis, nxt={"__next": axis.ts}).withColumn("__w", seconds_between(axis.ts, "__next"))
    med = median(s, keys, "__w", "__med")
    last = F.when(F.col("__med") > 0, F.col("__med")).otherwise(F.lit(default_s))
    return s.join(med, keys, "left").withColumn(out, F.coalesce("__w", last)).drop("__next", "__w", "__med")


def daily_budget(df: DataFrame, keys: list[str], ts: str, label: str, weight_s: str = "weight_s", tz: str | Column = "UTC") -> DataFrame:
    """Hours per local day and label, and % of 24 h."""
    day = F.to_date(F.from_utc_timestamp(ts, tz))
    return df.groupBy(*keys, day.alias("local_date"), label).agg((F.sum(weight_s) / 3600).alias("duration_h")).withColumn(
        "pct_of_24h", F.col("duration_h") * 100 / 24)


def hourly_budget(df: DataFrame, keys: list[str], ts: str, label: str, weight_s: str = "weight_s", tz: str | Column = "UTC") -> DataFrame:
    """Hours per local day, hour and label, and % of what was observed in that hour (null when nothing was)."""
    local = F.from_utc_timestamp(ts, tz)
    g = df.groupBy(*keys, F.to_date(local).alias("local_date"), F.hour(local).cast("bigint").alias("hour_of_day"), label).agg(
        (F.sum(weight_s) / 3600).alias("duration_h"))
    total = F.sum("duration_h").over(W.partitionBy(*keys, "local_date", "hour_of_day"))
    return g.withColumn("pct_of_observed_hour", F.col("duration_h") * 100 / F.nullif(total, F.lit(0.0)))


def pivot_states(daily: DataFrame, keys: list[str], label: str, states: list[str], value: str = "duration_h") -> DataFrame:
    """Wide daily view with a fixed set of state columns, zero-filled."""
    return daily.groupBy(*keys).pivot(label, states).agg(F.sum(value)).fillna(0.0, states)


def state_bins(df: DataFrame, keys: list[str], ts: str, label: str, states: list[str], bin_s: float, weight_s: str = "weight_s", wrap_tz: str | None = None) -> DataFrame:
    """Hours per time bin and state, as fixed zero-filled columns. With ``wrap_tz`` bins are laid over days of that zone: a bin that
    midnight parts comes once for each day, with ``local_date`` and ``local_hour``, the bin's start on its day's clock."""
    from .timebase import bucket
    by = [*keys, "bin_ts"]
    d = df.withColumn("bin_ts", bucket(ts, bin_s))
    if wrap_tz:
        local = F.from_utc_timestamp("bin_ts", wrap_tz)
        d = d.withColumns({"local_date": F.to_date(F.from_utc_timestamp(ts, wrap_tz)), "local_hour": F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600})
        by += ["local_date", "local_hour"]
    g = d.groupBy(*by, label).agg((F.sum(weight_s) / 3600).alias("h"))
    return g.groupBy(*by).pivot(label, states).agg(F.sum("h")).fillna(0.0, states)


def mean_location(loc: DataFrame, keys: list[str], ts: str, lat: str, lon: str, fallback: DataFrame | None = None,
                  hourly: bool = False, tz: str = "UTC") -> DataFrame:
    """Mean position per local day (and hour), falling back to the deployment's own point."""
    local = F.from_utc_timestamp(ts, tz)
    by = [F.to_date(local).alias("local_date")] + ([F.hour(local).alias("hour_of_day")] if hourly else [])
    m = loc.groupBy(*keys, *by).agg(F.avg(lat).alias("mean_latitude"), F.avg(lon).alias("mean_longitude"))
    if fallback is None:
        return m
    return m.join(fallback, keys, "left").withColumns({
        "mean_latitude": F.coalesce("mean_latitude", "fallback_latitude"),
        "mean_longitude": F.coalesce("mean_longitude", "fallback_longitude")}).drop("fallback_latitude", "fallback_longitude")


def rollup_levels(daily: DataFrame, measure_keys: list[str], deployment: str, dataset: str, group: str, values: list[str]) -> DataFrame:
    """Deployment means, then dataset and group means of those means, stacked with their level.

    Columns a level collapses are null. Each step aggregates the already small step before it.
    """
    avgs = [F.avg(v).alias(v) for v in values]
    dep = daily.groupBy(*measure_keys, dataset, deployment, group).agg(*avgs)
    null = lambda c: F.lit(None).cast("string").alias(c)
    names = [*measure_keys, dataset, deployment, group, *values]
    level = lambda df, name, key: df.select(*names, F.lit(name).alias("comparison_level"), F.col(key).cast("string").alias("comparison_key"))
    d1 = dep.withColumns({c: F.col(c).cast("string") for c in (dataset, deployment, group)})
    d2 = d1.groupBy(*measure_keys, dataset).agg(*avgs).select("*", null(deployment), null(group))
    d3 = d1.groupBy(*measure_keys, group).agg(*avgs).select("*", null(deployment), null(dataset))
    return level(d1, "deployment", deployment).unionByName(level(d2, "dataset", dataset)).unionByName(level(d3, "group", group))


def budget_table(segments: DataFrame, label: str, seconds: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Hours, % of total and count per class, classes in the preferred order and then by name."""
    keys = keys or []
    g = segments.groupBy(*keys, label).agg((F.sum(seconds) / 3600).alias("hours"), F.count(F.lit(1)).alias("n_segments"))
    total = F.sum("hours").over(W.partitionBy(*keys))  # one row per class
    pos = F.coalesce(*[F.when(F.col(label) == c, F.lit(i)) for i, c in enumerate(order)], F.lit(len(order)))
    g = g.withColumn("pct_of_total", F.col("hours") * 100 / F.nullif(total, F.lit(0.0)))
    return g.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(pos, label)).cast("bigint"))


def confusion_counts(df: DataFrame, method: str, flag: str) -> DataFrame:
    return df.groupBy(method, flag).agg(F.count(F.lit(1)).alias("n"))


def group_day_means(daily: DataFrame, group: str, label: str, value: str = "duration_h") -> DataFrame:
    """Mean hours per group and state, for stacked comparisons."""
    return daily.groupBy(group, label).agg(F.avg(value).alias("mean_h"))


def event_timing(df: DataFrame, keys: list[str], start: str, end: str, tz: str = "UTC") -> DataFrame:
    """Event midpoints as (local day index from 0, decimal hour, hours long); days without events are not counted.

    The index comes from the distinct days of an entity, not from ranking its events.
    """
    from .intervals import midpoint
    local = F.from_utc_timestamp(midpoint(start, end), tz)
    d = df.withColumns({"local_date": F.to_date(local), "duration_h": seconds_between(start, end) / 3600,
                        "decimal_hour": F.hour(local) + F.minute(local) / 60 + (F.unix_micros(local) % 60_000_000) / 3.6e9})
    days = d.select(*keys, "local_date").distinct().withColumn(
        "day_index", (F.row_number().over(W.partitionBy(*keys).orderBy("local_date")) - 1).cast("bigint"))
    return d.join(days, [*keys, "local_date"])


def correlate(binned: DataFrame, axis: Axis, x: str, y: str, max_lag: int, min_pairs: int = 10) -> DataFrame:
    """Pearson, Spearman (average ranks), their p-values and the lag of strongest correlation over aligned bins.

    Input is one row per bin, so an entity's ranks are over its bins, not its samples.
    """
    keys = list(axis.keys)
    d = binned.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(W.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2
    r = d.withColumns({"__rx": rank(x), "__ry": rank(y)})
    head = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson_r"),
                                F.corr("__rx", "__ry").alias("spearman_rho")).where(F.col("n") >= min_pairs)
    head = head.withColumns({"pearson_p": correlation_p(F.col("pearson_r"), F.col("n")), "spearman_p": correlation_p(F.col("spearman_rho"), F.col("n"))})
    b = best_lag(lag_curve(d, axis, x, y, max_lag, min_pairs), keys).withColumnsRenamed({"lag": "best_lag", "r": "best_lag_r"})
    return head.join(b, keys)
