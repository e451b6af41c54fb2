"""The run summary: eight tables over all deployments in one pass each, no loop over deployments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, functions as F

from ..core.axis import Axis
from ..core.stage import stage
from ..functions.labels import canonical_behavior
from ..operators import budgets, intervals, joins, rest
from ..operators.geo import sun_local_hour

KEYS = ["dataset_id", "deployment_id"]


class SummaryTables(Mapping):
    """Tables by name, each made when it is asked for, from steps that are made once: who reads one table does not pay for the others."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def summary_tables(segments: DataFrame, predictions: DataFrame, depth: DataFrame, location: DataFrame, deployments: DataFrame,
                   features: DataFrame, axis: Axis, depth_threshold_m: float = 2.0, groups: DataFrame | None = None,
                   tolerance_s: float = 43_200.0, feature_tolerance_s: float = 600.0) -> SummaryTables:
    """Summary tables of a segmentation run.

    ``segments``: ids, segment_rank, start_ts, end_ts, state_name, keep_filtered, …; ``predictions``: ids,
    start_ts, end_ts, predicted_label, variant_id; ``depth``: ids, ts, depth; ``location``: ids, ts, latitude,
    longitude; ``deployments``: ids, tz, fallback_latitude, fallback_longitude; ``features``: ids, ts, value.
    """
    algo = rest.method_rows(segments, "algorithmic", "algorithmic_segments", "state_name")
    sup = rest.supervised_rows(predictions, "predicted_label", "variant_id")
    combined = algo.unionByName(sup, allowMissingColumns=True)
    dep = deployments.select(*KEYS, "tz", "fallback_latitude", "fallback_longitude")
    m_keys = [*KEYS, "method", "method_variant"]
    zone = F.coalesce("tz", F.lit("UTC"))

    def flagged() -> DataFrame:
        return stage(overlap_flags(step["combined"].where("positive_label")))

    def putative_rest() -> DataFrame:
        """Local time, nearest position and feature value."""
        mid_axis = axis.with_(order=("segment_midpoint", "start_ts"))
        p = joins.asof(step["flagged"], location.select(*KEYS, F.col("ts").alias("loc_ts"), "latitude", "longitude"), mid_axis, "loc_ts",
                       ["latitude", "longitude"], tolerance_s, prefix="near_")
        p = joins.asof(p, features.select(*KEYS, F.col("ts").alias("feat_ts"), F.col("value").alias("feature_value")), mid_axis, "feat_ts",
                       ["feature_value"], feature_tolerance_s, prefix="snap_")
        p = p.join(dep, KEYS, "left")
        local = F.from_utc_timestamp("segment_midpoint", zone)
        p = p.withColumns({"local_date": F.to_date(local), "local_hour": F.hour(local),
                           "near_latitude": F.coalesce("near_latitude", "fallback_latitude"), "near_longitude": F.coalesce("near_longitude", "fallback_longitude")})
        flags = ["overlap_s", "weak_confusion"]
        return p.select(*[c for c in p.columns if c not in flags], *flags)

    def painted() -> DataFrame:
        """Samples with weights, painted per method."""
        positive = step["combined"].where("positive_label")
        w = budgets.sample_weights(depth, axis).join(dep.select(*KEYS, "tz"), KEYS, "left").select(*KEYS, axis.ts, "depth", "weight_s", "tz")
        base = F.when(F.coalesce(F.col("depth"), F.lit(float("inf"))) < depth_threshold_m, "surfacing").otherwise("diving")
        m_axis = axis.with_(keys=tuple(m_keys))
        samples = w.join(positive.select(*m_keys).distinct(), KEYS)
        iv = positive.select(*m_keys, "start_ts", "end_ts", F.coalesce("state_subtype", "state_label").alias("label"), F.unix_micros("end_ts").alias("rank"))
        x = intervals.paint(samples, iv, m_axis, "start_ts", "end_ts", "label", "rank", base, "state_label_raw")
        local = F.from_utc_timestamp(axis.ts, zone)
        return stage(x.select(*m_keys, F.to_date(local).alias("local_date"), F.hour(local).alias("hour_of_day"), "state_label_raw",
                              canonical_behavior(F.col("state_label_raw")).alias("state_label_canonical"), "weight_s"))

    lab = ["state_label_raw", "state_label_canonical"]
    hours = (F.sum("weight_s") / 3600).alias
    name = F.concat(F.initcap("method"), F.lit(" ("), F.col("method_variant"), F.lit(")"))

    def daily() -> DataFrame:
        d = step["painted"].groupBy(*m_keys, "local_date", *lab).agg(hours("duration_h"))
        return d.withColumn("pct_of_24h", F.col("duration_h") * 100 / 24)

    def sun() -> DataFrame:
        loc = location.join(dep, KEYS, "left")
        where = loc.groupBy(*KEYS, F.to_date(F.from_utc_timestamp("ts", zone)).alias("local_date")).agg(
            F.avg("latitude").alias("mean_latitude"), F.avg("longitude").alias("mean_longitude"))
        x = step["painted"].select(*KEYS, "local_date").distinct().join(where, [*KEYS, "local_date"], "left").join(dep, KEYS, "left")
        x = x.withColumns({"mean_latitude": F.coalesce("mean_latitude", "fallback_latitude"), "mean_longitude": F.coalesce("mean_longitude", "fallback_longitude")})
        x = x.withColumns({f"{k}_local_hour": sun_local_hour(F.col("local_date"), F.col("mean_latitude"), F.col("mean_longitude"), zone, k == "sunrise")
                           for k in ("sunrise", "sunset")})
        return stage(x.drop("tz", "fallback_latitude", "fallback_longitude"))

    def with_sun(df: DataFrame) -> DataFrame:
        return df.join(step["sun"], [*KEYS, "local_date"], "left").withColumn("method_label", name)

    def hourly() -> DataFrame:
        h = step["painted"].groupBy(*m_keys, "local_date", "hour_of_day", *lab).agg(hours("duration_h"))
        tot = step["painted"].groupBy(*m_keys, "local_date", "hour_of_day").agg(hours("hour_total_h"))
        return with_sun(h.join(tot, [*m_keys, "local_date", "hour_of_day"]).withColumn(
            "pct_of_observed_hour", F.col("duration_h") * 100 / F.nullif(F.col("hour_total_h"), F.lit(0.0))))

    def compare() -> DataFrame:
        d = step["daily"].withColumn("method_label", name)
        g = d.join(groups, ["deployment_id"], "left") if groups is not None else d.withColumn("group_name", F.lit(None).cast("string"))
        g = g.withColumn("group_name", F.coalesce("group_name", F.lit("Unknown")))
        return budgets.rollup_levels(g, ["method", "method_variant", "method_label", "state_label_canonical"], "deployment_id", "dataset_id", "group_name",
                                     ["duration_h", "pct_of_24h"])

    step = SummaryTables({"combined": lambda: stage(combined), "flagged": flagged, "painted": painted, "daily": daily, "sun": sun})
    return SummaryTables({
        "segmentation_summary": lambda: step["combined"],
        "putative_rest_summary": putative_rest,
        "overlap_counts": lambda: step["flagged"].groupBy("method", "weak_confusion").agg(F.count(F.lit(1)).alias("n")),
        "method_daily_budget": lambda: with_sun(step["daily"]),
        "method_hourly_budget": hourly,
        "daily_activity": lambda: step["daily"].groupBy(*KEYS, "local_date", "state_label_raw").agg(F.sum("duration_h").alias("duration_h")),
        "group_comparison": compare,
        "method_metadata": lambda: step["combined"].select(*KEYS, "method", "method_variant").distinct().join(dep.select(*KEYS, "tz"), KEYS, "left"),
    })


def overlap_flags(rows: DataFrame) -> DataFrame:
    """Largest overlap with the other method per row: tp where there is any, else fp (supervised) or fn (algorithmic)."""
    d = rows.withColumn("__rid", F.struct(*KEYS, "method", "method_variant", "start_ts", "end_ts", "state_label"))
    parts = []
    for mine, other in (("supervised", "algorithmic"), ("algorithmic", "supervised")):
        r = d.where(F.col("method") == other).select(*KEYS, F.col("start_ts").alias("o_start"), F.col("end_ts").alias("o_end"))
        parts.append(intervals.max_overlap(d.where(F.col("method") == mine), r, KEYS, "__rid", ("start_ts", "end_ts"), ("o_start", "o_end")))
    out = parts[0].unionByName(parts[1])
    return out.withColumn("weak_confusion", F.when(F.col("overlap_s") > 0, "tp").when(F.col("method") == "supervised", "fp").otherwise("fn")).drop("__rid")


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """One parquet table each, partitioned by dataset where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("dataset_id") if "dataset_id" in df.columns else w).parquet(f"{path}/{name}")
