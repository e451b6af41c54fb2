"""Quality control, filter summaries, drift between runs, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..core.facts import with_facts
from ..core.stats import median
from ..functions.labels import split_pipe


def filter_overview(df: DataFrame, target: Column) -> DataFrame:
    """Base, kept and rejected counts with the reject rate for a state selection."""
    base = F.coalesce("base_keep_filtered", F.lit(False)) & target
    kept = F.coalesce("keep_filtered", F.lit(False)) & target
    rej = base & ~F.coalesce("context_keep", F.lit(True))
    return df.agg(F.count_if(base).alias("base_pass_count"), F.count_if(kept).alias("final_kept_count"), F.count_if(rej).alias("context_rejected_count")
                  ).withColumn("reject_rate_pct", F.coalesce(F.try_divide(F.col("context_rejected_count") * 100.0, F.col("base_pass_count")), F.lit(0.0)))


def reject_reasons(df: DataFrame, target: Column) -> DataFrame:
    rej = F.coalesce("base_keep_filtered", F.lit(False)) & target & ~F.coalesce("context_keep", F.lit(True))
    return df.where(rej).select(F.explode(split_pipe(F.col("context_reject_reason"))).alias("reject_reason")).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("count"))


def _stage_of(filter_id: Column) -> Column:
    low = F.lower(filter_id)
    return F.when(low.contains("inferred") | low.contains("buoyancy"), "inferred").otherwise("measured")


def filter_details(df: DataFrame, ids: list[str], keep: list[str]) -> DataFrame:
    """One row per segment and applied filter: passed and value."""
    rows = F.array(*[F.struct(F.lit(i).alias("filter_id"), F.col(f"`{i}_pass`").alias("passed"), F.col(f"`{i}_value`").cast("double").alias("value")) for i in ids])
    return df.select(*keep, F.inline(rows)).where(F.col("passed").isNotNull()).withColumn("filter_stage", _stage_of(F.col("filter_id")))


def filter_summary(df: DataFrame, ids: list[str], target: Column) -> DataFrame:
    """Applied, failed, fail rate and median value per filter."""
    d = filter_details(df.where(target), ids, [])
    med = median(d, ["filter_id"], "value", "median_value")
    a = d.groupBy("filter_id", "filter_stage").agg(F.count(F.lit(1)).alias("applied_count"), F.count_if(~F.col("passed")).alias("failed_count"))
    return a.join(med, "filter_id", "left").withColumn("fail_rate_pct", F.col("failed_count") * 100.0 / F.col("applied_count"))


def stage_funnel(df: DataFrame, unfiltered: int | Column | None = None) -> DataFrame:
    """Candidates before, dropped and left at each of six stages (one aggregate, then unpivoted)."""
    d = df.where(F.col("segment_family") == "drift_candidate")
    base = F.coalesce("base_keep_filtered", F.lit(False))
    st = F.col("context_reject_stage")
    a = d.agg(F.count(F.lit(1)).alias("total"), F.count_if(base).alias("base"), F.count_if(base & (st == "rejected_after_measured_filters")).alias("m"),
              F.count_if(base & (st == "rejected_after_inferred_filters")).alias("i"), F.count_if(F.coalesce("keep_filtered", F.lit(False))).alias("kept"))
    u = F.lit(unfiltered) if isinstance(unfiltered, int) else F.col("total") if unfiltered is None else unfiltered
    am, ai = F.col("base") - F.col("m"), F.col("base") - F.col("m") - F.col("i")
    row = lambda n, b, dr, left, ap: F.struct(F.lit(n).alias("stage"), b.cast("bigint").alias("remaining_before"), dr.cast("bigint").alias("dropped_here"),
                                              left.cast("bigint").alias("remaining_after"), ap.cast("bigint").alias("applied_count"))
    t, bs, z = F.col("total"), F.col("base"), F.lit(0)
    return a.select(F.inline(F.array(
        row("1) unfiltered_rest_candidate", u, z, u, u), row("2) filtered_rest_candidate", t, z, t, t),
        row("3) unfiltered_putative_rest", t, t - bs, bs, t), row("4) rejected_after_measured_filters", bs, F.col("m"), am, bs),
        row("5) rejected_after_inferred_filters", am, F.col("i"), ai, am),
        row("6) rest", ai, F.greatest(ai - F.col("kept"), z), F.col("kept"), ai))))


def presence_matrix(observed: DataFrame, scope: DataFrame, targets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Scope deployments × target channels with presence, unit seen and unit match.

    ``observed``: dataset_id, deployment_id, channel, unit; ``scope``: dataset_id, deployment_id; ``targets``:
    channel, expected_unit. A channel seen without a unit is present and has no unit.
    """
    o = observed
    if aliases is not None:
        a = aliases.groupBy("alias").agg(F.min("channel").alias("__c"))
        o = o.join(a, o.channel == a.alias, "left").withColumn("channel", F.coalesce("__c", "channel")).drop("__c", "alias")
    seen = o.groupBy("dataset_id", "deployment_id", "channel").agg(F.min(F.lower(F.trim("unit"))).alias("unit_seen"), F.lit(True).alias("__here"))
    # The matrix has a row per deployment and target by definition; the salt deals the targets' copies to tasks.
    salts = 8
    wanted = (scope.select("dataset_id", "deployment_id", F.pmod(F.xxhash64("dataset_id", "deployment_id"), F.lit(salts)).alias("__s"))
              .join(targets.select("channel", "expected_unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("__s")), "__s").drop("__s"))
    j = wanted.join(seen, ["dataset_id", "deployment_id", "channel"], "left")
    return j.withColumns({"present": F.col("__here").isNotNull(), "unit_match": F.col("unit_seen") == F.lower(F.trim("expected_unit"))}).drop("__here")


def channel_presence(matrix: DataFrame) -> DataFrame:
    """Presence rate, units seen, datasets covered and per-dataset coverage (JSON) of each channel."""
    per = matrix.groupBy("channel", "dataset_id").agg(F.avg(F.col("present").cast("double")).alias("cov"), F.count_if("present").alias("p"),
                                                      F.count(F.lit(1)).alias("n"), F.collect_set("unit_seen").alias("u"), F.count_if("unit_match").alias("um"))
    cov = F.array_sort(F.collect_list(F.struct("dataset_id", F.round("cov", 4).alias("cov"))))
    return per.groupBy("channel").agg(
        (F.sum("p") / F.sum("n")).alias("presence_rate"), F.count_if(F.col("p") > 0).alias("n_datasets"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("u")))), "|").alias("units_seen"),
        (F.sum("um") == F.sum("p")).alias("units_match"), F.to_json(F.map_from_entries(cov)).alias("coverage_json"))


def signal_qc(observed: DataFrame, keys: list[str], channel: str, expected: list[str]) -> DataFrame:
    """Available and missing expected signals per deployment."""
    want = F.array(*[F.lit(x) for x in expected])
    g = observed.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col(channel).isin(expected), F.col(channel)))).alias("have"))
    return g.select(*keys, F.array_join("have", "|").alias("available_signals"), F.array_join(F.array_except(want, "have"), "|").alias("missing_signals"))


def profile(long: DataFrame, keys: list[str], variable: str, value: str) -> DataFrame:
    """Mean, min, max and count per variable."""
    return long.groupBy(*keys, variable).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def run_drift(old: DataFrame, new: DataFrame, keys: list[str], variable: str, tolerance: float = 0.01) -> DataFrame:
    """Old against new profile per variable: added, lost, changed count, relative differences and verdict.

    Differences are relative to the larger of the old range and the old absolute mean.
    """
    stats = ["mean", "min", "max", "n"]
    o = old.select(*keys, variable, *[F.col(s).alias(f"old_{s}") for s in stats])
    n = new.select(*keys, variable, *[F.col(s).alias(f"new_{s}") for s in stats])
    j = o.join(n, [*keys, variable], "full")
    scale = F.greatest(F.abs(F.col("old_max") - F.col("old_min")), F.abs("old_mean"), F.lit(1e-12))
    rel = {s: F.abs(F.col(f"new_{s}") - F.col(f"old_{s}")) / scale for s in ("mean", "min", "max")}
    j = j.withColumns({f"rel_{s}": e for s, e in rel.items()})
    worst = F.greatest("rel_mean", "rel_min", "rel_max")
    return j.withColumns({"worst_rel": worst, "verdict": F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "lost").when(
        (F.col("old_n") != F.col("new_n")) | (worst > tolerance), "changed").otherwise("unchanged")})


def run_drift_summary(drift: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """Verdict counts and the worst variable per run."""
    return drift.groupBy(*keys).agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("added", "lost", "changed", "unchanged")],
        F.max_by(variable, F.when(F.col("worst_rel") > 0, F.struct("worst_rel", variable))).alias("worst_variable"),
        F.max("worst_rel").alias("worst_rel"))


def classify_drift(df: DataFrame) -> DataFrame:
    """review / recovered / corrected / expected from loss, span and sign facts.

    ``df``: unexpected_lost (count), old_span, new_span, old_min, old_max, new_min, new_max, positive_down.
    """
    tol = 0.01 * F.greatest(F.lit(1.0), F.abs("new_max"))
    flipped = (F.abs(F.col("old_min") + F.col("new_max")) < tol) & (F.abs(F.col("old_max") + F.col("new_min")) < tol)
    corrected = flipped & F.col("positive_down") & (F.col("new_max") > 0)
    return df.withColumn("category", F.when(F.col("unexpected_lost") > 0, "review").when(F.col("new_span") > F.col("old_span") * 1.1, "recovered").when(
        F.coalesce(corrected, F.lit(False)), "corrected").otherwise("expected"))


def fold_means(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_folds"))


def run_diagnostics(df: DataFrame, keys: list[str]) -> DataFrame:
    keep = F.coalesce("keep_filtered", F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_rejected"))


def catalogue(events: DataFrame, keys: list[str], ts: str, kind: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """Events, kinds and recorded minutes per deployment, with the first readiness tier whose condition holds."""
    g = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(kind).alias("n_kinds"),
                                  ((F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 6e7).alias("duration_min"))
    return g.withColumn("tier", reduce(lambda acc, t: acc.when(t[1], t[0]), tiers, F.when(F.lit(False), "")).otherwise("none"))


def label_percentiles(df: DataFrame, keys: list[str], columns: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles of several columns per group, as ``<column>_<point>``."""
    from ..core.stats import quantiles
    out = None
    for c in columns:
        q = quantiles(df, keys, c, {f"{c}_{n}": p for n, p in points.items()})
        out = q if out is None else out.join(q, keys) if keys else with_facts(out, q)
    return out


def sign_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Negative, zero and positive counts and shares with range, mean and the majority sign."""
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_positive"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"))
    return g.withColumns({"pct_negative": F.col("n_negative") * 100.0 / F.col("total"), "pct_positive": F.col("n_positive") * 100.0 / F.col("total"),
                          "verdict": F.when(F.col("n_positive") > F.col("n_negative"), "positive").when(F.col("n_negative") > F.col("n_positive"), "negative").otherwise("mixed")})


def tolerance_band(df: DataFrame, reference: str, tolerance: float, depth: str, max_depth: float) -> DataFrame:
    """Reference ± tolerance for kept drift segments that start above a depth."""
    d = df.where(F.coalesce("keep_filtered", F.lit(False)) & (F.col(depth) <= max_depth))
    return d.withColumns({"band_low": F.col(reference) - tolerance, "band_high": F.col(reference) + tolerance})


def review_options(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Deployments and the methods present for them: observed, cluster, algorithmic, supervised, …"""
    parts = [df.select(*keys, F.lit(name).alias("method")).distinct() for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
