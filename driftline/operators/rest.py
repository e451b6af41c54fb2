"""Rest-candidate detection and the segment tables built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.facts import with_facts
from ..core.axis import CHUNK, Axis
from ..core.runs import find_runs, label_runs
from ..core.scan import CORE, HALO, halo_rows, row_frame, scan
from ..functions import labels
from ..schema import seconds_between
from .intervals import midpoint
from .rolling import frame_gradient, frame_sums

# Thresholds and switches of the base detector.
REST_DEFAULTS = {
    "quantize_step": 1.0, "base_smooth_seconds": 6.0, "coarse_smooth_seconds": 12.0, "coarse_interval_threshold_s": 5.0,
    "coarse_resolution_threshold": 1.0, "end_segments_upon_d1_sign_change": True, "filter_out_positive_slopes": False,
    "filter_out_negative_slopes": True, "dive_depth_min_m": 2.0, "first_deriv_abs_max_ms": 0.6, "second_deriv_abs_max_ms2": 0.05,
    "min_duration_s": 180.0, "surface_sleep_min_duration_s": 600.0, "drift_rate_abs_max_ms": 0.55, "end_flat_abs_mean_d1_max_ms": 0.01,
    "unscorable_gap_s": 40.0,
}


# Settings that were renamed, and those of older files that the detector does not read.
RENAMED = {"sign_consistency_required": "end_segments_upon_d1_sign_change"}
NOT_READ = ("covariates", "context_filters", "context_filter_definitions", "debug")


def rest_settings(cfg: dict | None) -> dict:
    """Defaults overlaid by a (possibly nested) configuration; unknown settings are an error.

    A setting under its older name counts unless the present name is there too.
    """
    flat = {k: v for k, v in (cfg or {}).items() if k not in NOT_READ}
    flat.update(flat.pop("thresholds", {}) or {})
    for old, new in RENAMED.items():
        value = flat.pop(old, None)
        flat.setdefault(new, value)
    bad = set(flat) - set(REST_DEFAULTS)
    if bad:
        raise ValueError(f"unknown settings {sorted(bad)}")
    return {**REST_DEFAULTS, **{k: v for k, v in flat.items() if v is not None}}


def quantize(value: Column, step: float) -> Column:
    """Round to a multiple of ``step``, halves to the even one."""
    return F.rint(value / step) * step if step > 0 else value


def derived_channels(df: DataFrame, axis: Axis, depth: str, fs: float, cfg: dict | None = None) -> DataFrame:
    """Standardised depth with its first and second derivative per second.

    Depth is quantised and smoothed; slow or coarse sources get the wider window. All are taken in one cut of the rows (``_cut_channels``).
    """
    cut = _cut_channels(df, axis, depth, fs, rest_settings(cfg), 0)
    return cut.where(CORE).select(*df.columns, "depth_std", "d1", "d2")


def _cut_channels(df: DataFrame, axis: Axis, depth: str, fs: float, c: dict, before: int) -> DataFrame:
    """Rows with their channels in halo chunks that reach far enough for all of them on core rows, and on ``before`` rows ahead of these."""
    coarse = 1.0 / fs >= c["coarse_interval_threshold_s"] or c["quantize_step"] >= c["coarse_resolution_threshold"] and fs < 1
    n = max(1, int(round((c["coarse_smooth_seconds"] if coarse else c["base_smooth_seconds"]) * fs)))
    n += 1 - n % 2
    half = n // 2
    h = halo_rows(df.withColumn("__q", quantize(F.col(depth), c["quantize_step"])), axis, half + 2 + before, half + 2)
    s = frame_sums(h, axis, half, half, ["__q"]).withColumn("depth_std", F.when(F.col("__cnt___q") >= 1, F.col("__sum___q") / F.col("__cnt___q")))
    s = s.withColumn("d1", frame_gradient(s, axis, "depth_std") * fs)
    return s.withColumn("d2", frame_gradient(s, axis, "d1") * fs)


#: Rows up to a segment's last sample whose mean slope says whether it ends flat.
END_ROWS = 5


def detect_rest(df: DataFrame, axis: Axis, cfg: dict | None = None) -> DataFrame:
    """Candidate segments with their class: surface_sleep, long_flat, long_drift or not_sleep.

    Input has ``depth_std, d1, d2`` (see ``derived_channels``). Families are surface intervals and runs of
    small slope and curvature below the surface; a change of slope sign may end a run. The decision tree
    is compiled to columns over per-segment aggregates, merged across chunk edges like any run.
    """
    return _segments(halo_rows(df, axis, END_ROWS - 1, 0), axis, rest_settings(cfg))


def rest_candidates(df: DataFrame, axis: Axis, depth: str, fs: float, cfg: dict | None = None) -> DataFrame:
    """``detect_rest`` of the ``derived_channels``: rows are cut once for both, and runs are found in the same chunks."""
    c = rest_settings(cfg)
    return _segments(_cut_channels(df, axis, depth, fs, c, END_ROWS - 1), axis, c)


def _segments(h: DataFrame, axis: Axis, c: dict) -> DataFrame:
    """Segments of rows in halo chunks that hold the ``END_ROWS`` rows up to each core row."""
    surface = F.col("depth_std") < c["dive_depth_min_m"]
    calm = (F.abs("d1") <= c["first_deriv_abs_max_ms"]) & (F.abs("d2") <= c["second_deriv_abs_max_ms2"])
    family = F.when(surface, F.lit("surface")).when(calm, F.lit("drift_candidate"))
    sign = F.when(F.col("d1") < 0, "-").otherwise("+") if c["end_segments_upon_d1_sign_change"] else F.lit("")
    code = F.when(family == "drift_candidate", F.concat(family, sign)).otherwise(family)
    ended = h.withColumn("__end_d1", F.avg("d1").over(row_frame(axis, END_ROWS - 1, 0))).where(CORE)
    ended = ended.select(*dict.fromkeys([*axis.keys, *axis.order, "depth_std", "d1", "d2"]), "__end_d1", F.col(HALO).alias(CHUNK))
    runs = find_runs(ended, axis, code, {
        "first_depth": ("first", "depth_std"), "last_depth": ("last", "depth_std"), "end_d1": ("last", "__end_d1"), "start_depth_m": ("first", "depth_std")},
        F.col("value").isNotNull())
    dur = seconds_between("start_ts", "end_ts")
    seg = runs.withColumn("duration_s", dur).withColumn(
        "drift_rate_ms", F.try_divide(F.col("last_depth") - F.col("first_depth"), F.col("duration_s")))
    fam = F.when(F.col("value") == "surface", "surface").otherwise("drift_candidate")
    flat = F.abs("end_d1") <= c["end_flat_abs_mean_d1_max_ms"]
    slope_ok = F.lit(True)
    if c["filter_out_positive_slopes"]:
        slope_ok = slope_ok & ~(F.col("drift_rate_ms") > 0)
    if c["filter_out_negative_slopes"]:
        slope_ok = slope_ok & ~(F.col("drift_rate_ms") < 0)
    drift = (F.abs("drift_rate_ms") <= c["drift_rate_abs_max_ms"]) & slope_ok
    cls = F.when((fam == "surface") & (F.col("duration_s") >= c["surface_sleep_min_duration_s"]), "surface_sleep").when(
        (fam == "drift_candidate") & (F.col("duration_s") >= c["min_duration_s"]),
        F.when(flat, "long_flat").when(F.coalesce(drift, F.lit(False)), "long_drift").otherwise("not_sleep")).otherwise("not_sleep")
    return seg.select(*axis.keys, "start_ts", "end_ts", "n", "duration_s", fam.alias("segment_family"), "start_depth_m", "end_d1",
                      "drift_rate_ms", F.when(F.col("drift_rate_ms") < 0, "negative").otherwise("positive").alias("segment_sign"),
                      cls.alias("base_nominal_class"), (cls != "not_sleep").alias("base_keep_filtered"))


def segment_drift_rate(df: DataFrame, axis: Axis, predicate: Column, depth: str) -> DataFrame:
    """Least-squares depth change per second in each run of a predicate."""
    rows = label_runs(df, axis, F.coalesce(predicate, F.lit(False))).where(predicate)
    t = seconds_between("run_start", axis.ts)
    return rows.groupBy(*axis.keys, "run_start").agg(F.regr_slope(depth, t).alias("drift_rate_ms"), F.count(F.lit(1)).alias("n"))


def exhaustive_states(df: DataFrame, axis: Axis, rest_label: str, surface: Column, active: Column, step_s: Column, gap_s: float,
                      flat: Column) -> DataFrame:
    """One class per instant, as contiguous states: resting kinds, active or calm under water or at the surface,
    and ``unscorable`` where a long gap shows no movement.
    """
    place = F.when(surface, "surface").otherwise("uw")
    base = F.concat_ws("_", F.when(active, "active").otherwise("calm"), place)
    unscorable = (step_s >= gap_s) & flat
    cls = F.when(F.coalesce(unscorable, F.lit(False)), F.lit("unscorable")).when(F.col(rest_label).isNotNull(), F.col(rest_label)).otherwise(base)
    return find_runs(df, axis, cls).withColumnRenamed("value", "state").withColumn("duration_s", seconds_between("start_ts", "end_ts"))


def smoothed_metric(segments: DataFrame, axis: Axis, metric: str, subset: Column, fraction: float, out: str, negative_max: float,
                    positive_min: float) -> DataFrame:
    """Centred rolling mean of a segment metric over a fraction of the entity's segments, with its phase.

    The window grows with the entity, so it is taken as a difference of running sums looked up by row
    number: two equi-joins on (entity, number), no frame. Segments outside the subset take the value
    interpolated between their neighbours.
    """
    keys = list(axis.keys)
    sub = scan(segments.where(subset & F.col(metric).isNotNull()).select(*keys, *axis.order, metric), axis,
               index="__i", run_sum={"__cs": metric})
    n = sub.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    half = F.floor(F.greatest(F.floor(F.col("__n") * fraction), F.lit(1)) / 2)
    w = sub.join(n, keys).withColumns({"__hi": F.least(F.col("__i") + half, F.col("__n") - 1), "__lo": F.greatest(F.col("__i") - half, F.lit(0)) - 1})
    at = lambda name, val: sub.select(*keys, F.col("__i").alias(name), F.col("__cs").alias(val))
    w = w.join(at("__hi", "__chi"), [*keys, "__hi"]).join(at("__lo", "__clo"), [*keys, "__lo"], "left")
    w = w.select(*keys, *axis.order, ((F.col("__chi") - F.coalesce("__clo", F.lit(0.0))) / (F.col("__hi") - F.col("__lo"))).alias(out))
    from .timebase import linear_fill
    j = linear_fill(segments.join(w, [*keys, *axis.order], "left"), axis, [out], "both")
    phase = F.when(F.col(out) <= negative_max, "negative").when(F.col(out) >= positive_min, "positive").when(F.col(out).isNotNull(), "neutral")
    return j.withColumn(f"{out}_phase", phase)


def trip_phase(segments: DataFrame, keys: list[str], day: str, value: str, phase: str, cfg: dict | None = None, depth: str | None = None) -> DataFrame:
    """Where a trip turns positive: pre_positive / post_positive / never_positive / always_positive, with reference means.

    The turning day is the first plausible positive day minus a backtrack; positive days right before
    arrival only count when there is no other. One aggregate per entity and a join back.
    """
    c = {"min_positive_elapsed_days": 20.0, "backtrack_days": 20.0, "always_positive_max_day": 20.0, "near_arrival_exclusion_days": 5.0,
         "early_window_days": 15.0, "late_window_days": 15.0, "reference_max_start_depth_m": 500.0, **(cfg or {})}
    d = F.col(day)
    last = segments.groupBy(*keys).agg(F.max(day).alias("__last"))
    s = segments.join(last, keys)
    pos = (F.col(phase) == "positive") & (d >= c["min_positive_elapsed_days"])
    shallow = F.col(depth) <= c["reference_max_start_depth_m"] if depth else F.lit(True)
    a = s.groupBy(*keys).agg(
        F.min(F.when(pos & (d <= F.col("__last") - c["near_arrival_exclusion_days"]), d)).alias("__clear"), F.min(F.when(pos, d)).alias("__any"),
        F.max(F.when(F.col(phase) == "negative", d)).alias("__neg"), F.min(F.when(F.col(phase) == "positive", d)).alias("__first"),
        F.avg(F.when((d < c["early_window_days"]) & shallow, F.col(value))).alias("early_reference_value"),
        F.avg(F.when((d > F.col("__last") - c["late_window_days"]) & shallow, F.col(value))).alias("late_reference_value"))
    seen = F.coalesce("__clear", "__any")
    turn = F.when(seen.isNotNull(), F.greatest(seen - c["backtrack_days"], F.lit(0.0)))
    a = a.withColumn("positive_likely_day", turn).withColumn(
        "__always", F.coalesce(F.col("__neg").isNull() & (F.col("__first") <= c["always_positive_max_day"]), F.lit(False)))
    j = segments.join(a.drop("__clear", "__any", "__neg", "__first"), keys)
    return j.withColumn("trip_phase", F.when(F.col("__always"), "always_positive").when(F.col("positive_likely_day").isNull(), "never_positive").when(
        d < F.col("positive_likely_day"), "pre_positive").otherwise("post_positive")).drop("__always")


# Label of each base class.
NOMINAL_LABELS = {"surface_sleep": "putative_rest.surface_sleep", "long_flat": "putative_rest.benthic_sleep",
                  "long_drift": "putative_rest.drift_sleep", "not_sleep": "find_rest.not_sleep"}


def prepare_segments(df: DataFrame) -> DataFrame:
    """Segment table with duration, midpoint, keep flags, label, state name and group filled in from what is there."""
    have = set(df.columns)
    out = df
    if "duration_s" not in have:
        out = out.withColumn("duration_s", F.col("duration").cast("double") if "duration" in have else seconds_between("start_ts", "end_ts"))
    if "segment_midpoint" not in have:
        out = out.withColumn("segment_midpoint", midpoint("start_ts", "end_ts"))
    if "keep_filtered" not in have:
        out = out.withColumn("keep_filtered", F.col("context_keep") if "context_keep" in have else F.lit(True))
    if "base_keep_filtered" not in have:
        out = out.withColumn("base_keep_filtered", F.col("keep_filtered"))
    if "label_name" not in have:
        if "state_name" in have:
            name = F.col("state_name")
        elif "base_state_key" in have:
            name = F.col("base_state_key")
        elif "nominal_class" in have:
            name = F.coalesce(*[F.when(F.col("nominal_class") == k, v) for k, v in NOMINAL_LABELS.items()], F.lit("putative_rest.unfiltered"))
        else:
            name = F.lit("putative_rest.unfiltered")
        out = out.withColumn("label_name", name)
    blank = F.coalesce(F.trim("label_name"), F.lit("")) == ""
    out = out.withColumn("state_name", F.when(blank, F.col("state_name") if "state_name" in have else F.lit("")).otherwise(F.trim("label_name")))
    return out.withColumn("group_label", F.coalesce(F.substring_index("state_name", ".", 1), F.lit(""))) if "group_label" not in have else out


def method_rows(df: DataFrame, method: str, variant: Column | str, label: str, exhaustive: bool = False, mapping: dict | None = None) -> DataFrame:
    """Segments or predicted windows in the common method layout with subtype, positive flag and midpoint."""
    sub = labels.rest_subtype(F.col(label), mapping or labels.REST_SUBTYPE)
    keep = F.coalesce("keep_filtered", F.lit(False)) if "keep_filtered" in df.columns and not exhaustive else F.lit(exhaustive)
    return df.withColumns({"method": F.lit(method), "method_variant": F.lit(variant) if isinstance(variant, str) else variant,
                           "state_label": F.trim(label), "state_subtype": sub, "duration_s": seconds_between("start_ts", "end_ts"),
                           "segment_midpoint": midpoint("start_ts", "end_ts")}).withColumn("positive_label", F.col("state_subtype").isNotNull() & keep)


def positive_label(df: DataFrame, label: str) -> DataFrame:
    """The label that means rest: exactly "sleep" first, else the first by name containing it (one row)."""
    t = F.lower(F.trim(label))
    rank = F.when(t == "sleep", 0).when(t.contains("sleep"), 1)
    return df.agg(F.min_by(F.trim(label), F.when(rank.isNotNull(), F.struct(rank, F.trim(label)))).alias("positive"))


def supervised_rows(df: DataFrame, label: str, variant: str | None = None) -> DataFrame:
    """Predicted windows (start_ts, end_ts) as method rows; the rest label becomes ``putative_rest``."""
    p = positive_label(df, label)
    hit = F.col("state_label") == F.col("positive")
    out = df.withColumns({"method": F.lit("supervised"), "method_variant": F.col(variant) if variant else F.lit("rf_full"), "state_label": F.trim(label),
                          "duration_s": seconds_between("start_ts", "end_ts"), "segment_midpoint": midpoint("start_ts", "end_ts")})
    out = with_facts(out, p)
    return out.withColumns({"positive_label": F.coalesce(hit, F.lit(False)), "state_subtype": F.when(hit, "putative_rest")}).drop("positive")


def map_label_groups(df: DataFrame, label: str, groups: dict[str, list[str]], out: str) -> DataFrame:
    """Group of a label from {group: labels}; labels in no group keep their own name. A configuration-sized map, no join."""
    pairs = [F.lit(x) for g, ls in groups.items() for l in ls for x in (l.lower(), g)]
    return df.withColumn(out, F.coalesce(F.create_map(*pairs)[F.lower(F.trim(label))], F.col(label)))


def rest_index(df: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Kept rest segments with their review category."""
    cat = F.coalesce(*[F.when(F.col("base_nominal_class") == k, v) for k, v in categories.items()], F.lit("other"))
    return df.withColumn("rest_category", cat).where(F.coalesce("keep_filtered", F.lit(False)) & (F.col("base_nominal_class") != "not_sleep"))
