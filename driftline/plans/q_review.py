"""Rules, rest detection, quality control and the run summary on segments of the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.scan import IDX
from ..functions import labels
from ..operators import islands, qc, rest, rules, timebase as tb
from ..schema import seconds_between
from ..sources.tables import load, signal_axis, signals
from .q_islands import runs_sql, us
from .registry import SIG, query
from .summary import summary_tables


def r(c, n=6):
    return F.round(c, n).alias(c)


# Segments: runs above 20 with a drift-like rate, start depth and trip day.
SEG = runs_sql('value > 20', ', arg_min(k, (us, event_id)) AS d0, arg_max(k, (us, event_id)) AS d1, avg(value) AS mv') + """,
  seg AS (SELECT user_id, s, e, n, (e - s) / 1e6 AS dur, d0 AS start_depth_m, (d1 - d0) / 100 AS drift_rate_ms, mv AS stroke, (s - min(s) OVER (PARTITION BY user_id)) / 86400e6 AS elapsed_days,
     CASE WHEN d1 < d0 THEN 'negative' ELSE 'positive' END AS segment_sign FROM runs WHERE p)"""


def segs(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 20, aggs={
        "d0": ("first", "k"), "d1": ("last", "k"), "sv": ("sum", "value")})
    first = s.groupBy("user_id").agg(F.min("start_ts").alias("__t0"))
    s = s.join(first, "user_id")
    return s.select("user_id", "start_ts", "end_ts", "n", "duration_s", F.col("d0").alias("start_depth_m"), ((F.col("d1") - F.col("d0")) / 100).alias("drift_rate_ms"),
                    (F.col("sv") / F.col("n")).alias("segment_mean_stroke_rate_spm"), (seconds_between("__t0", "start_ts") / 86400).alias("elapsed_days"),
                    F.when(F.col("d1") < F.col("d0"), "negative").otherwise("positive").alias("segment_sign"),
                    F.lit("drift_candidate").alias("segment_family"), F.lit("long_drift").alias("base_nominal_class"), F.lit("find_rest.long_drift").alias("base_state_key"),
                    (F.col("n") >= 2).alias("base_keep_filtered"))


FILTERS = [
    {"id": "low_stroke_rate_required", "rule": {"mode": "threshold_gate", "field": "segment_mean_stroke_rate_spm", "keep_if": {"comparator": "<", "threshold": 60.0}},
     "reject_reason": "stroke_rate_too_high", "target_state_keys": ["find_rest.long_drift"]},
    {"id": "plausible_drift", "rule": {"mode": "threshold_gate", "value_expr": "abs(drift_rate_ms - start_depth_m / 200)", "keep_if": {"comparator": "<", "threshold": 0.5}},
     "reject_reason": "drift_mismatch", "on_missing_covariate": "reject"},
    {"id": "early_negative_only", "applies_when": {"elapsed_days": {"comparator": "<", "threshold": 15.0}, "segment_sign_in": ["positive", "negative"]},
     "rule": {"mode": "category_gate", "field": "segment_sign", "allowed_values": ["negative"]}, "reject_reason": "early_positive"},
]

VERDICT = SEG + """, v AS (SELECT *, n >= 2 AS base, stroke < 60 AS p1, abs(drift_rate_ms - start_depth_m / 200) < 0.5 AS p2, segment_sign = 'negative' AS p3 FROM seg),
  f1 AS (SELECT *, base AND p1 AS pm FROM v), f2 AS (SELECT *, pm AND p2 AND (elapsed_days >= 15 OR p3) AS ok FROM f1),
  vd AS (SELECT *, nullif(concat_ws('|', CASE WHEN base AND NOT p1 THEN 'stroke_rate_too_high' END, CASE WHEN pm AND NOT p2 THEN 'drift_mismatch' END, CASE WHEN pm AND elapsed_days < 15 AND NOT p3 THEN 'early_positive' END), '') AS why,
    CASE WHEN base AND NOT pm THEN 'rejected_after_measured_filters' WHEN pm AND NOT ok THEN 'rejected_after_inferred_filters' END AS stage FROM f2)"""


def verdicts(spark, d):
    return rules.final_class(rules.apply_filters(segs(spark, d), FILTERS))


@query("g9_context_filters", f"""WITH {VERDICT} SELECT user_id, s AS start_us, ok AS context_keep, why AS context_reject_reason, stage AS context_reject_stage,
  CASE WHEN base THEN p1 END AS low_stroke_rate_required_pass, CASE WHEN pm THEN round(abs(drift_rate_ms - start_depth_m / 200), 6) END AS plausible_drift_value, CASE WHEN ok THEN 'long_drift' ELSE 'not_sleep' END AS nominal_class FROM vd""")
def g9(spark, d):
    return verdicts(spark, d).select("user_id", us("start_ts", "start_us"), "context_keep", "context_reject_reason", "context_reject_stage",
                                     "low_stroke_rate_required_pass", r("plausible_drift_value"), "nominal_class")


@query("g10_measured_only", f"WITH {VERDICT} SELECT user_id, s AS start_us, pm AS context_keep FROM vd")
def g10(spark, d):
    return rules.apply_filters(segs(spark, d), FILTERS, mode="measured_only").select("user_id", us("start_ts", "start_us"), "context_keep")


@query("a11_filter_overview", f"WITH {VERDICT} SELECT count(*) FILTER (base) AS base_pass_count, count(*) FILTER (ok) AS final_kept_count, count(*) FILTER (base AND NOT ok) AS context_rejected_count, round(100.0 * count(*) FILTER (base AND NOT ok) / count(*) FILTER (base), 6) AS reject_rate_pct FROM vd")
def a11(spark, d):
    return qc.filter_overview(verdicts(spark, d), F.lit(True)).withColumn("reject_rate_pct", F.round("reject_rate_pct", 6))


@query("a11_reject_reasons", f"WITH {VERDICT} SELECT reject_reason, count(*) AS count FROM (SELECT unnest(string_split(why, '|')) AS reject_reason FROM vd WHERE base AND NOT ok) GROUP BY 1")
def a11r(spark, d):
    return qc.reject_reasons(verdicts(spark, d), F.lit(True))


IDS = [f["id"] for f in FILTERS]


@query("a11_filter_summary", f"""WITH {VERDICT} SELECT 'low_stroke_rate_required' AS filter_id, count(*) FILTER (base) AS applied_count, count(*) FILTER (base AND NOT p1) AS failed_count, round(median(CASE WHEN base THEN stroke END), 5) AS median_value FROM vd
  UNION ALL SELECT 'plausible_drift', count(*) FILTER (pm), count(*) FILTER (pm AND NOT p2), round(median(CASE WHEN pm THEN abs(drift_rate_ms - start_depth_m / 200) END), 5) FROM vd
  UNION ALL SELECT 'early_negative_only', count(*) FILTER (pm AND elapsed_days < 15), count(*) FILTER (pm AND elapsed_days < 15 AND NOT p3), NULL FROM vd""")
def a11s(spark, d):
    return qc.filter_summary(verdicts(spark, d), IDS, F.lit(True)).select("filter_id", "applied_count", "failed_count", r("median_value", 5))


@query("a12_stage_funnel", f"""WITH {VERDICT}, a AS (SELECT count(*) AS t, count(*) FILTER (base) AS b, count(*) FILTER (stage = 'rejected_after_measured_filters') AS m, count(*) FILTER (stage = 'rejected_after_inferred_filters') AS i, count(*) FILTER (ok) AS k FROM vd)
  SELECT '1) unfiltered_rest_candidate' AS stage, t AS remaining_before, 0::BIGINT AS dropped_here, t AS remaining_after, t AS applied_count FROM a UNION ALL SELECT '2) filtered_rest_candidate', t, 0, t, t FROM a UNION ALL SELECT '3) unfiltered_putative_rest', t, t - b, b, t FROM a
  UNION ALL SELECT '4) rejected_after_measured_filters', b, m, b - m, b FROM a UNION ALL SELECT '5) rejected_after_inferred_filters', b - m, i, b - m - i, b - m FROM a UNION ALL SELECT '6) rest', b - m - i, greatest(b - m - i - k, 0), k, b - m - i FROM a""")
def a12(spark, d):
    return qc.stage_funnel(verdicts(spark, d))


@query("a19_run_diagnostics", f"WITH {VERDICT} SELECT user_id, count(*) AS n_segments, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_rejected FROM vd GROUP BY 1")
def a19(spark, d):
    return qc.run_diagnostics(verdicts(spark, d), ["user_id"])


@query("a26_filter_details", f"""WITH {VERDICT} SELECT user_id, s AS start_us, 'low_stroke_rate_required' AS filter_id, p1 AS passed FROM vd WHERE base UNION ALL SELECT user_id, s, 'plausible_drift', p2 FROM vd WHERE pm UNION ALL SELECT user_id, s, 'early_negative_only', p3 FROM vd WHERE pm AND elapsed_days < 15""")
def a26(spark, d):
    return qc.filter_details(verdicts(spark, d), IDS, ["user_id", "start_ts"]).select("user_id", us("start_ts", "start_us"), "filter_id", "passed")


@query("a28_tolerance_band", f"WITH {VERDICT} SELECT user_id, s AS start_us, round(drift_rate_ms - 0.1, 6) AS band_low, round(drift_rate_ms + 0.1, 6) AS band_high FROM vd WHERE ok AND start_depth_m <= 50")
def a28(spark, d):
    return qc.tolerance_band(verdicts(spark, d), "drift_rate_ms", 0.1, "start_depth_m", 50.0).select("user_id", us("start_ts", "start_us"), r("band_low"), r("band_high"))


@query("g20_rest_index", f"WITH {VERDICT} SELECT user_id, s AS start_us, 'drift' AS rest_category FROM vd WHERE ok")
def g20(spark, d):
    return rest.rest_index(verdicts(spark, d), {"long_drift": "drift"}).select("user_id", us("start_ts", "start_us"), "rest_category")


@query("g13_prepare_segments", f"WITH {VERDICT} SELECT user_id, s AS start_us, CAST(floor((s + e) / 2) AS BIGINT) AS mid_us, CASE WHEN ok THEN 'putative_rest.drift_sleep' ELSE 'find_rest.not_sleep' END AS state_name, CASE WHEN ok THEN 'putative_rest' ELSE 'find_rest' END AS group_label FROM vd")
def g13(spark, d):
    x = rest.prepare_segments(verdicts(spark, d).drop("base_state_key", "duration_s"))
    return x.select("user_id", us("start_ts", "start_us"), us("segment_midpoint", "mid_us"), "state_name", "group_label")


@query("g14_canonical_labels", """WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Surface_Sleep x' WHEN 'click' THEN 'calm_resting' WHEN 'error' THEN 'find_rest.long_flat' WHEN 'signup' THEN '' ELSE 'zzz' END AS raw FROM events)
  SELECT event_id, CASE raw WHEN 'Surface_Sleep x' THEN 'Resting' WHEN 'calm_resting' THEN 'Resting' WHEN '' THEN 'Unknown' ELSE 'Unmapped: ' || raw END AS canonical,
    CASE raw WHEN 'Surface_Sleep x' THEN 'surface_sleep' WHEN 'find_rest.long_flat' THEN 'benthic_sleep' END AS subtype FROM k""")
def g14(spark, d):
    t = F.col("event_type")
    raw = F.when(t == "view", "Surface_Sleep x").when(t == "click", "calm_resting").when(t == "error", "find_rest.long_flat").when(t == "signup", "").otherwise("zzz")
    s = signals(spark, d).withColumn("raw", raw)
    return s.select("event_id", labels.canonical_behavior(F.col("raw")).alias("canonical"), labels.rest_subtype(F.col("raw")).alias("subtype"))


@query("g15_g16_method_rows", f"""WITH {runs_sql('event_type')}, lab AS (SELECT user_id, s, e, CASE p WHEN 'view' THEN 'sleep' WHEN 'click' THEN 'deep sleep' ELSE p END AS l FROM runs)
  SELECT user_id, s AS start_us, l AS state_label, CASE WHEN l = 'sleep' THEN 'putative_rest' END AS state_subtype, l = 'sleep' AS positive_label FROM lab""")
def g15(spark, d):
    from ..core.runs import find_runs
    t = F.col("event_type")
    lab = F.when(t == "view", "sleep").when(t == "click", "deep sleep").otherwise(t)
    s = find_runs(signals(spark, d), signal_axis(spark, d), lab).withColumnRenamed("value", "predicted_label")
    return rest.supervised_rows(s, "predicted_label").select("user_id", us("start_ts", "start_us"), "state_label", "state_subtype", "positive_label")


@query("g19_label_groups", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' ELSE event_type END AS grp FROM events")
def g19(spark, d):
    return rest.map_label_groups(signals(spark, d), "event_type", {"browse": ["view", "click"], "buy": ["Purchase"]}, "grp").select("event_id", "grp")


# --- rest detection: the user signal on an hourly grid, in depth-like units ----------------------------

def hourly(spark, d):
    s, ax = signals(spark, d), signal_axis(spark, d)
    ends = s.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ax = tb.grid_axis(ax, ends, "a", "b", 3_600_000_000)
    return tb.resample_linear(s, ax, 3600.0, {"depth": ("mean", "value")}, IDX), ax.with_(order=("bin_ts",))


SLOW = {"quantize_step": 1.0, "thresholds": {"dive_depth_min_m": 15.0, "first_deriv_abs_max_ms": 0.001, "second_deriv_abs_max_ms2": 0.00001, "min_duration_s": 7200.0,
                                           "surface_sleep_min_duration_s": 10800.0, "drift_rate_abs_max_ms": 0.0005, "end_flat_abs_mean_d1_max_ms": 0.0001}, "filter_out_negative_slopes": False}


@query("g1_derived_channels", f"""WITH {SIG}, b AS (SELECT user_id, us // 3600000000 * 3600000000 AS t, avg(value) AS v FROM sig GROUP BY 1, 2), g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 3600000000)) AS t FROM b GROUP BY 1),
  j AS (SELECT g.user_id, g.t, v FROM g LEFT JOIN b USING (user_id, t)), nb AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(v IGNORE NULLS) OVER w AS bv,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(v IGNORE NULLS) OVER f AS fv FROM j WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  q AS (SELECT user_id, t, round_even(coalesce(v, bv + (fv - bv) * (((t - bt) / 1e6) / ((ft - bt) / 1e6))) / 10, 0) * 10 AS z FROM nb),
  g1 AS (SELECT *, coalesce((lead(z) OVER w - lag(z) OVER w) / 2, lead(z) OVER w - z, z - lag(z) OVER w) / 3600 AS d1 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t))
  SELECT user_id, t AS us, round(z, 6) AS depth_std, round(d1 * 1e4, 5) AS d1 FROM g1""")
def g1(spark, d):
    h, ax = hourly(spark, d)
    x = rest.derived_channels(h, ax, "depth", 1 / 3600, {"quantize_step": 10.0})
    return x.select("user_id", us("bin_ts", "us"), r("depth_std"), F.round(F.col("d1") * 1e4, 5).alias("d1"))


@query("g2_g4_detect_rest")
def g2(spark, d):
    h, ax = hourly(spark, d)
    x = rest.rest_candidates(h, ax, "depth", 1 / 3600, SLOW)
    return x.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "segment_family", "base_nominal_class", r("drift_rate_ms", 8))


@query("g1_segment_drift_rate", f"""WITH {runs_sql('value > 20')}, st AS (SELECT user_id, isl, min(us) AS s0 FROM rows_ WHERE p GROUP BY 1, 2)
  SELECT x.user_id, s0 AS start_us, count(*) AS n, round(regr_slope(x.k, (x.us - s0) / 3.6e9), 5) AS drift_per_h FROM rows_ x JOIN st USING (user_id, isl) WHERE p GROUP BY 1, 2""")
def g1d(spark, d):
    x = rest.segment_drift_rate(signals(spark, d), signal_axis(spark, d), F.col("value") > 20, "k")
    return x.select("user_id", us("run_start", "start_us"), "n", F.round(F.col("drift_rate_ms") * 3600, 5).alias("drift_per_h"))


@query("g5_exhaustive_states", f"""WITH {SIG}, c AS (SELECT *, CASE WHEN coalesce((us - lag(us) OVER w) / 1e6 >= 86400 AND k < 50, FALSE) THEN 'unscorable' WHEN event_type = 'error' THEN 'resting' ELSE (CASE WHEN k > 40 THEN 'active' ELSE 'calm' END) || '_' || (CASE WHEN value < 20 THEN 'surface' ELSE 'uw' END) END AS st
    FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, CASE WHEN lag(st) OVER w = st THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM g) SELECT user_id, st AS state, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM i GROUP BY user_id, isl, st""")
def g5(spark, d):
    ax = signal_axis(spark, d)
    s = tb.steps(signals(spark, d), ax).withColumn("rest", F.when(F.col("event_type") == "error", "resting"))
    x = rest.exhaustive_states(s, ax, "rest", F.col("value") < 20, F.col("k") > 40, F.col("step_s"), 86400.0, F.col("k") < 50)
    return x.select("user_id", "state", us("start_ts", "start_us"), us("end_ts", "end_us"), "n")


@query("g6_smoothed_metric", f"""WITH {SEG}, i_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i, floor(greatest(floor(count(*) OVER (PARTITION BY user_id) * 0.25), 1) / 2) AS h FROM seg)
  SELECT a.user_id, a.s AS start_us, round(avg(b.drift_rate_ms), 6) AS buoyancy, CASE WHEN round(avg(b.drift_rate_ms), 9) <= -0.03 THEN 'negative' WHEN round(avg(b.drift_rate_ms), 9) >= 0 THEN 'positive' ELSE 'neutral' END AS buoyancy_phase
  FROM i_ a JOIN i_ b ON b.user_id = a.user_id AND abs(b.i - a.i) <= a.h GROUP BY 1, 2""")
def g6(spark, d):
    ax = signal_axis(spark, d).with_(order=("start_ts",))
    x = rest.smoothed_metric(segs(spark, d), ax, "drift_rate_ms", F.lit(True), 0.25, "buoyancy", -0.03, 0.0)
    v = F.round("buoyancy", 9)
    return x.select("user_id", us("start_ts", "start_us"), r("buoyancy"), F.when(v <= -0.03, "negative").when(v >= 0, "positive").otherwise("neutral").alias("buoyancy_phase"))


@query("g7_trip_phase", f"""WITH {SEG}, z AS (SELECT *, max(elapsed_days) OVER (PARTITION BY user_id) AS last FROM seg), a AS (SELECT user_id, min(elapsed_days) FILTER (drift_rate_ms > 0.5 AND elapsed_days >= 20 AND elapsed_days <= last - 5) AS c, min(elapsed_days) FILTER (drift_rate_ms > 0.5 AND elapsed_days >= 20) AS y,
    max(elapsed_days) FILTER (drift_rate_ms <= 0.5) AS ng, min(elapsed_days) FILTER (drift_rate_ms > 0.5) AS fs, avg(drift_rate_ms) FILTER (elapsed_days < 15) AS er FROM z GROUP BY 1), t AS (SELECT *, greatest(coalesce(c, y) - 20, 0) AS turn FROM a)
  SELECT seg.user_id, s AS start_us, CASE WHEN ng IS NULL AND fs <= 20 THEN 'always_positive' WHEN coalesce(c, y) IS NULL THEN 'never_positive' WHEN elapsed_days < turn THEN 'pre_positive' ELSE 'post_positive' END AS trip_phase, round(er, 6) AS early_reference_value FROM seg JOIN t USING (user_id)""")
def g7(spark, d):
    s = segs(spark, d).withColumn("phase", F.when(F.col("drift_rate_ms") > 0.5, "positive").otherwise("negative"))
    x = rest.trip_phase(s, ["user_id"], "elapsed_days", "drift_rate_ms", "phase")
    return x.select("user_id", us("start_ts", "start_us"), "trip_phase", r("early_reference_value"))


# --- quality control ---------------------------------------------------------------------------------

def observed(spark, d):
    s = signals(spark, d)
    return s.select(F.concat(F.lit("ds"), F.col("user_id") % 3).alias("dataset_id"), F.col("user_id").cast("string").alias("deployment_id"),
                    F.when(F.col("value") > 60, "high").when(F.col("value") > 30, "mid").otherwise("low").alias("channel"), F.when(F.col("user_id") % 2 == 0, "m").otherwise("cm").alias("unit"))


OBS = "o AS (SELECT 'ds' || (user_id % 3) AS ds, CAST(user_id AS VARCHAR) AS dep, CASE WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'mid' ELSE 'low' END AS ch, CASE WHEN user_id % 2 = 0 THEN 'm' ELSE 'cm' END AS unit FROM events)"


@query("a14_presence_matrix", f"""WITH {OBS}, sc AS (SELECT DISTINCT ds, dep FROM o), tg AS (SELECT * FROM (VALUES ('high', 'm'), ('mid', 'm'), ('absent', 'm')) t(ch, eu)), seen AS (SELECT ds, dep, ch, min(unit) AS u FROM o GROUP BY 1, 2, 3)
  SELECT sc.ds AS dataset_id, sc.dep AS deployment_id, tg.ch AS channel, u IS NOT NULL AS present, u = eu AS unit_match FROM sc CROSS JOIN tg LEFT JOIN seen ON seen.ds = sc.ds AND seen.dep = sc.dep AND seen.ch = tg.ch""")
def a14(spark, d):
    return _matrix(spark, d).select("dataset_id", "deployment_id", "channel", "present", "unit_match")


def _matrix(spark, d):
    o = observed(spark, d)
    t = spark.createDataFrame([("high", "m"), ("mid", "m"), ("absent", "m")], "channel string, expected_unit string")
    return qc.presence_matrix(o, o.select("dataset_id", "deployment_id").distinct(), t)


@query("a14_channel_presence", f"""WITH {OBS}, sc AS (SELECT DISTINCT ds, dep FROM o), tg AS (SELECT * FROM (VALUES ('high'), ('mid'), ('absent')) t(ch)), seen AS (SELECT ds, dep, ch, min(unit) AS u FROM o GROUP BY 1, 2, 3),
  m AS (SELECT sc.ds, tg.ch, u FROM sc CROSS JOIN tg LEFT JOIN seen ON seen.ds = sc.ds AND seen.dep = sc.dep AND seen.ch = tg.ch)
  SELECT ch AS channel, round(count(u) / count(*), 6) AS presence_rate, count(DISTINCT CASE WHEN u IS NOT NULL THEN ds END) AS n_datasets, coalesce(string_agg(DISTINCT u, '|' ORDER BY u), '') AS units_seen FROM m GROUP BY 1""")
def a14c(spark, d):
    return qc.channel_presence(_matrix(spark, d)).select("channel", r("presence_rate"), "n_datasets", "units_seen")


@query("a15_signal_qc", f"""WITH {OBS}, g AS (SELECT dep, list(DISTINCT ch) AS h FROM o GROUP BY 1) SELECT dep AS deployment_id, array_to_string(list_sort(list_filter(h, lambda x: x IN ('high', 'low', 'none'))), '|') AS available_signals,
  array_to_string(list_filter(['high', 'low', 'none'], lambda x: NOT list_contains(h, x)), '|') AS missing_signals FROM g""")
def a15(spark, d):
    return qc.signal_qc(observed(spark, d), ["deployment_id"], "channel", ["high", "low", "none"])


DRIFT = """WITH o AS (SELECT user_id, event_type AS v, avg(value) AS m, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
  w AS (SELECT user_id, event_type AS v, avg(value * 1.001) AS m, min(value * 1.001) AS lo, max(value * 1.001) AS hi, count(*) AS n FROM events WHERE event_type <> 'view' AND day(ts) < 30 GROUP BY 1, 2),
  j AS (SELECT user_id, v, o.n AS n0, w.n AS n1, greatest(abs(w.m - o.m), abs(w.lo - o.lo), abs(w.hi - o.hi)) / greatest(abs(o.hi - o.lo), abs(o.m), 1e-12) AS wr FROM o FULL JOIN w USING (user_id, v)), vd AS (SELECT *, CASE WHEN n0 IS NULL THEN 'added' WHEN n1 IS NULL THEN 'lost' WHEN n0 <> n1 OR wr > 0.01 THEN 'changed' ELSE 'unchanged' END AS verdict FROM j)"""


@query("a16_run_drift", DRIFT + " SELECT user_id, v AS variable, verdict, round(wr, 6) AS worst_rel FROM vd")
def a16(spark, d):
    return _drift(spark, d).select("user_id", F.col("event_type").alias("variable"), "verdict", r("worst_rel"))


def _drift(spark, d):
    s = signals(spark, d)
    old = qc.profile(s.where("event_type <> 'error'"), ["user_id"], "event_type", "value")
    new = qc.profile(s.where("event_type <> 'view' AND day(ts) < 30").withColumn("value", F.col("value") * 1.001), ["user_id"], "event_type", "value")
    return qc.run_drift(old, new, ["user_id"], "event_type")


@query("a16_drift_summary", DRIFT + """ SELECT user_id, count(*) FILTER (verdict = 'added') AS n_added, count(*) FILTER (verdict = 'lost') AS n_lost, count(*) FILTER (verdict = 'changed') AS n_changed,
  count(*) FILTER (verdict = 'unchanged') AS n_unchanged, arg_max(v, (wr, v)) FILTER (wr > 0) AS worst_variable, round(max(wr), 6) AS worst_rel FROM vd GROUP BY 1""")
def a16s(spark, d):
    return qc.run_drift_summary(_drift(spark, d), ["user_id"], "event_type").withColumn("worst_rel", F.round("worst_rel", 6))


@query("a17_classify_drift", f"""WITH {SIG}, a AS (SELECT user_id, min(value) AS lo, max(value) AS hi, count(*) AS n, max(k) AS mk FROM sig GROUP BY 1)
  SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'review' WHEN user_id % 5 = 0 THEN 'recovered' WHEN user_id % 2 = 0 THEN 'corrected' ELSE 'expected' END AS category FROM a""")
def a17(spark, d):
    u = F.col("user_id")
    a = signals(spark, d).groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).cast("double").alias("n"))
    a = a.withColumns({"unexpected_lost": (u % 7 == 0).cast("int"), "old_span": F.col("n"), "new_span": F.when(u % 5 == 0, F.col("n") * 2).otherwise(F.col("n")),
                       "old_min": -F.col("hi"), "old_max": -F.col("lo"), "new_min": F.col("lo"), "new_max": F.col("hi"), "positive_down": u % 2 == 0})
    return qc.classify_drift(a).select("user_id", "category")


@query("a18_fold_means", "SELECT event_type AS variant, user_id % 4 AS metric, round(avg(value), 6) AS mean_value, count(value) AS n_folds FROM events GROUP BY 1, 2")
def a18(spark, d):
    s = signals(spark, d).select(F.col("event_type").alias("variant"), (F.col("user_id") % 4).alias("metric"), "value")
    return qc.fold_means(s, ["variant", "metric"]).withColumn("mean_value", F.round("mean_value", 6))


@query("a20_catalogue", "SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 4) AS duration_min, CASE WHEN count(*) > 70 THEN 'ready' WHEN count(*) > 60 THEN 'partial' ELSE 'none' END AS tier FROM events GROUP BY 1")
def a20(spark, d):
    x = qc.catalogue(signals(spark, d), ["user_id"], "ts", "event_type", [("ready", F.col("n_events") > 70), ("partial", F.col("n_events") > 60)])
    return x.select("user_id", "n_events", "n_kinds", r("duration_min", 4), "tier")


@query("a21_label_percentiles", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.01), 6) AS l_quantity_p1, round(quantile_cont(l_quantity, 0.99), 6) AS l_quantity_p99, round(quantile_cont(l_extendedprice, 0.05), 4) AS l_extendedprice_p5 FROM lineitem GROUP BY 1")
def a21(spark, d):
    li = load(spark, d, "lineitem")
    x = qc.label_percentiles(li, ["l_suppkey"], ["l_quantity"], {"p1": 0.01, "p99": 0.99})
    y = qc.label_percentiles(li, ["l_suppkey"], ["l_extendedprice"], {"p5": 0.05})
    return x.join(y, "l_suppkey").select("l_suppkey", r("l_quantity_p1"), r("l_quantity_p99"), r("l_extendedprice_p5", 4))


@query("a27_sign_profile", "SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS n_negative, count(*) FILTER (c_acctbal = 0) AS n_zero, count(*) FILTER (c_acctbal > 0) AS n_positive, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 6) AS pct_negative, CASE WHEN count(*) FILTER (c_acctbal > 0) > count(*) FILTER (c_acctbal < 0) THEN 'positive' ELSE 'negative' END AS verdict FROM customer GROUP BY 1")
def a27(spark, d):
    return qc.sign_profile(load(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", "total", "n_negative", "n_zero", "n_positive", r("pct_negative"), "verdict")


@query("a30_review_options", "SELECT DISTINCT user_id, CASE WHEN event_type = 'view' THEN 'observed' ELSE 'cluster' END AS method FROM events WHERE event_type IN ('view', 'click')")
def a30(spark, d):
    s = signals(spark, d)
    return qc.review_options({"observed": s.where("event_type = 'view'"), "cluster": s.where("event_type = 'click'")}, ["user_id"])


# --- the run summary ---------------------------------------------------------------------------------

DS, DEP = "concat('ds', user_id % 3)", "CAST(user_id AS STRING)"


def _summary(spark, d):
    from ..core.runs import find_runs
    s, ax = signals(spark, d), signal_axis(spark, d)
    ids = lambda df: df.withColumns({"dataset_id": F.expr(DS), "deployment_id": F.expr(DEP)}).drop("user_id")
    seg = ids(islands.find_segments(s, ax, F.col("value") > 40).withColumn("state_name", F.when(F.col("n") >= 2, "find_rest.long_drift").otherwise("find_rest.not_sleep"))
              .withColumn("keep_filtered", F.col("n") >= 2))
    pred = ids(find_runs(s, ax, F.when(F.col("k") > 60, "sleep").otherwise("wake")).withColumnRenamed("value", "predicted_label").withColumn("variant_id", F.lit("rf")).drop("n"))
    depth = ids(s.select("user_id", "ts", "event_id", F.col("value").alias("depth")))
    loc = ids(s.where("event_type = 'view'").select("user_id", "ts", (F.col("value") % 60).alias("latitude"), (F.col("k") - 50).alias("longitude")))
    feat = ids(s.select("user_id", "ts", F.col("k").alias("value")))
    dep = ids(s.select("user_id").distinct()).withColumns({"tz": F.lit("UTC"), "fallback_latitude": F.lit(10.0), "fallback_longitude": F.lit(20.0)})
    grp = dep.select("deployment_id", F.concat(F.lit("g"), F.col("deployment_id").cast("int") % 2).alias("group_name"))
    return summary_tables(seg, pred, depth, loc, dep, feat, ax.with_(keys=("dataset_id", "deployment_id"), order=("ts", "event_id")), groups=grp)


SUM = f"""{runs_sql('value > 40')}, alg AS (SELECT user_id, 'algorithmic' AS method, 'drift_sleep' AS lab, s, e FROM runs WHERE p AND n >= 2),
  k_ AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (k > 60) = (lag(k) OVER w > 60) THEN 0 ELSE 1 END AS c FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM k_),
  sup AS (SELECT user_id, 'supervised' AS method, 'putative_rest' AS lab, min(us) AS s, max(us) AS e FROM k2 WHERE k > 60 GROUP BY user_id, g), pos AS (SELECT * FROM alg UNION ALL SELECT * FROM sup)"""


@query("g18_summary_overlap_counts", f"""WITH {SUM}, o AS (SELECT p.user_id, p.method, p.s, max(CASE WHEN q.s IS NOT NULL THEN greatest(least(p.e, q.e) - greatest(p.s, q.s), 0) END) AS ov FROM pos p LEFT JOIN pos q ON q.user_id = p.user_id AND q.method <> p.method AND q.e > p.s AND q.s < p.e GROUP BY 1, 2, 3)
  SELECT method, CASE WHEN coalesce(ov, 0) > 0 THEN 'tp' WHEN method = 'supervised' THEN 'fp' ELSE 'fn' END AS weak_confusion, count(*) AS n FROM o GROUP BY 1, 2""")
def g18o(spark, d):
    return _summary(spark, d)["overlap_counts"]


@query("g18_summary_daily_budget", f"""WITH {SUM}, d_ AS (SELECT *, (lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) - us) / 1e6 AS dt FROM sig), md AS (SELECT user_id, median(dt) AS m FROM d_ GROUP BY 1),
  w AS (SELECT d_.user_id, event_id, ts, us, value, coalesce(dt, CASE WHEN m > 0 THEN m ELSE 60 END) AS w FROM d_ JOIN md USING (user_id)), mt AS (SELECT DISTINCT user_id, method FROM pos),
  h AS (SELECT w.user_id, mt.method, w.event_id, any_value(w.ts) AS ts, any_value(w.w) AS w, any_value(w.value) AS value, arg_max(pos.lab, (pos.s, pos.e)) AS lab FROM w JOIN mt USING (user_id)
    LEFT JOIN pos ON pos.user_id = w.user_id AND pos.method = mt.method AND w.us BETWEEN pos.s AND pos.e GROUP BY 1, 2, 3)
  SELECT CAST(user_id AS VARCHAR) AS deployment_id, method, strftime(ts, '%Y-%m-%d') AS local_date, coalesce(lab, CASE WHEN value < 2 THEN 'surfacing' ELSE 'diving' END) AS state_label_raw, round(sum(w) / 3600, 5) AS duration_h FROM h GROUP BY 1, 2, 3, 4""")
def g18d(spark, d):
    return _summary(spark, d)["method_daily_budget"].select("deployment_id", "method", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "state_label_raw", r("duration_h", 5))


@query("g18_summary_group_comparison")
def g18g(spark, d):
    return _summary(spark, d)["group_comparison"].select("method", "state_label_canonical", "comparison_level", "comparison_key", r("duration_h", 5), r("pct_of_24h", 5))


@query("g17_putative_rest_summary")
def g17(spark, d):
    return _summary(spark, d)["putative_rest_summary"].select("deployment_id", "method", us("start_ts", "start_us"), "local_hour", r("near_latitude"), r("near_longitude"), F.round("snap_feature_value", 6).alias("feature_value"), "weak_confusion")
