"""Operator cases with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.core.axis import Axis
from driftline.functions import dsp, labels, units
from driftline.operators import features, filters, geo, intervals, islands, learn, orient, peaks, project, qc, rest, rolling, rules, timebase as tb
from driftline.plans.summary import summary_tables

AX = Axis(("id",), ("ts",), width=60_000_000, rows=1000)
T0 = dt.datetime(2021, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_trip_phase_and_ordered_filters(spark):
    """A category gate and a threshold gate that apply in some phases, one gate that needs its reference and one that may miss it."""
    off = lambda ref, most: {"mode": "threshold_gate", "value_expr": f"abs(drift_rate_ms - {ref})", "keep_if": {"comparator": "<", "threshold": most}}
    filters = [
        {"id": "near_context", "rule": off("inferred_value", 0.4), "on_missing_covariate": "reject", "reject_reason": "far_from_context"},
        {"id": "sinks_before_turn", "applies_when": {"inferred_trip_phase_in": ["pre_positive", "never_positive"]},
         "rule": {"mode": "category_gate", "field": "segment_sign", "allowed_values": ["negative"]}, "reject_reason": "rises_too_early"},
        {"id": "late_sinks_are_deep", "applies_when": {"inferred_trip_phase_in": ["post_positive", "always_positive"], "segment_sign": "negative"},
         "rule": {"mode": "threshold_gate", "field": "start_depth_m", "keep_if": {"comparator": ">=", "threshold": 180.0}}, "reject_reason": "late_and_shallow"},
        {"id": "first_days", "applies_when": {"elapsed_days": {"comparator": "<", "threshold": 20.0}}, "rule": off("early_reference_value", 0.2), "on_missing_covariate": "skip_filter",
         "reject_reason": "unlike_first_days"},
    ]
    days = [(2.0, 0.11, 130.0), (6.0, -0.16, 300.0), (40.0, -0.11, 140.0), (55.0, 0.13, 360.0)]
    rows = [(1, i + 1, at(d * 86400), d, r, z, "positive" if r > 0 else "negative") for i, (d, r, z) in enumerate(days)]
    seg = frame(spark, rows, "id bigint, segment_rank int, ts timestamp, elapsed_days double, drift_rate_ms double, start_depth_m double, segment_sign string").withColumns({
        "segment_family": F.lit("drift_candidate"), "base_state_key": F.lit("find_rest.long_drift"), "base_nominal_class": F.lit("long_drift"), "base_keep_filtered": F.lit(True)})
    s = rest.smoothed_metric(seg, AX, "drift_rate_ms", F.col("start_depth_m") <= 500, 0.25, "inferred_value", -0.03, 0.0)
    s = rest.trip_phase(s, ["id"], "elapsed_days", "inferred_value", "inferred_value_phase", depth="start_depth_m").withColumnRenamed("trip_phase", "inferred_trip_phase")
    out = {r["segment_rank"]: r for r in rules.final_class(rules.apply_filters(s, filters)).collect()}
    assert [out[i]["keep_filtered"] for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert "rises_too_early" in out[1]["context_reject_reason"] and out[3]["context_reject_reason"] == "late_and_shallow"
    assert [out[i]["nominal_class"] for i in (1, 2)] == ["not_sleep", "long_drift"]


def test_measured_before_inferred(spark):
    seg = frame(spark, [(1, "negative", 12.0, "pre_positive"), (2, "positive", 4.0, "pre_positive")], "r int, segment_sign string, segment_mean_stroke_rate_spm double, inferred_trip_phase string")
    f = [{"id": "prepositive_negative_only", "applies_when": {"inferred_trip_phase_in": ["pre_positive"]}, "rule": {"mode": "category_gate", "field": "segment_sign", "allowed_values": ["negative"]}, "reject_reason": "sign"},
         {"id": "low_stroke_rate_required", "rule": {"mode": "threshold_gate", "field": "segment_mean_stroke_rate_spm", "keep_if": {"comparator": "<=", "threshold": 10.0}}, "reject_reason": "stroke"}]
    out = {r["r"]: r for r in rules.apply_filters(seg, f).collect()}
    assert out[1]["context_reject_stage"] == "rejected_after_measured_filters" and out[1]["context_reject_reason"] == "stroke" and not out[1]["post_measured_keep"]
    assert out[2]["context_reject_stage"] == "rejected_after_inferred_filters" and out[2]["post_measured_keep"]


def test_expressions_are_whitelisted(spark):
    with pytest.raises(ValueError):
        rules.safe_expr("sleep(1)", ["a"])
    with pytest.raises(ValueError):
        rules.safe_expr("a; drop", ["a"])
    with pytest.raises(ValueError):
        rules.validate_filters([{"id": "x", "rule": {}, "action_on_fail": "keep"}])
    assert rules.resolve_filters({"x": {"rule": {"field": "f"}}}, ["x"])[0]["rule"]["field"] == "f"


def test_segment_means_use_closed_ends(spark):
    seg = frame(spark, [(1, 1, at(0), at(20)), (1, 2, at(40), at(50))], "id bigint, r int, a timestamp, b timestamp")
    sig = frame(spark, [(1, at(t), v) for t, v in ((0, 8.0), (10, 10.0), (20, 12.0), (30, 99.0), (40, 5.0), (50, 7.0))], "id bigint, ts timestamp, v double")
    out = {r["r"]: r["seg_mean"] for r in intervals.segment_signal_stats(sig, seg, ["id"], "r", "ts", ("a", "b"), "v", 15.0).collect()}
    assert out == {1: 10.0, 2: 6.0}


def test_short_gaps_fill_and_long_gaps_fail(spark):
    df = frame(spark, [(1, at(t), float(t), "x" if t < 3 else "y") for t in (0, 1, 4, 5)], "id bigint, ts timestamp, depth double, tag string")
    out = tb.fill_short_gaps(df, AX, ["depth"], ["tag"]).orderBy("ts").collect()
    assert [r["depth"] for r in out] == [0, 1, 2, 3, 4, 5] and [r["tag"] for r in out] == list("xxxxyy")
    assert sum(r["inserted"] for r in out) == 2
    bad = frame(spark, [(1, at(t), 0.0) for t in (0, 1, 122)], "id bigint, ts timestamp, depth double")
    with pytest.raises(Exception, match="meets or exceeds"):
        tb.fill_short_gaps(bad, AX, ["depth"], []).collect()
    dup = frame(spark, [(1, at(t), 0.0) for t in (0, 1, 1, 2)], "id bigint, ts timestamp, depth double")
    with pytest.raises(Exception, match="duplicate"):
        tb.fill_short_gaps(dup, AX, ["depth"], []).collect()


def test_threshold_trim(spark):
    df = frame(spark, [(1, at(60 * i), float(v)) for i, v in enumerate((0, 1, 12, 15, 9, 11, 0, 0))] + [(2, at(0), 1.0)], "id bigint, ts timestamp, depth double")
    out = {r["id"]: r for r in filters.threshold_window(df, ["id"], "ts", "depth", 10.0).collect()}
    assert (out[1]["trim_start"], out[1]["trim_end"]) == (at(120), at(300))
    assert out[2]["trim_status"] == "no_in_water_interval"


def test_stratify_falls_back(spark):
    df = frame(spark, [("a", "S"), ("a", "S"), ("a", "N"), ("b", "N"), ("b", "N")], "ds string, y string")
    out = learn.stratify_key(df, "ds", "y").select("stratum", "stratify_note").distinct().collect()
    assert {r["stratum"] for r in out} == {"S", "N"} and {r["stratify_note"] for r in out} == {"composite_class_too_small"}


def test_mask_periods_extend_by_step(spark):
    df = frame(spark, [(1, at(10 * i), v) for i, v in enumerate([False, True, True, False, True, True])], "id bigint, ts timestamp, m boolean")
    out = islands.mask_periods(df, AX.with_(width=25_000_000), F.col("m")).orderBy("start_ts").collect()
    assert [r["duration_s"] for r in out] == [20.0, 20.0]


def test_filter_counts(spark):
    rows = [(i, "long_drift" if i <= 10 else "surface_sleep", i not in (3, 7), None if i not in (3, 7) else ("f1" if i == 3 else "f2"), i != 3, 1.0, i != 7, 2.0) for i in range(1, 13)]
    df = frame(spark, rows, "r int, state_name string, context_keep boolean, context_reject_reason string, f1_pass boolean, f1_value double, f2_pass boolean, f2_value double").withColumns({
        "base_keep_filtered": F.lit(True), "keep_filtered": F.col("context_keep")})
    t = filters.state_selector("long_drift")
    o = qc.filter_overview(df, t).first()
    assert tuple(o) == (10, 8, 2, 20.0)
    assert {r["filter_id"]: r["failed_count"] for r in qc.filter_summary(df, ["f1", "f2"], t).collect()} == {"f1": 1, "f2": 1}
    assert {r["reject_reason"] for r in qc.reject_reasons(df, t).collect()} == {"f1", "f2"}


def test_bins_left_closed_with_gravity(spark):
    df = frame(spark, [(1, at(3 * i), 0.0, 0.0, 1.0) for i in range(20)] + [(1, at(300), 0.0, 3.0, 4.0)], "id bigint, ts timestamp, ax double, ay double, az double")
    out = tb.series_aggregates(df, AX, 30.0, ("ax", "ay", "az")).orderBy("bin_ts").collect()
    assert out[0]["bin_ts"] == at(0) and out[0]["n_samples"] == 10 and out[0]["activity"] == 1.0
    assert len(out) == 11 and out[5]["n_samples"] == 0 and out[5]["activity"] is None and out[10]["activity"] == 5.0


def test_daily_cycle_is_found(spark):
    n = 24 * 30
    df = frame(spark, [(1, at(3600 * i), 5 + float(np.sin(2 * np.pi * i / 24)) + 0.01 * i) for i in range(n)], "id bigint, ts timestamp, v double")
    periods = list(np.logspace(np.log10(4), np.log10(120), 60))
    p = rolling.wavelet_power(df, AX.with_(width=86_400_000_000, rows=200), "v", 1.0, periods)
    top = rolling.dominant_periods(p, ["id"], 1).first()
    assert abs(top["period_hours"] - 24) < 2 and "diel" in top["nearest_cycle"] and top["within_coi"]


def test_lag_follows_documented_sign(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    ref = frame(spark, [(1, at(i), float(v)) for i, v in enumerate(x)], "id bigint, ts timestamp, x double")
    late = frame(spark, [(1, at(i + 5), float(v)) for i, v in enumerate(x)], "id bigint, ts timestamp, y double")
    assert tb.estimate_lag(ref, late, AX, "x", "y", 1.0, 10).first()["lag"] == 5


def test_one_outlier_does_not_cascade(spark):
    lat = [0.0, 0.1, 0.2, 30.0, 0.4, 0.5]
    df = frame(spark, [(1, at(3600 * i), v, 0.0) for i, v in enumerate(lat)], "id bigint, ts timestamp, lat double, lon double")
    s = geo.smooth_geolocation(df, AX, "lat", "lon", 2.0, 50.0).orderBy("ts").collect()
    assert [r["outlier"] for r in s] == [False, False, False, True, False, False]
    assert s[3]["lat_smoothed"] is None and max(r["lat_smoothed"] for r in s if not r["outlier"]) < 1


def test_null_position_has_no_distance(spark):
    assert frame(spark, [(None, 1.0)], "a double, b double").select(geo.haversine("a", "b", F.lit(0.0), F.lit(0.0)).alias("d")).first()["d"] is None


def test_unit_conversion_idempotent(spark):
    df = frame(spark, [(1.0, "g"), (None, "g"), (9.80665, "m/s2")], "ax double, unit string")
    once = project.standardize_acceleration(df, ["ax"], "unit")
    assert [r["ax"] for r in project.standardize_acceleration(once, ["ax"], "unit").collect()] == [9.80665, None, 9.80665]
    r = frame(spark, [(2.0, "count/5s"), (1.0, "Hz"), (7.0, "m")], "v double, u string")
    assert [x["v"] for x in project.standardize_rate(r, "v", "u").collect()] == [24.0, 60.0, 7.0]
    with pytest.raises(Exception, match="no conversion"):
        df.select(units.convert(F.col("ax"), F.col("unit"), "parsec")).collect()


def test_unscorable_label_runs(spark):
    df = frame(spark, [(1, at(i), n, s) for i, (n, s) in enumerate([(1, 5), (1, 5), (None, None), (2, None), (2, None), (3, 6)])], "id bigint, ts timestamp, n int, s int")
    out = islands.unscorable_states(df, AX.with_(width=2_000_000), "n", "s").collect()
    assert len(out) == 1 and out[0]["n"] == 2 and out[0]["key"] == "unscorable"


def test_prorated_seconds_keep_the_total(spark):
    df = frame(spark, [(1, dt.datetime(2021, 3, 27, 20), dt.datetime(2021, 3, 29, 5, 30))], "id bigint, start_ts timestamp, end_ts timestamp")
    d = intervals.prorate(df, "day", "Europe/Berlin").orderBy("bucket").collect()
    assert sum(r["seconds"] for r in d) == pytest.approx(33.5 * 3600)
    assert [r["seconds"] / 3600 for r in d] == [3.0, 23.0, 7.5]  # the clock goes forward on the 28th


def test_merge_is_idempotent(spark):
    rng = np.random.default_rng(5)
    rows = [(1, at(int(a)), at(int(a + w))) for a, w in zip(rng.integers(0, 5000, 80), rng.integers(1, 90, 80))]
    df = frame(spark, rows, "id bigint, start_ts timestamp, end_ts timestamp")
    ax = Axis(("id",), ("start_ts", "end_ts"), width=200_000_000)
    once = intervals.merge_near(df, ax, gap_s=5.0)
    assert sorted(map(tuple, intervals.merge_near(once.drop("n_merged"), ax, gap_s=5.0).drop("n_merged").collect())) == sorted(map(tuple, once.drop("n_merged").collect()))


def test_triaxial_offset_recovered(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 3))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + [0.1, -0.2, 0.3]
    df = frame(spark, [(1, *map(float, r)) for r in v] + [(1, None, 1.0, 1.0)], "id bigint, x double, y double, z double")
    o = orient.estimate_offsets(df, ["id"], ["x", "y", "z"]).first()
    assert [o["ox"], o["oy"], o["oz"]] == pytest.approx([-0.1, 0.2, -0.3], abs=1e-6)
    flat = frame(spark, [(1, 1.0, 0.0, 0.0)] * 5, "id bigint, x double, y double, z double")
    assert orient.estimate_offsets(flat, ["id"], ["x", "y", "z"]).first()["status"] == "poor_condition"


def test_bandpass_keeps_its_band_and_hides_chunk_edges(spark):
    fs, n = 50.0, 3000
    t = np.arange(n) / fs
    df = frame(spark, [(1, i, float(np.sin(2 * np.pi * 5 * v) + np.sin(2 * np.pi * 0.2 * v))) for i, v in enumerate(t)], "id bigint, i bigint, v double")
    run = lambda rows: np.array([r["f"] for r in rolling.butterworth(df, Axis(("id",), ("i",), width=1_000_000, rows=rows), fs, (2.0, 10.0), {"f": "v"}).orderBy("i").collect()])
    whole, cut = run(10_000), run(300)
    assert np.max(np.abs(whole - cut)) < 1e-7
    assert np.max(np.abs(whole[500:-500] - np.sin(2 * np.pi * 5 * t)[500:-500])) < 0.05


def test_welch_and_shape_features():
    x = np.sin(2 * np.pi * 10 * np.arange(1000) / 100)[None, :]
    f, p = dsp.welch(x, 100.0, 200)
    assert f[np.argmax(p[0])] == pytest.approx(10.0)
    noise = np.random.default_rng(4).normal(size=(20, 4000))
    f, p = dsp.welch(noise, 100.0, 200)
    assert p[:, 2:-2].mean() == pytest.approx(0.02, rel=0.05)  # unit variance spread over 50 Hz
    assert dsp.band_power(f, p, 10, 40).mean() == pytest.approx(0.6, rel=0.05)
    assert dsp.higuchi(np.linspace(0, 1, 500)[None, :])[0] == pytest.approx(1.0, abs=0.02)
    assert dsp.zero_crossings(np.array([[1.0, -1.0, 1.0]]))[0] == 2
    assert dsp.permutation_entropy(np.arange(50.0)[None, :])[0] == pytest.approx(0.0)


def test_decimation_drops_fast_waves(spark):
    n = 2000
    v = np.sin(2 * np.pi * np.arange(n) / 100) + np.sin(2 * np.pi * np.arange(n) / 3)
    df = frame(spark, [(1, i, float(x)) for i, x in enumerate(v)], "id bigint, i bigint, v double")
    got = np.array([r["d"] for r in rolling.decimate(df, Axis(("id",), ("i",), width=10_000, rows=500), 5, {"d": "v"}).orderBy("i").collect()])
    want = np.sin(2 * np.pi * np.arange(0, n, 5) / 100)
    assert np.max(np.abs(got - want)[40:-40]) < 0.02


def loop_up_jumps(t, frac, min_rr):
    """The order-dependent procedure, as a loop over jumps with a live set of standing beats."""
    hr = [None] + [60 / (b - a) for a, b in zip(t, t[1:])]
    ups = [t[i] for i in range(2, len(t)) if (hr[i] - hr[i - 1]) / hr[i - 1] > frac]
    live, rejected, gaps = list(t), [], []
    for u in ups:
        if u not in live:
            continue
        i = live.index(u)
        if i == 0:
            continue
        bad = live[i - 1]
        live.remove(bad)
        rejected.append(bad)
        before, after = [x for x in live if x < bad], [x for x in live if x > bad]
        if before and after and after[0] - before[-1] < min_rr:
            gaps.append((before[-1], after[0]))
    return rejected, gaps


def test_up_jump_windows_equal_the_loop(spark):
    rng = np.random.default_rng(11)
    t = [int(x) for x in np.cumsum(rng.choice([1, 2, 3, 6, 12], 200))]
    df = frame(spark, [(1, at(x)) for x in t], "id bigint, ts timestamp")
    rej, gaps = peaks.up_jump_rejections(df, AX.with_(width=30_000_000), 0.6, 8.0)
    sec = lambda d: int((d - T0).total_seconds())
    want_rej, want_gaps = loop_up_jumps(t, 0.6, 8.0)
    assert sorted(sec(r["ts"]) for r in rej.collect()) == sorted(want_rej)
    assert sorted((sec(r["start_ts"]), sec(r["end_ts"])) for r in gaps.collect()) == sorted(want_gaps)


def test_labels(spark):
    df = frame(spark, [("Surface_Sleep",), ("sleepy",), ("",), ("odd",)], "x string")
    assert [r[0] for r in df.select(labels.canonical_behavior(F.col("x"))).collect()] == ["Resting", "Resting", "Unknown", "Unmapped: odd"]


def test_correlated_features_drop_the_later(spark):
    df = frame(spark, [(float(i), 2.0 * i, float((i * 7) % 5)) for i in range(30)], "a double, b double, c double")
    kept, gone = features.drop_correlated(features.correlation_matrix(df, ["a", "b", "c"]), ["a", "b", "c"])
    assert (kept, gone) == (["a", "c"], ["b"])


def test_window_cap_is_exact(spark):
    df = frame(spark, [(i % 2, i) for i in range(100)], "id bigint, w bigint")
    assert features.cap_windows(df, ["id"], ["w"], 7).groupBy("id").count().where("count = 7").count() == 2


def test_summary_tables_have_all_levels(spark):
    ids = "dataset_id string, deployment_id string, "
    seg = frame(spark, [("d", "a", 1, at(3600), at(7200), "find_rest.long_drift", True), ("d", "a", 2, at(10800), at(12000), "find_rest.not_sleep", False)],
                ids + "segment_rank int, start_ts timestamp, end_ts timestamp, state_name string, keep_filtered boolean")
    pred = frame(spark, [("d", "a", at(3600), at(5400), "sleep", "rf"), ("d", "a", at(5400), at(7200), "wake", "rf")],
                 ids + "start_ts timestamp, end_ts timestamp, predicted_label string, variant_id string")
    hours = [("d", "a", at(3600 * i), float(i % 3)) for i in range(12)]
    depth = frame(spark, hours, ids + "ts timestamp, depth double")
    loc = frame(spark, [("d", "a", at(3600 * i), -1.0, 36.0) for i in range(12)], ids + "ts timestamp, latitude double, longitude double")
    feat = depth.withColumnRenamed("depth", "value")
    dep = frame(spark, [("d", "a", "Africa/Nairobi", -1.0, 36.0)], ids + "tz string, fallback_latitude double, fallback_longitude double")
    grp = frame(spark, [("a", "Kenya_F")], "deployment_id string, group_name string")
    t = summary_tables(seg, pred, depth, loc, dep, feat, Axis(("dataset_id", "deployment_id"), ("ts",), width=7_200_000_000), groups=grp)
    assert len(t) == 8
    assert {r["comparison_level"] for r in t["group_comparison"].collect()} == {"deployment", "dataset", "group"}
    assert {r["weak_confusion"] for r in t["overlap_counts"].collect()} == {"tp"}
    daily = {(r["method"], r["state_label_raw"]): r["duration_h"] for r in t["method_daily_budget"].collect()}
    assert daily[("algorithmic", "drift_sleep")] == 2.0  # samples at both closed ends
    assert sum(v for (m, _), v in daily.items() if m == "algorithmic") == pytest.approx(12.0)
    sun = t["method_daily_budget"].first()
    assert 6 < sun["sunrise_local_hour"] < 7 and 18 < sun["sunset_local_hour"] < 19
