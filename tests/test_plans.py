"""How work is dealt: sizes that Spark guesses before rows are multiplied must not lead to a broadcast or to one task."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from driftline.core.axis import Axis
from driftline.operators import timebase as tb

HOUR = 3_600_000_000
AX = Axis(("k",), ("ts",))
T0 = dt.datetime(2021, 1, 1)


def recordings(spark, n=40):
    t = F.timestamp_micros(F.col("id") % 50 * 7 * HOUR + F.col("id"))
    return spark.range(n * 50).select(F.floor(F.col("id") / 50).alias("k"), t.alias("ts"), F.col("id").cast("double").alias("x"))


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_is_dealt_to_all_tasks(spark):
    b = recordings(spark).groupBy("k").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    g = tb.grid(b, ["k"], "a", "b", HOUR)
    assert g.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_filled_grid_is_not_broadcast(spark):
    r = tb.resample(recordings(spark), AX, 3600.0, {"x": ("mean", "x")})
    assert "Broadcast" not in joins(tb.linear_fill(r, AX.with_(order=("bin_ts",)), ["x"]))


def test_collated_signals_are_not_broadcast(spark):
    s = recordings(spark)
    assert "Broadcast" not in joins(tb.collate({"a": (s, ["x"]), "b": (s.withColumnRenamed("x", "y"), ["y"])}, AX, "a", 3600.0))


def test_lagged_grids_are_not_broadcast(spark, monkeypatch):
    seen = []
    curve = tb.lag_curve
    monkeypatch.setattr(tb, "lag_curve", lambda df, *a, **kw: seen.append(joins(df)) or curve(df, *a, **kw))
    s = recordings(spark)
    tb.estimate_lag(s, s.withColumnRenamed("x", "y"), AX, "x", "y", 3600.0, 3)
    top = next(line for line in seen[0].splitlines() if "Join" in line)
    assert "SortMergeJoin" in top


def test_rest_detection_cuts_the_grid_once(spark):
    """Filling the grid, channels and segments shuffle the rows of the grid once, and give what the operators give one by one on other cuts."""
    from driftline.core.scan import IDX
    from driftline.operators import rest
    rng = np.random.default_rng(3)
    rows = [(k, T0 + dt.timedelta(minutes=int(m)), None if m % 11 == 0 else float(np.round(20 + 15 * np.sin(m / 4000 + k) + rng.normal(), 1)))
            for k in range(3) for m in np.unique(rng.integers(0, 40_000, 150 - 70 * k))]
    df = spark.createDataFrame([(f"r{k}", t, v) for k, t, v in rows] + [("none", T0, None)], "id string, ts timestamp, x double")
    cfg = {"quantize_step": 1.0, "base_smooth_seconds": 10_800.0, "coarse_smooth_seconds": 10_800.0, "dive_depth_min_m": 15.0, "first_deriv_abs_max_ms": 0.001, "second_deriv_abs_max_ms2": 0.00001,
           "min_duration_s": 7200.0, "drift_rate_abs_max_ms": 0.0005, "filter_out_negative_slopes": False}
    day = Axis(("id",), ("ts",), width=86_400_000_000, rows=50)
    one = day.with_(order=("bin_ts",))
    full = tb.linear_fill(tb.resample(df, day, 3600.0, {"x": ("mean", "x")}), one, ["x"])
    grid = tb.resample_linear(df, day, 3600.0, {"x": ("mean", "x")}, IDX)
    flat = lambda d: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    want = flat(full.select("id", "bin_ts", "x"))
    assert flat(grid.select("id", "bin_ts", "x")) == want and any(r[2] is None for r in want) and len(want) > 1500
    for k in ("r0", "r1", "r2", "none"):
        assert [r[IDX] for r in grid.where(f"id = '{k}'").orderBy("bin_ts").collect()] == list(range(sum(r[0] == k for r in want)))
    parts = flat(rest.detect_rest(rest.derived_channels(full, one, "x", 1 / 3600, cfg), one, cfg))
    at_once = rest.rest_candidates(grid, one, "x", 1 / 3600, cfg)
    assert flat(at_once) == parts and len(parts) > 50
    assert flat(rest.rest_candidates(full, one.with_(rows=100_000), "x", 1 / 3600, cfg)) == parts
    plan = at_once._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if "Exchange" in x]
    assert "__halo" in moves[0] and "__at" in moves[1]


def test_a_summary_table_makes_only_what_it_reads(spark, monkeypatch):
    """Counting overlaps paints no samples and joins no positions; a step that two tables read is made once."""
    from driftline.plans import summary
    ids = "dataset_id string, deployment_id string, "
    at = lambda h: T0 + dt.timedelta(hours=h)
    seg = spark.createDataFrame([("d", "a", at(1), at(2), "find_rest.long_drift", True), ("d", "a", at(5), at(6), "find_rest.long_drift", True)],
                                ids + "start_ts timestamp, end_ts timestamp, state_name string, keep_filtered boolean")
    pred = spark.createDataFrame([("d", "a", at(1), at(3), "sleep", "rf")], ids + "start_ts timestamp, end_ts timestamp, predicted_label string, variant_id string")
    depth = spark.createDataFrame([("d", "a", at(i), float(i)) for i in range(8)], ids + "ts timestamp, depth double")
    loc = spark.createDataFrame([("d", "a", at(0), 1.0, 2.0)], ids + "ts timestamp, latitude double, longitude double")
    dep = spark.createDataFrame([("d", "a", "UTC", 1.0, 2.0)], ids + "tz string, fallback_latitude double, fallback_longitude double")
    did = []
    for where, name in ((summary.intervals, "paint"), (summary.joins, "asof"), (summary, "sun_local_hour"), (summary, "overlap_flags")):
        monkeypatch.setattr(where, name, lambda *a, fn=getattr(where, name), name=name, **kw: did.append(name) or fn(*a, **kw))
    t = summary.summary_tables(seg, pred, depth, loc, dep, depth.withColumnRenamed("depth", "value"), Axis(("dataset_id", "deployment_id"), ("ts",)))
    assert did == [] and len(t) == 8 and "sunrise_local_hour" not in t["group_comparison"].columns
    assert did == ["paint"] and {r.comparison_level for r in t["group_comparison"].collect()} == {"deployment", "dataset", "group"}
    assert {(r.method, r.weak_confusion, r.n) for r in t["overlap_counts"].collect()} == {("algorithmic", "tp", 1), ("algorithmic", "fn", 1), ("supervised", "tp", 1)}
    assert did == ["paint", "overlap_flags"]
    assert t["putative_rest_summary"].count() == 3 and did == ["paint", "overlap_flags", "asof", "asof"]
    assert t["putative_rest_summary"].columns[-2:] == ["overlap_s", "weak_confusion"]
    assert all(df.count() for df in t.values()) and did.count("paint") == 1 and did.count("sun_local_hour") == 2


def test_spikes_are_cut_by_finished_medians(spark):
    """The task that cuts the spikes holds no aggregate, sort or window of either median."""
    from driftline.operators import rolling
    out = rolling.remove_spikes(recordings(spark).withColumn("x", F.when(F.col("x") % 50 == 7, 1e6).otherwise(F.col("x") % 3)), ["k"], "x", "y", 3.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    assert {r.y for r in out.collect()} == {0.0, 1.0, 2.0}


def test_chunk_parameters_are_not_broadcast(spark, monkeypatch):
    """Staged chunks whose parameters repeat are a small file and many rows by bin, so samples and chunks merge."""
    from driftline.operators import peaks
    seen = []
    inside = peaks.points_in
    monkeypatch.setattr(peaks, "points_in", lambda *a, **kw: seen.append(inside(*a, **kw)) or seen[-1])
    s = recordings(spark)
    span = s.groupBy("k").agg(F.min("ts").alias("chunk_start"), F.max("ts").alias("chunk_end"))
    chunks = span.select("*", F.lit("pending").alias("status"), F.create_map(F.lit("height"), F.lit("2")).alias("params_override"))
    off = {f"enable_{x}": 0.0 for x in ("bandpass", "spike_removal", "absolute", "smoothing", "normalization")}
    got = peaks.detect_beats_by_chunk(s, AX, "x", 1.0, chunks, off, 86400.0)
    assert got.columns[:3] == s.columns and len(seen) == 1
    assert "SortMergeJoin" in joins(seen[0]) and "Broadcast" not in joins(seen[0])
