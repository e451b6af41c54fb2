"""Results that must not depend on the order in which partial sums meet."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from driftline.core.axis import Axis
from driftline.core.halo import entity_apply
from driftline.core.stats import median, ordered_means, quantiles, steady_mean
from driftline.operators import depth, islands, orient, peaks

T0 = dt.datetime(2021, 1, 1)


def test_no_slope_without_varying_temperature(spark):
    """Equal temperatures, met in several partial sums, have no slope; a straight line has its own."""
    rows = [(i, T0 + dt.timedelta(seconds=s), 5.0 + s % 7, 29.1 + i / 7, 3.0 * (s % 11) - 2) for i in range(40) for s in range(61)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v double, t double, line double").repartition(5)
    chunks = df.groupBy("id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    axis = Axis(("id",), ("ts",))
    got = depth.chunk_regression(df, chunks, axis, "v", "t", bin_s=10.0).collect()
    assert len(got) == 40 and all(r.slope is None and r.intercept is None and r.n == 61 for r in got)
    y = df.withColumn("v", F.col("line") * 2 + 1)
    got = depth.chunk_regression(y, chunks, axis, "v", "line", bin_s=10.0).collect()
    assert all(abs(r.slope - 2) < 1e-12 and abs(r.intercept - 41) < 1e-10 for r in got)


def test_equal_means_are_equal_to_the_last_bit(spark):
    """19.66 as a mean of one value repeated, of two in either order, and of values that are no decimals."""
    parts = {"a": [19.66] * 6, "b": [9.33, 29.99] * 3, "c": [29.99] * 3 + [9.33] * 3, "d": [0.1, 19.66, 39.22], "e": [39.22, 19.66, 0.1]}
    df = spark.createDataFrame([(k, v) for k, vs in parts.items() for v in vs], "k string, v double").repartition(3)
    got = {r.k: r.m for r in df.groupBy("k").agg(steady_mean("v").alias("m")).collect()}
    assert set(got.values()) == {19.66}
    odd = spark.createDataFrame([("a", 1 / 3), ("a", None), ("b", float("nan")), ("b", 1.0), ("c", 1e300), ("d", None)], "k string, v double")
    got = {r.k: r.m for r in odd.groupBy("k").agg(steady_mean("v").alias("m")).collect()}
    assert got["a"] == 1 / 3 and got["b"] != got["b"] and got["c"] == 1e300 and got["d"] is None


def test_means_add_rows_in_order(spark):
    """0.1, 0.2 and 0.3 make another double than 0.3, 0.2 and 0.1; rows meet in the order of their ids, however they are dealt."""
    parts = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [None, 7.0], "d": [None], "e": [19.17, 0.1, 29.99, 9.33, 0.7] * 12}
    rows = [(k, i, v) for k, vs in parts.items() for i, v in enumerate(vs)]
    want = {}
    for k, vs in parts.items():
        total = 0.0
        for v in (v for v in vs if v is not None):
            total += v
        n = sum(v is not None for v in vs)
        want[k] = total / n if n else None
    assert want["a"] != want["b"]
    for dealt in (1, 7):
        df = spark.createDataFrame(rows[::-1], "k string, i long, v double").repartition(dealt)
        assert {r.k: r.m for r in ordered_means(df, ["k"], ["i"], {"m": "v"}).collect()} == want


def test_daily_means_are_those_of_the_sql(spark, tmp_path):
    """Two days whose rows differ in their order only: the SQL adds them as they are stored and ranks the days apart, so do we."""
    import duckdb
    from driftline.plans import q_timebase
    days = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], *[[x, x / 3, 1.7] for x in range(1, 12)]]
    rows = [(3 * d + i, T0 + dt.timedelta(days=d, hours=i), 1, "view", float(v), '{"k": %d}' % (d * i % 5)) for d, vs in enumerate(days) for i, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute("SELECT epoch_us(ts) // 86400000000, avg(value) FROM events GROUP BY 1 ORDER BY 1").fetchall()
    got = q_timebase.daily(spark, str(tmp_path)).selectExpr("unix_micros(ts) div 86400000000 AS day", "x").orderBy("day").collect()
    assert [(r.day, r.x) for r in got] == want and want[0][1] != want[1][1]


def test_small_groups_share_batches(spark):
    """Groups smaller and larger than an Arrow batch, null keys too, come whole and in order, and no group is a stream of its own."""
    rows = [(None if k == 3 else k, i, float((i * 37 + k) % 101)) for k in range(23) for i in range(1 + (k * k * 7) % 60)]
    df = spark.createDataFrame(rows, "k long, t long, v double").repartition(3)
    axis = Axis(("k",), ("t",), rows=1000)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        run = lambda x: {"s": np.cumsum(x["v"]), "n": np.full(len(x["v"]), len(x["v"])), "odd": np.arange(len(x["v"])) % 2 == 1}
        d = entity_apply(df, axis, run, ["v"], {"s": "double", "n": "bigint", "odd": "boolean"}, keep="odd")
        got = {(r.k, r.t): (r.s, r.n) for r in d.collect()}
        assert "FlatMapGroups" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == k) if k is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        total = np.cumsum([r[2] for r in own])
        want.update({(k, r[1]): (s, len(own)) for i, (r, s) in enumerate(zip(own, total)) if i % 2})
    assert got == want


def test_median_of_two_is_their_halves(spark):
    """Two values as far below as above 20 have the median 20; a difference that is rounded first gives less."""
    rows = [(k, x) for k in range(1, 2000) for x in ((2000 - k) / 100, (2000 + k) / 100)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    assert {r.m for r in median(df, ["k"], "v", "m").collect()} == {20.0}
    got = quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), [], "v", {"a": 0.0, "b": 0.25, "c": 1.0}).first()
    assert (got.a, got.b, got.c) == (1.0, 1.5, 4.0)


def test_quantile_between_equal_values_is_that_value(spark):
    """The 80 % quantile of 54 or 63 rows lies between two equal scores; a sum rounded twice ends above or below, and rows fall out of the tail."""
    rows = [(n, i, x if i >= 5 else 0.0) for n, x in ((54, 0.85), (63, 0.84), (75, 0.82), (74, 0.87)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, p double")
    got = quantiles(df, ["k"], "p", {"lo": 0.2, "hi": 0.8}).collect()
    assert {r.k: (r.lo, r.hi) for r in got} == {54: (0.85, 0.85), 63: (0.84, 0.84), 75: (0.82, 0.82), 74: (0.87, 0.87)}
    tails = peaks.tail_pseudo_labels(df, ["k"], "p").collect()
    assert all(r.pseudo_label == (1 if r.i >= 5 else 0) for r in tails) and len(tails) == len(rows)


def test_quantile_is_rounded_once(spark):
    """0.2 of the way from 0.22 to 0.23 as DuckDB gives it."""
    rows = [(float(x),) for x in [0.0] * 11 + [0.22, 0.23] + [1.0] * 44]
    assert quantiles(spark.createDataFrame(rows, "v double"), [], "v", {"q": 0.2}).first().q == 0.222


def test_runs_that_start_at_one_instant_stay_apart(spark):
    """Two flat runs whose first rows share an instant have a median each."""
    at = [0, 0, 0, 0, 0, 1, 2]
    slope, x, code = [0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0, 50.0, 4.0, 5.0, 6.0], [1, 1, 1, 2, 1, 1, 1]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), i, *r, f"t{i}") for i, (s, *r) in enumerate(zip(at, slope, x, code))],
                               "id string, ts timestamp, n long, slope double, x double, code long, label string")
    axis = Axis(("id",), ("ts", "n"))
    got = islands.flat_chunks(df, axis, "x", "slope", 0.5, 3, 20.0).collect()
    assert sorted((r.n, r.median_value) for r in got) == [(3, 2.0), (3, 5.0)]
    step = spark.createDataFrame([("a", 1.0)], "id string, step_s double")
    got = islands.label_states(df, axis, "code", "label", step).collect()
    assert sorted((r.code, r.n, r.label_text) for r in got) == [(1, 3, "t0"), (1, 3, "t4"), (2, 1, "t3")]


def test_posture_of_repeated_rows_is_the_row(spark):
    """Rows that repeat one vector have that vector as their mean posture, to the last bit, however they are dealt."""
    v = [0.1, 7 / 25 - 1, (19.17 + 26) / 80 - 1]
    df = spark.createDataFrame([(n, i % 2 == 0, *v) for n in (1, 10, 60, 61) for i in range(n)], "id long, calm boolean, x double, y double, z double")
    for parts in (1, 7):
        got = orient.mean_posture(df.repartition(parts), ["id"], ["x", "y", "z"], F.col("calm")).collect()
        assert len(got) == 4 and all([r.abar0, r.abar1, r.abar2] == v for r in got)


def test_upside_down_is_one_angle(spark):
    """A vector that its own mean posture levels has a roll of 0; turned over along its axis, of 180, never -180."""
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    own = orient.posture_angles(df.select("id", *[F.col(c).alias(f"abar{i}") for i, c in enumerate("xyz")]), ["id"])
    rolls = lambda d: {round(r.roll_deg, 9) for r in orient.animal_frame(d, own, ["id"], ["x", "y", "z"]).collect()}
    assert rolls(df) == {0.0}
    assert rolls(df.withColumns({c: -F.col(c) for c in "xyz"})) == {180.0}
    nothing = df.limit(3).withColumn("z", F.lit(float("nan")))
    assert all(r.roll_deg != r.roll_deg for r in orient.animal_frame(nothing, own, ["id"], ["x", "y", "z"]).collect())


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Where a grid has more rows than the session's partitions should hold, the scan and the grid are dealt to more tasks, with the same rows."""
    from driftline.core import axis as core_axis
    from driftline.core.axis import fit_axis
    from driftline.operators import geo
    df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=7 * i), float(i)) for k in range(6) for i in range(40)], "id long, ts timestamp, v double")
    few = fit_axis(df, ["id"], ["ts"])
    want = {(r.id, r.ts): r.v for r in geo.regularize_track(df, few, 3600.0, ["v"]).collect()}
    smooth = {(r.id, r.ts): r.v_smoothed for r in geo.hourly_smooth(df, few, ["v"]).collect()}
    monkeypatch.setattr(core_axis, "ROWS_A_TASK", 60)
    many = fit_axis(df, ["id"], ["ts"])
    assert few.tasks == 1 and many.tasks == 4
    out = geo.regularize_track(df, many, 3600.0, ["v"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"], {-(-len(want) // 60)}") >= 2
    assert {(r.id, r.ts): r.v for r in out.collect()} == want and len(want) == 6 * 274
    assert {(r.id, r.ts): r.v_smoothed for r in geo.hourly_smooth(df, many, ["v"]).collect()} == smooth


def test_fits_of_a_small_file_take_all_tasks(spark, monkeypatch, tmp_path):
    """A file of one partition is fitted and scored in several tasks, and what is calibrated on the scores does not score again."""
    from driftline.operators import learn
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, v), str(int(v[0] + v[1] > 0)), i % 5) for i, v in enumerate(rng.normal(size=(2400, 2)))]
    spark.createDataFrame(rows, "id long, a double, b double, label string, g long").coalesce(1).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    assert df.rdd.getNumPartitions() == 1
    fitted = []
    fit = learn.Pipeline.fit
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, d, *a: fitted.append(d.rdd.getNumPartitions()) or fit(self, d, *a))
    out = learn.out_of_fold(learn.group_folds(df, "g", 3), ["a", "b"], "label", 3, trees=4, depth=4)
    tasks = min(spark.sparkContext.defaultParallelism, 2)
    assert len(fitted) == 3 and min(fitted) >= tasks
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(2400)) and np.mean([r.predicted_label == r.label for r in got]) > 0.85
