"""Cadence, gaps, grids, resampling, interpolation and crops on the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.stats import ordered_means
from ..operators import filters, folds, islands, timebase as tb
from ..schema import add_seconds
from ..sources.tables import load, signal_axis, signals
from .q_islands import runs_sql, us
from .registry import SIG, query

STEP = f"""{SIG}, st AS (SELECT *, lag(us) OVER w AS prev_us, (us - lag(us) OVER w) / 1e6 AS dt, lead(us) OVER w AS next_us,
  row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS cnt FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("t1_build_datetime", """SELECT o_orderkey, epoch_us(o_orderdate) - 19800000000 AS local_us,
  epoch_us(o_orderdate) + 3723000000 AS epoch_us, epoch_us(o_orderdate) + 3723000000 AS text_us FROM orders""")
def t1(spark, d):
    o = load(spark, d, "orders").withColumns({
        "date": F.date_format("o_orderdate", "MM/dd/yy"), "time": F.lit("00:00:00"),
        "secs": F.unix_seconds("o_orderdate") + 3723,
        "text": F.date_format(add_seconds("o_orderdate", 3723.0), "HH:mm:ss dd-MMM-yyyy")})
    a = tb.build_datetime(o, "Asia/Kolkata", out="local_ts")
    b = tb.build_datetime(a.drop("date", "time").withColumnRenamed("secs", "datetimenum"), out="epoch_ts")
    c = tb.build_datetime(b.drop("datetimenum").withColumnRenamed("text", "datetime"), units={"datetime": "HH:MM:SS DD-Mon-YYYY"}, out="text_ts")
    return c.select("o_orderkey", us("local_ts", "local_us"), us("epoch_ts", "epoch_us"), us("text_ts", "text_us"))


@query("t3_cadence", f"""WITH {STEP} SELECT user_id, round(median(dt), 5) AS median_step_s, round(1e3 / median(dt), 6) AS fs_mhz,
  round(avg(dt), 5) AS mean_step_s FROM st WHERE dt > 0 GROUP BY 1""")
def t3(spark, d):
    sig, ax = signals(spark, d), signal_axis(spark, d)
    m = tb.cadence(sig, ax).select("user_id", F.round("step_s", 5).alias("median_step_s"), F.round(F.col("fs_hz") * 1000, 6).alias("fs_mhz"))
    a = tb.cadence(sig, ax, "mean_rounded").select("user_id", F.round("step_s", 5).alias("mean_step_s"))
    return m.join(a, "user_id")


@query("t4_time_gaps", f"""WITH {STEP}, nm AS (SELECT user_id, median(dt) AS m FROM st WHERE dt > 0 GROUP BY 1)
  SELECT user_id, prev_us AS gap_start_us, us AS gap_end_us, round(dt, 6) AS gap_s FROM st JOIN nm USING (user_id) WHERE dt > 0 AND dt > 1.5 * m AND dt >= 3600""")
def t4(spark, d):
    g = tb.find_time_gaps(signals(spark, d), signal_axis(spark, d), 1.5, 3600.0)
    return g.select("user_id", us("gap_start", "gap_start_us"), us("gap_end", "gap_end_us"), F.round("gap_s", 6).alias("gap_s"))


@query("t5_order_check", """WITH x AS (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
  SELECT o_custkey, count(CASE WHEN o_orderdate < p THEN 1 END) AS n_backward, count(*) AS n FROM x GROUP BY 1""")
def t5(spark, d):
    from ..core.axis import fit_axis
    o = load(spark, d, "orders")
    ax = fit_axis(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    # arrival order is the order key, an integer axis of its own
    arrival = fit_axis(o, ["o_custkey"], ["o_orderkey"], probe_width=10_000_000)
    return tb.order_check(o, ax.with_(width=arrival.width), ["o_orderkey"])


@query("t6_stride_decimation", f"WITH {STEP} SELECT user_id, event_id FROM st WHERE idx % 7 = 0")
def t6(spark, d):
    return tb.stride(signals(spark, d), signal_axis(spark, d), 7).select("user_id", "event_id")


@query("t6_interval_greedy", f"""WITH RECURSIVE {SIG}, n_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM sig),
  f(user_id, rn, event_id, last, keep) AS (SELECT user_id, rn, event_id, us, TRUE FROM n_ WHERE rn = 1
   UNION ALL SELECT n_.user_id, n_.rn, n_.event_id, CASE WHEN n_.us - f.last >= 43200000000 THEN n_.us ELSE f.last END, n_.us - f.last >= 43200000000
   FROM f JOIN n_ ON n_.user_id = f.user_id AND n_.rn = f.rn + 1)
  SELECT user_id, event_id FROM f WHERE keep""")
def t6g(spark, d):
    return folds.thin_by_interval(signals(spark, d), signal_axis(spark, d), 43200.0).select("user_id", "event_id")


H12 = 43200.0


@query("t7_upsample_hold", f"""WITH {SIG}, g AS (SELECT user_id, unnest(generate_series(min(us), max(us), 43200000000)) AS t FROM sig GROUP BY 1)
  SELECT g.user_id, t AS us, (SELECT value FROM sig s WHERE s.user_id = g.user_id AND s.us <= t ORDER BY s.us DESC LIMIT 1) AS value FROM g""")
def t7(spark, d):
    u = tb.upsample(signals(spark, d), signal_axis(spark, d), H12, ["value"])
    return u.select("user_id", us("ts", "us"), "value")


@query("t8_resample_mean", f"""WITH {SIG}, a AS (SELECT user_id, us // 43200000000 * 43200000000 AS b, avg(value) AS v FROM sig GROUP BY 1, 2),
  g AS (SELECT user_id, unnest(generate_series(min(b), max(b), 43200000000)) AS b FROM a GROUP BY 1)
  SELECT user_id, b AS bin_us, round(v, 6) AS value FROM g LEFT JOIN a USING (user_id, b)""")
def t8(spark, d):
    r = tb.resample(signals(spark, d), signal_axis(spark, d), H12, {"value": ("mean", "value")})
    return r.select("user_id", us("bin_ts", "bin_us"), F.round("value", 6).alias("value"))


REG = f"""{SIG}, hb AS (SELECT user_id, us // 21600000000 * 21600000000 AS t, avg(value) AS value, min(event_type) AS et FROM sig GROUP BY 1, 2),
  g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 21600000000)) AS t FROM hb GROUP BY 1),
  j AS (SELECT g.user_id, g.t, value, et, value IS NULL AS ins FROM g LEFT JOIN hb USING (user_id, t)),
  nb AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(value IGNORE NULLS) OVER w AS bv,
     last_value(et IGNORE NULLS) OVER w AS be, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(value IGNORE NULLS) OVER f AS fv
   FROM j WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("t9_fill_short_gaps", f"""WITH {REG} SELECT user_id, t AS us, ins AS inserted, round(CASE WHEN ins THEN bv + (fv - bv) * (t - bt) / (ft - bt) ELSE value END, 6) AS value,
  coalesce(et, be) AS event_type FROM nb""")
def t9(spark, d):
    ax = signal_axis(spark, d)
    h = signals(spark, d).groupBy("user_id", tb.bucket("ts", 21600.0).alias("ts")).agg(
        F.avg("value").alias("value"), F.min("event_type").alias("event_type"))
    x = tb.fill_short_gaps(h, ax.with_(order=("ts",)), ["value"], ["event_type"], limit_s=40 * 86400.0)
    return x.select("user_id", us("ts", "us"), "inserted", F.round("value", 6).alias("value"), "event_type")


@query("t10_series_aggregates", f"""WITH {SIG}, m AS (SELECT user_id, us // 43200000000 * 43200000000 AS b, sqrt(value * value + k * k) AS mag, k FROM sig),
  a AS (SELECT user_id, b, avg(mag) AS av, max(mag) - min(mag) AS rg, avg(k) AS dk, max(k) - min(k) AS dr, count(*) AS n FROM m GROUP BY 1, 2),
  g AS (SELECT user_id, unnest(generate_series(min(b), max(b), 43200000000)) AS b FROM a GROUP BY 1)
  SELECT user_id, b AS bin_us, round(av, 6) AS activity, round(rg, 6) AS activity_range, round(dk, 6) AS depth, round(dr, 6) AS depth_range,
    coalesce(n, 0) AS n_samples FROM g LEFT JOIN a USING (user_id, b)""")
def t10(spark, d):
    x = tb.series_aggregates(signals(spark, d).withColumn("z", F.lit(0.0)), signal_axis(spark, d), H12, ("value", "k", "z"), {"depth": "k"})
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("user_id", us("bin_ts", "bin_us"), r("activity"), r("activity_range"), r("depth"), r("depth_range"), "n_samples")


@query("t11_second_means", """SELECT user_id, epoch_us(date_trunc('second', ts)) AS sec_us, round(avg(value), 6) AS pitch FROM events GROUP BY 1, 2""")
def t11(spark, d):
    x = tb.resample(signals(spark, d), signal_axis(spark, d), 1.0, {"pitch": ("mean", "value")}, fill_grid=False)
    return x.select("user_id", us("bin_ts", "sec_us"), F.round("pitch", 6).alias("pitch"))


DAYS = f"""{SIG}, db AS (SELECT user_id, us // 86400000000 AS b, avg(value) AS x, avg(k) AS y FROM sig GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b) AS i FROM db)"""


def daily(spark, d):
    s = signals(spark, d).withColumn("ts", tb.bucket("ts", 86400.0))
    return ordered_means(s, ["user_id", "ts"], ["event_id"], {"x": "value", "y": "k"})


@query("a23_lag_curve", f"""WITH {DAYS}, l AS (SELECT l FROM generate_series(-5, 5) t(l)),
  p AS (SELECT a.user_id, l AS lag, corr(a.x, b.y) AS r, count(*) AS pairs FROM rk a CROSS JOIN l JOIN rk b ON b.user_id = a.user_id AND b.i = a.i - l GROUP BY 1, 2)
  SELECT user_id, lag, round(r, 6) AS r, pairs FROM p WHERE pairs >= 10""")
def a23(spark, d):
    c = tb.lag_curve(daily(spark, d), signal_axis(spark, d).with_(order=("ts",)), "x", "y", 5)
    return c.select("user_id", F.col("lag").cast("bigint").alias("lag"), F.round("r", 6).alias("r"), "pairs")


# Two-sided p of a correlation $r over n pairs: the closed sums over powers of the cosine for whole degrees of freedom v = n - 2.
T_P = """(1 - CASE WHEN (n - 2) % 2 = 0 THEN abs($r) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - $r * $r, k)) FROM range(0, (n - 2) // 2) t(k))
   ELSE 2 / pi() * (asin(abs($r)) + abs($r) * sqrt(1 - $r * $r) * coalesce((SELECT sum(exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(1 - $r * $r, k)) FROM range(0, (n - 3) // 2) t(k)), 0)) END)"""


@query("a23_correlation_summary", f"""WITH {DAYS}, rr AS (SELECT *, avg(rx) OVER (PARTITION BY user_id, x) AS ax, avg(ry) OVER (PARTITION BY user_id, y) AS ay FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS rx, row_number() OVER (PARTITION BY user_id ORDER BY y) AS ry FROM rk)),
  l AS (SELECT l FROM generate_series(-5, 5) t(l)),
  p AS (SELECT a.user_id, l AS lag, corr(a.x, b.y) AS r, count(*) AS pairs FROM rk a CROSS JOIN l JOIN rk b ON b.user_id = a.user_id AND b.i = a.i - l GROUP BY 1, 2),
  bl AS (SELECT user_id, arg_max(lag, (abs(r), -lag)) AS best_lag FROM p WHERE pairs >= 10 GROUP BY 1),
  c AS (SELECT user_id, count(*) AS n, corr(x, y) AS pr, corr(ax, ay) AS sr, max(best_lag) AS best_lag FROM rr JOIN bl USING (user_id) GROUP BY 1 HAVING count(*) >= 10)
  SELECT user_id, n, round(pr, 6) AS pearson_r, round(sr, 6) AS spearman_rho, best_lag, round({T_P.replace('$r', 'pr')}, 8) AS pearson_p, round({T_P.replace('$r', 'sr')}, 8) AS spearman_p FROM c""")
def a23s(spark, d):
    from ..operators.budgets import correlate
    x = correlate(daily(spark, d), signal_axis(spark, d).with_(order=("ts",)), "x", "y", 5)
    return x.select("user_id", "n", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"),
                    F.col("best_lag").cast("bigint").alias("best_lag"), F.round("pearson_p", 8).alias("pearson_p"), F.round("spearman_p", 8).alias("spearman_p"))


@query("t12_estimate_lag", f"""WITH {SIG}, s AS (SELECT user_id, us, max(value) AS v FROM sig GROUP BY 1, 2), l AS (SELECT user_id, us + 7200000000 AS us, v FROM s),
  b AS (SELECT user_id, min(us) + 7200000000 AS a, max(us) AS b FROM s GROUP BY 1 HAVING max(us) >= min(us) + 7200000000),
  g AS (SELECT user_id, unnest(generate_series(a, b, 3600000000)) AS us FROM b),
  pq AS (SELECT g.user_id, g.us, p.us AS pu, p.v AS pv, q.us AS qu, q.v AS qv FROM g ASOF JOIN s p ON p.user_id = g.user_id AND p.us <= g.us ASOF JOIN l q ON q.user_id = g.user_id AND q.us <= g.us),
  nx AS (SELECT pq.*, p.us AS pu2, p.v AS pv2, q.us AS qu2, q.v AS qv2 FROM pq ASOF LEFT JOIN s p ON p.user_id = pq.user_id AND p.us > pq.us ASOF LEFT JOIN l q ON q.user_id = pq.user_id AND q.us > pq.us),
  xy AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, CASE WHEN pu = us THEN pv ELSE pv + (pv2 - pv) * (us - pu) / (pu2 - pu) END AS x,
    CASE WHEN qu = us THEN qv ELSE qv + (qv2 - qv) * (us - qu) / (qu2 - qu) END AS y FROM nx),
  c AS (SELECT a.user_id, l AS lag, corr(a.x, b.y) AS r, count(*) AS n FROM xy a CROSS JOIN generate_series(-6, 6) t(l) JOIN xy b ON b.user_id = a.user_id AND b.i = a.i + l WHERE a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY 1, 2)
  SELECT user_id, arg_max(lag, (abs(r), lag)) AS lag, arg_max(lag, (abs(r), lag)) * 3600.0::DOUBLE AS lag_s FROM c WHERE n >= 10 GROUP BY 1""")
def t12(spark, d):
    ax = signal_axis(spark, d).with_(order=("ts",))
    s = signals(spark, d).groupBy("user_id", "ts").agg(F.max("value").alias("x"))
    late = s.select("user_id", add_seconds("ts", 7200.0).alias("ts"), F.col("x").alias("y"))
    return tb.estimate_lag(s, late, ax, "x", "y", 3600.0, 6).select("user_id", "lag", F.round("lag_s", 3).alias("lag_s"))


@query("t13_chunk_grid", f"""WITH {runs_sql('value > 20')}, per AS (SELECT user_id, s, e FROM runs WHERE p AND e > s),
  sz AS (SELECT user_id, sum(e - s) / 1e7 AS raw FROM per GROUP BY 1),
  cs AS (SELECT user_id, CASE WHEN raw <= 60 THEN 60 WHEN raw <= 120 THEN 120 WHEN raw <= 300 THEN 300 WHEN raw <= 600 THEN 600
      WHEN raw <= 900 THEN 900 WHEN raw <= 1800 THEN 1800 ELSE 3600 END * CAST(1000000 AS BIGINT) AS c FROM sz)
  SELECT user_id, b AS start_us, least(b + c, e) AS end_us, 'pending' AS status FROM per JOIN cs USING (user_id), generate_series(s, e - 1, c) t(b)
  UNION ALL SELECT user_id, e, n, 'gap' FROM (SELECT user_id, e, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM per) WHERE n > e""")
def t13(spark, d):
    ax = signal_axis(spark, d)
    per = islands.find_segments(signals(spark, d), ax, F.col("value") > 20).where("duration_s > 0").select("user_id", "start_ts", "end_ts")
    g = tb.chunk_grid(per, ax.with_(order=("start_ts",)), "end_ts")
    return g.select("user_id", us("chunk_start", "start_us"), us("chunk_end", "end_us"), "status")


@query("t14_shared_window", f"""WITH {SIG}, p AS (SELECT user_id, event_type, min(us) AS a, max(us) AS b FROM sig GROUP BY 1, 2),
  w AS (SELECT user_id, max(a) AS s, min(b) AS e, min(a) AS us_, max(b) AS ue FROM p GROUP BY 1),
  x AS (SELECT user_id, CASE WHEN e > s THEN s ELSE us_ END AS a, CASE WHEN e > s THEN e ELSE ue END AS b, e > s AS overlapping FROM w)
  SELECT user_id, a AS start_us, b AS end_us, overlapping, greatest(a, CAST(floor((a + b) / 2) AS BIGINT) - 300000000) AS zoom_start_us,
    least(b, CAST(floor((a + b) / 2) AS BIGINT) + 300000000) AS zoom_end_us FROM x""")
def t14(spark, d):
    w = tb.shared_window(signals(spark, d), ["user_id"], "event_type", "ts")
    a, b = tb.middle_window("start_ts", "end_ts", 10)
    return w.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "overlapping",
                    F.unix_micros(a).alias("zoom_start_us"), F.unix_micros(b).alias("zoom_end_us"))


@query("t15_regularize_track", f"""WITH {SIG}, b AS (SELECT user_id, CAST(ceil(min(us) / 3600e6) AS BIGINT) * 3600000000 AS lo, CAST(floor(max(us) / 3600e6) AS BIGINT) * 3600000000 AS hi FROM sig GROUP BY 1),
  g AS (SELECT user_id, unnest(generate_series(lo, hi, 3600000000)) AS t FROM b),
  pr AS (SELECT g.user_id, g.t, s.us AS bt, s.value AS bv FROM g ASOF JOIN sig s ON s.user_id = g.user_id AND s.us <= g.t),
  nx AS (SELECT pr.*, s.us AS ft, s.value AS fv FROM pr ASOF JOIN sig s ON s.user_id = pr.user_id AND s.us >= pr.t)
  SELECT user_id, t AS us, round(CASE WHEN ft > bt THEN bv + (fv - bv) * (t - bt) / (ft - bt) ELSE bv END, 5) AS value FROM nx""")
def t15(spark, d):
    from ..operators.geo import regularize_track
    x = regularize_track(signals(spark, d), signal_axis(spark, d), 3600.0, ["value"])
    return x.select("user_id", us("ts", "us"), F.round("value", 5).alias("value"))


@query("p14_snap_jitter", f"""WITH {STEP}, f AS (SELECT user_id, min(us) AS t0 FROM sig GROUP BY 1),
  z AS (SELECT user_id, event_id, us, t0 + CAST(round(idx * 1e6 / 0.0001) AS BIGINT) AS sn FROM st JOIN f USING (user_id))
  SELECT user_id, event_id, sn AS snapped_us, abs(sn - us) > 5000 AS off FROM z""")
def p14(spark, d):
    x = tb.snap_jitter(signals(spark, d), signal_axis(spark, d), 0.0001)
    return x.select("user_id", "event_id", us("snapped_ts", "snapped_us"), "off")


@query("s10_collate_signals", f"""WITH {SIG}, b AS (SELECT user_id, us // 21600000000 * 21600000000 AS t, avg(value) AS x, avg(k) FILTER (event_type <> 'view') AS y FROM sig GROUP BY 1, 2),
  g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 21600000000)) AS t FROM b GROUP BY 1),
  j AS (SELECT g.user_id, g.t, x FROM g LEFT JOIN b USING (user_id, t)),
  nb AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(x IGNORE NULLS) OVER w AS bv,
     first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(x IGNORE NULLS) OVER f AS fv
   FROM j WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT user_id, t AS bin_us, round(coalesce(x, bv + (fv - bv) * (t - bt) / (ft - bt)), 8) AS x FROM nb""")
def s10(spark, d):
    sig = signals(spark, d).withColumnRenamed("value", "x")
    x = tb.collate({"depth": (sig, ["x"]), "stroke": (sig.where("event_type <> 'view'").withColumnRenamed("k", "y"), ["y"])},
                   signal_axis(spark, d), "depth", 21600.0)
    return x.select("user_id", us("bin_ts", "bin_us"), F.round("x", 8).alias("x"))


# --- crops and selectors -----------------------------------------------------------------------------

W0, W1 = "TIMESTAMP '2024-01-10 06:00:00'", "TIMESTAMP '2024-01-20 18:00:00'"


@query("f1_time_crop", f"SELECT event_id, value FROM events WHERE ts BETWEEN {W0} AND {W1}")
def f1(spark, d):
    return filters.crop(signals(spark, d), "ts", F.expr(W0), F.expr(W1)).select("event_id", "value")


@query("f2_half_open_crop", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def f2(spark, d):
    return filters.crop(load(spark, d, "orders"), "o_orderdate", F.expr("TIMESTAMP '1996-01-01'"), F.expr("TIMESTAMP '1996-02-01'"), True).select("o_orderkey")


@query("f3_trim_to_anchor", f"""WITH {SIG}, a AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM sig WHERE event_type = 'view' GROUP BY 1)
  SELECT event_id FROM sig JOIN a USING (user_id) WHERE us + CAST(k * 3600000000 AS BIGINT) >= lo AND us <= hi""")
def f3(spark, d):
    sig = signals(spark, d).withColumns({"end_ts": F.lit(None).cast("timestamp"), "duration_s": F.col("k") * 3600})
    return filters.trim_to_anchor(sig, sig.where("event_type = 'view'"), ["user_id"], "ts", filters.event_end()).select("event_id")


@query("f4_crop_requires_overlap", f"""WITH {SIG}, a AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM sig WHERE event_type = 'click' GROUP BY 1)
  SELECT event_id FROM sig JOIN a USING (user_id) WHERE us BETWEEN lo AND hi""")
def f4(spark, d):
    sig = signals(spark, d)
    return filters.trim_to_anchor(sig, sig.where("event_type = 'click'"), ["user_id"], "ts", require=True).select("event_id")


@query("f5_attachment_mask", f"""WITH {runs_sql('value > 60')} SELECT event_id FROM sig x WHERE EXISTS (SELECT 1 FROM runs r WHERE p AND r.user_id = x.user_id AND x.us BETWEEN s AND e)""")
def f5(spark, d):
    sig, ax = signals(spark, d), signal_axis(spark, d)
    per = islands.find_segments(sig, ax, F.col("value") > 60).select("user_id", "start_ts", "end_ts")
    return filters.attached(sig, per, ["user_id"], "ts", ("start_ts", "end_ts")).select("event_id")


@query("f6_null_bad_spans", f"""WITH {runs_sql('value > 80')}, m AS (SELECT *, lag(p) OVER w AS pp, lead(p) OVER w AS np FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n_ AS (SELECT *, CASE WHEN p OR coalesce(pp, FALSE) OR coalesce(np, FALSE) THEN NULL ELSE k END AS kk FROM m),
  nb AS (SELECT *, last_value(CASE WHEN kk IS NOT NULL THEN us END IGNORE NULLS) OVER w AS bt, last_value(kk IGNORE NULLS) OVER w AS bv,
     first_value(CASE WHEN kk IS NOT NULL THEN us END IGNORE NULLS) OVER f AS ft, first_value(kk IGNORE NULLS) OVER f AS fv
   FROM n_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(coalesce(kk, bv + (fv - bv) * (us - bt) / (ft - bt)), 5) AS k FROM nb""")
def f6(spark, d):
    sig, ax = signals(spark, d), signal_axis(spark, d)
    bad = islands.find_segments(sig, ax, F.col("value") > 80).select("user_id", "start_ts", "end_ts")
    return filters.null_bad_spans(sig, bad, ax, ["k"], 21600.0).select("event_id", F.round("k", 5).alias("k"))


@query("f7_threshold_trim", f"""WITH {SIG} SELECT user_id, min(us) FILTER (value >= 120) AS trim_start_us, max(us) FILTER (value >= 120) AS trim_end_us,
  CASE WHEN count(*) FILTER (value >= 120) = 0 THEN 'no_in_water_interval' ELSE 'ok' END AS trim_status FROM sig GROUP BY 1""")
def f7(spark, d):
    w = filters.threshold_window(signals(spark, d), ["user_id"], "ts", "value", 120.0)
    return w.select("user_id", us("trim_start", "trim_start_us"), us("trim_end", "trim_end_us"), "trim_status")


@query("f8_state_selector", """SELECT event_id, event_type LIKE 'c%' AS prefix_hit, event_type = 'view' AS exact_hit, event_type <> 'error' AS positive_hit FROM events""")
def f8(spark, d):
    s = signals(spark, d).withColumn("state_name", F.when(F.col("event_type") == "error", "not_sleep").when(
        F.col("event_type").startswith("c"), F.concat(F.lit("c."), "event_type")).otherwise(F.col("event_type")))
    return s.select("event_id", filters.state_selector("c.*").alias("prefix_hit"), filters.state_selector("view").alias("exact_hit"),
                    filters.state_selector("__all_positive__").alias("positive_hit"))


@query("f9_events_in_window", f"""WITH {SIG} SELECT event_id FROM sig WHERE us <= epoch_us({W1}) AND
  CASE WHEN event_type IN ('view', 'click') THEN us + CAST(k * 3600000000 AS BIGINT) ELSE us END >= epoch_us({W0})""")
def f9(spark, d):
    s = signals(spark, d).withColumn("dur", F.col("k") * 3600)
    return filters.events_in_window(s, "ts", "dur", "event_type", ["view", "click"], F.expr(W0), F.expr(W1)).select("event_id")


@query("f10_nyquist_guard", f"WITH {STEP} SELECT user_id, 0.00001 < 1 / median(dt) / 2 AS filterable FROM st WHERE dt > 0 GROUP BY 1")
def f10(spark, d):
    return filters.nyquist_ok(tb.cadence(signals(spark, d), signal_axis(spark, d)), "fs_hz", [0.000005, 0.00001]).select("user_id", "filterable")


@query("f12_complete_days", """WITH h AS (SELECT event_type, CAST(ts AS DATE) AS d, count(DISTINCT hour(ts)) AS n FROM events GROUP BY 1, 2)
  SELECT event_id FROM events e JOIN h ON h.event_type = e.event_type AND h.d = CAST(e.ts AS DATE) WHERE n = 24""")
def f12(spark, d):
    return filters.complete_days(signals(spark, d), ["event_type"], "ts").select("event_id")


@query("f13_between_labels", f"""WITH {SIG}, b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM sig WHERE event_type = 'signup' GROUP BY 1)
  SELECT event_id FROM sig JOIN b USING (user_id) WHERE us BETWEEN lo AND hi""")
def f13(spark, d):
    s = signals(spark, d)
    return filters.within_labels(s, s.where("event_type = 'signup'"), ["user_id"], "ts", "ts").select("event_id")


@query("l4_stride_with_last", f"WITH {STEP} SELECT user_id, event_id FROM st WHERE idx % 10 = 0 OR idx = cnt - 1")
def l4(spark, d):
    return tb.stride_last(signals(spark, d), signal_axis(spark, d), 10).select("user_id", "event_id")


@query("h3_suppress_close", f"WITH {STEP} SELECT user_id, event_id FROM st WHERE next_us IS NULL OR next_us - us >= 21600000000")
def h3(spark, d):
    return folds.suppress_close(signals(spark, d), signal_axis(spark, d), 21600.0).select("user_id", "event_id")
