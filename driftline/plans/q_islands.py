"""Run detection, segment statistics and the daily state budget on the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.runs import find_runs, label_runs
from ..core.scan import scan
from ..operators import islands, segments
from ..operators.intervals import prorate
from ..sources.tables import signal_axis, signals
from .registry import SIG, query


def us(c, out=None):
    return F.unix_micros(c).alias(out or c)


def runs_sql(pred: str, extra: str = "") -> str:
    """CTEs sig, rows_ (each row with its run number) and runs (one row per run)."""
    return f"""{SIG}, f_ AS (SELECT *, {pred} AS p FROM sig),
    g_ AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND p IS NOT DISTINCT FROM lag(p) OVER w THEN 0 ELSE 1 END AS chg,
             row_number() OVER w - 1 AS idx, lag(us) OVER w AS prev_us
           FROM f_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    rows_ AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM g_),
    runs AS (SELECT user_id, isl, p, min(us) AS s, max(us) AS e, count(*) AS n, min(idx) AS i0, max(idx) AS i1{extra}
             FROM rows_ GROUP BY user_id, isl, p)"""


@query("daily_state_budget", f"""WITH {runs_sql('value > 30')},
  d AS (SELECT r.user_id, b, least(e, b + 86400000000) - greatest(s, b) AS piece
        FROM runs r, generate_series(s // 86400000000 * 86400000000, e, 86400000000) t(b) WHERE p AND e > s)
  SELECT strftime(make_timestamp(b), '%Y-%m-%d') AS local_date, 'above' AS state, count(*) AS n_pieces,
    round(sum(piece) / 3.6e9, 6) AS hours, round(100.0 * sum(piece) / 8.64e10 / count(DISTINCT user_id), 6) AS pct_of_24h
  FROM d WHERE piece > 0 GROUP BY b""")
def daily_state_budget(spark, d):
    seg = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 30)
    days = prorate(seg, "day")
    return days.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("seconds").alias("s"), F.count_distinct("user_id").alias("u"),
    ).select(F.date_format("bucket", "yyyy-MM-dd").alias("local_date"), F.lit("above").alias("state"), "n_pieces",
             F.round(F.col("s") / 3600, 6).alias("hours"), F.round(100 * F.col("s") / 86400 / F.col("u"), 6).alias("pct_of_24h"))


@query("r1_segments_min_duration", f"""WITH {runs_sql('value > 30', ', max(value) AS mx, avg(value) AS av')}
  SELECT user_id, i0 AS start_index, i1 AS end_index, s AS start_us, e AS end_us, round((e - s) / 1e6, 6) AS duration_s,
    n, mx AS max_value, round(av, 6) AS mean_value FROM runs WHERE p AND e - s >= 3600000000""")
def r1(spark, d):
    seg = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 30, 3600.0,
                                {"mx": ("max", "value"), "sm": ("sum", "value")}, with_index=True)
    return seg.select("user_id", "start_index", "end_index", us("start_ts", "start_us"), us("end_ts", "end_us"),
                      F.round("duration_s", 6).alias("duration_s"), "n", F.col("mx").alias("max_value"),
                      F.round(F.col("sm") / F.col("n"), 6).alias("mean_value"))


def _spans(spark, d, pred):
    return islands.find_segments(signals(spark, d), signal_axis(spark, d), pred)


@query("r2_adjusted_segments", f"""WITH {runs_sql('value > 20')}, par AS (SELECT * FROM runs WHERE p),
  k_ AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (k > 40) IS NOT DISTINCT FROM (lag(k) OVER w > 40) THEN 0 ELSE 1 END AS c
        FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  k2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ki FROM k_),
  chi AS (SELECT user_id, ki, min(us) AS s, max(us) AS e FROM k2 WHERE k > 40 GROUP BY 1, 2),
  fl AS (SELECT *, EXISTS (SELECT 1 FROM par q WHERE q.user_id = x.user_id AND x.us BETWEEN q.s AND q.e)
              AND EXISTS (SELECT 1 FROM chi q WHERE q.user_id = x.user_id AND x.us BETWEEN q.s AND q.e) AS both_ FROM sig x),
  h AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND both_ = lag(both_) OVER w THEN 0 ELSE 1 END AS c FROM fl
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  h2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM h)
  SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM h2 WHERE both_ GROUP BY user_id, hi""")
def r2(spark, d):
    sig, ax = signals(spark, d), signal_axis(spark, d)
    parents, kids = _spans(spark, d, F.col("value") > 20), _spans(spark, d, F.col("k") > 40)
    out = islands.find_adjusted_segments(sig, ax, parents, kids, bin_s=6 * 3600.0)
    return out.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "n")


@query("r3_gaps_between_segments", f"""WITH {runs_sql('value > 30')}, seg AS (SELECT *,
    lead(i0) OVER (PARTITION BY user_id ORDER BY i0) AS nx FROM runs WHERE p AND e - s >= 7200000000)
  SELECT g.user_id, g.i1 + 1 AS start_index, g.nx - 1 AS end_index, a.us AS start_us, b.us AS end_us,
    round((b.us - a.us) / 1e6, 6) AS duration_s
  FROM seg g JOIN rows_ a ON a.user_id = g.user_id AND a.idx = g.i1 + 1
             JOIN rows_ b ON b.user_id = g.user_id AND b.idx = g.nx - 1 WHERE nx IS NOT NULL""")
def r3(spark, d):
    sig, ax = signals(spark, d), signal_axis(spark, d)
    seg = islands.find_segments(sig, ax, F.col("value") > 30, 7200.0, with_index=True)
    return islands.find_gaps(seg, sig, ax).select(
        "user_id", "start_index", "end_index", us("start_ts", "start_us"), us("end_ts", "end_us"),
        F.round("duration_s", 6).alias("duration_s"))


@query("r4_run_length_encoding", f"""WITH {runs_sql('event_type')}
  SELECT user_id, p AS value, s AS start_us, n AS run_length FROM runs""")
def r4(spark, d):
    r = find_runs(signals(spark, d), signal_axis(spark, d), "event_type")
    return r.select("user_id", "value", us("start_ts", "start_us"), F.col("n").alias("run_length"))


@query("r5_mask_periods", f"""WITH {runs_sql('k >= 30')},
  st AS (SELECT user_id, isl, median(us - prev_us) AS step FROM rows_ WHERE p AND chg = 0 GROUP BY 1, 2)
  SELECT r.user_id, s AS start_us, e + CAST(floor(coalesce(step, 0) + 0.5) AS BIGINT) AS end_us, n
  FROM runs r LEFT JOIN st USING (user_id, isl) WHERE p""")
def r5(spark, d):
    m = islands.mask_periods(signals(spark, d), signal_axis(spark, d), F.col("k") >= 30)
    return m.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "n")


@query("r6_label_states", f"""WITH {runs_sql("CASE WHEN k < 60 THEN CAST(floor(k / 20) AS BIGINT) END")},
  pos AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM sig),
  st AS (SELECT user_id, median(dt / 1e6) AS step FROM pos WHERE dt > 0 GROUP BY 1),
  tx AS (SELECT user_id, isl, event_type, row_number() OVER (PARTITION BY user_id, isl ORDER BY count(*) DESC, event_type) AS rk
         FROM rows_ WHERE p IS NOT NULL GROUP BY 1, 2, 3)
  SELECT r.user_id, p AS code, s AS start_us, event_type AS label_text, round((e - s) / 1e6 + step, 3) AS duration_s
  FROM runs r JOIN tx USING (user_id, isl) JOIN st ON st.user_id = r.user_id WHERE p IS NOT NULL AND rk = 1""")
def r6(spark, d):
    from ..operators.timebase import cadence
    sig = signals(spark, d).withColumn("code", F.when(F.col("k") < 60, F.floor(F.col("k") / 20)))
    ax = signal_axis(spark, d)
    step = cadence(sig, ax).select("user_id", "step_s")
    return islands.label_states(sig, ax, "code", "event_type", step).select(
        "user_id", "code", us("start_ts", "start_us"), "label_text", F.round("duration_s", 3).alias("duration_s"))


@query("r7_unscorable_states", f"""WITH {runs_sql('CAST(floor(k / 50) AS BIGINT)', ", count(CASE WHEN value > 25 THEN 1 END) AS scored")}
  SELECT user_id, p AS number, s AS start_us, e AS end_us, n, 'unscorable' AS key FROM runs WHERE p IS NOT NULL AND scored = 0""")
def r7(spark, d):
    sig = signals(spark, d).withColumns({"number": F.floor(F.col("k") / 50), "scored": F.when(F.col("value") > 25, F.col("value"))})
    u = islands.unscorable_states(sig, signal_axis(spark, d), "number", "scored")
    return u.select("user_id", "number", us("start_ts", "start_us"), us("end_ts", "end_us"), "n", "key")


@query("r8_reject_spans", f"""WITH {runs_sql("event_type IN ('error', 'signup')",
    ", count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_conflict")},
  nb AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY isl) AS before_, lead(s) OVER (PARTITION BY user_id ORDER BY isl) AS after_ FROM runs)
  SELECT user_id, coalesce(before_, s) AS span_start_us, coalesce(after_, e) AS span_end_us, n AS n_rejected, n_conflict
  FROM nb WHERE p AND n >= CASE WHEN n = n_conflict THEN 2 ELSE 1 END AND coalesce(after_, e) > coalesce(before_, s)""")
def r8(spark, d):
    sig = signals(spark, d).withColumn("kind", F.when(F.col("event_type") == "error", "rejected").when(
        F.col("event_type") == "signup", "conflict").otherwise("good"))
    r = islands.reject_spans(sig, signal_axis(spark, d), "kind")
    return r.select("user_id", us("span_start", "span_start_us"), us("span_end", "span_end_us"), "n_rejected", "n_conflict")


@query("r9_dives", f"""WITH {runs_sql('value > 15', ', max(value) AS mx, count(*) - count(value) AS nn')}
  SELECT user_id, s AS start_us, e AS end_us, mx AS max_depth, nn > 0 AS has_null FROM runs WHERE p AND e - s >= 36000000000""")
def r9(spark, d):
    x = islands.dives(signals(spark, d), signal_axis(spark, d), "value", 15.0, 36000.0)
    return x.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "max_depth", "has_null")


@query("r10_dives_with_edges", f"""WITH {runs_sql('k > 30')}, seg AS (SELECT * FROM runs WHERE p AND e - s >= 3600000000),
  st AS (SELECT g.user_id, g.s, arg_min(x.us, (abs(x.value), x.us, x.event_id)) AS v FROM seg g JOIN sig x ON x.user_id = g.user_id
         AND x.us BETWEEN g.s - 43200000000 AND g.s + 43200000000 GROUP BY 1, 2),
  en AS (SELECT g.user_id, g.s, arg_min(x.us, (abs(x.value), x.us, x.event_id)) AS v FROM seg g JOIN sig x ON x.user_id = g.user_id
         AND x.us BETWEEN g.e - 43200000000 AND g.e + 43200000000 GROUP BY 1, 2),
  dp AS (SELECT g.user_id, g.s, max(x.value) AS mx, arg_max(x.us, (x.value, x.us, x.event_id)) AS v FROM seg g JOIN sig x
         ON x.user_id = g.user_id AND x.us BETWEEN g.s AND g.e GROUP BY 1, 2)
  SELECT seg.user_id, seg.s AS raw_start_us, st.v AS start_us, en.v AS end_us, dp.mx AS max_depth, dp.v AS deepest_us
  FROM seg JOIN st USING (user_id, s) JOIN en USING (user_id, s) JOIN dp USING (user_id, s)""")
def r10(spark, d):
    x = islands.dives_with_edges(signals(spark, d), signal_axis(spark, d), "value", "k", 30.0, 3600.0, 43200.0, 6 * 3600.0)
    return x.select("user_id", us("raw_start", "raw_start_us"), us("start_ts", "start_us"), us("end_ts", "end_us"),
                    "max_depth", us("deepest_ts", "deepest_us"))


@query("r11_flat_chunks", f"""WITH {runs_sql('abs(k - 50) < 35')}, m AS (SELECT user_id, isl, median(value) AS md FROM rows_ WHERE p GROUP BY 1, 2)
  SELECT user_id, s AS start_us, n, round(md, 6) AS median_value FROM runs JOIN m USING (user_id, isl) WHERE p AND n >= 3 AND abs(md) < 20""")
def r11(spark, d):
    sig = signals(spark, d).withColumn("slope", F.col("k") - 50)
    x = islands.flat_chunks(sig, signal_axis(spark, d), "value", "slope", 35.0, 3, 20.0)
    return x.select("user_id", us("start_ts", "start_us"), "n", F.round("median_value", 6).alias("median_value"))


@query("r12_restart_states", f"""WITH {runs_sql('value - 505 < -500')}
  SELECT user_id, s AS start_us, e AS end_us, 'state' AS type, 'logger_restart' AS key FROM runs WHERE p""")
def r12(spark, d):
    sig = signals(spark, d).withColumn("pressure", F.col("value") - 505)
    x = islands.restart_states(sig, signal_axis(spark, d), "pressure")
    return x.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "type", "key")


@query("a1_segment_statistics", f"""WITH {runs_sql('value > 30')}
  SELECT user_id, min(us) AS start_us, round(avg(k), 6) AS mean_k, max(k) AS max_k, min(k) AS min_k, sum(k) AS sum_k,
    round(stddev_samp(value), 6) AS std_value, round(avg(abs(value - 50)), 6) AS abs_mean_dev, max(abs(value - 50)) AS abs_max_dev,
    min(abs(value - 50)) AS abs_min_dev, round(sum(abs(value - 50)), 6) AS abs_sum_dev,
    (SELECT k FROM rows_ y WHERE y.user_id = x.user_id AND y.isl = x.isl GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS mode_k
  FROM rows_ x WHERE p GROUP BY user_id, isl""")
def a1(spark, d):
    sig = signals(spark, d).withColumn("dev", F.col("value") - 50)
    x = segments.run_stats(sig, signal_axis(spark, d), F.col("value") > 30, [
        ("mean", "k"), ("max", "k"), ("min", "k"), ("sum", "k"), ("std", "value"), ("abs_mean", "dev"), ("abs_max", "dev"),
        ("abs_min", "dev"), ("abs_sum", "dev"), ("mode", "k")])
    r6 = lambda c: F.round(c, 6).alias(c)
    return x.select("user_id", us("run_start", "start_us"), r6("mean_k"), "max_k", "min_k", "sum_k", r6("std_value"),
                    r6("abs_mean_dev"), "abs_max_dev", "abs_min_dev", r6("abs_sum_dev"), "mode_k")


@query("a1_segment_running_sums", f"""WITH {runs_sql('value > 30')}
  SELECT user_id, event_id, round(sum(value) OVER w, 4) AS cumsum_value FROM rows_ WHERE p
  WINDOW w AS (PARTITION BY user_id, isl ORDER BY ts, event_id)""")
def a1_cumsum(spark, d):
    ax = signal_axis(spark, d)
    rows = label_runs(signals(spark, d), ax, F.col("value") > 30).where("value > 30")
    x = segments.segment_cumsum(rows, ax, ["user_id", "run_start"], ["value"])
    return x.select("user_id", "event_id", F.round("cumsum_value", 4).alias("cumsum_value"))


@query("a2_tortuosity", f"""WITH {runs_sql('value > 20')}, st AS (SELECT *,
    sqrt((value - lag(value) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS step FROM rows_ WHERE p
    WINDOW w AS (PARTITION BY user_id, isl ORDER BY ts, event_id)),
  g AS (SELECT user_id, isl, min(us) AS s, count(*) AS n, sum(step) AS path,
    sqrt((arg_max(value, (us, event_id)) - arg_min(value, (us, event_id))) ** 2
       + (arg_max(k, (us, event_id)) - arg_min(k, (us, event_id))) ** 2) AS line FROM st GROUP BY 1, 2)
  SELECT user_id, s AS start_us, n AS n_points, round(CASE WHEN n >= 2 AND line > 0 THEN path / line END, 6) AS tortuosity FROM g""")
def a2(spark, d):
    ax = signal_axis(spark, d)
    rows = label_runs(signals(spark, d), ax, F.col("value") > 20).where("value > 20")
    x = segments.tortuosity(rows, ax.with_(keys=("user_id", "run_start")), ["user_id", "run_start"], "value", "k")
    return x.select("user_id", us("run_start", "start_us"), "n_points", F.round("tortuosity", 6).alias("tortuosity"))


@query("w14_change_groups", f"""WITH {runs_sql('event_type')} SELECT user_id, event_id, CAST(isl AS BIGINT) AS change_group FROM rows_""")
def w14(spark, d):
    ax = signal_axis(spark, d)
    s = scan(signals(spark, d), ax, prev={"before": "event_type"})
    s = scan(s, ax, run_sum={"change_group": (~F.col("event_type").eqNullSafe(F.col("before"))).cast("bigint")})
    return s.select("user_id", "event_id", "change_group")
