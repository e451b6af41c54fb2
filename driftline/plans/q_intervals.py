"""Interval algebra on segments of the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, islands
from ..schema import add_seconds
from ..sources.tables import signal_axis, signals
from .q_islands import runs_sql, us
from .registry import SIG, query

H6 = 6 * 3600.0
DAY = 86400.0


def parents(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 20)
    return s.select("user_id", F.concat_ws(":", "user_id", F.unix_micros("start_ts")).alias("parent_id"),
                    F.col("start_ts").alias("p_start"), F.col("end_ts").alias("p_end"))


def children(spark, d):
    s = islands.find_runs(signals(spark, d), signal_axis(spark, d), F.when(F.col("k") > 60, "high").when(F.col("k") > 30, "mid").otherwise("low"),
                          {"mk": ("max", "k")})
    return s.select("user_id", F.col("value").alias("child_class"), F.col("start_ts").alias("c_start"),
                    F.col("end_ts").alias("c_end"), F.col("mk").alias("score"))


PC = f"""{runs_sql('value > 20')}, par AS (SELECT user_id, user_id || ':' || s AS parent_id, s AS ps, e AS pe FROM runs WHERE p),
  cl AS (SELECT *, CASE WHEN k > 60 THEN 'high' WHEN k > 30 THEN 'mid' ELSE 'low' END AS c FROM sig),
  cm AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND c = lag(c) OVER w THEN 0 ELSE 1 END AS cc FROM cl WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  cn AS (SELECT *, sum(cc) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ci FROM cm),
  chi AS (SELECT user_id, c, min(us) AS cs, max(us) AS ce, max(k) AS mk FROM cn GROUP BY user_id, ci, c)"""


@query("i1_clip_children", f"""WITH {PC} SELECT par.user_id, parent_id, c AS child_class, greatest(cs, ps) AS start_us, least(ce, pe) AS end_us
  FROM par JOIN chi ON par.user_id = chi.user_id AND ce > ps AND cs < pe WHERE NOT (cs < ps AND ce > pe)""")
def i1(spark, d):
    x = intervals.clip_children(parents(spark, d), children(spark, d), ["user_id"], H6)
    return x.select("user_id", "parent_id", "child_class", us("start_ts", "start_us"), us("end_ts", "end_us"))


@query("i1_clip_counts", f"""WITH {PC} SELECT count(CASE WHEN NOT (cs < ps AND ce > pe) THEN 1 END) AS kept,
  count(CASE WHEN cs < ps AND ce <= pe THEN 1 END) AS start_adjusted, count(CASE WHEN ce > pe AND cs >= ps THEN 1 END) AS end_adjusted,
  count(CASE WHEN cs < ps AND ce > pe THEN 1 END) AS dropped_both_sides
  FROM par JOIN chi ON par.user_id = chi.user_id AND ce > ps AND cs < pe""")
def i1c(spark, d):
    return intervals.clip_children_counts(parents(spark, d), children(spark, d), ["user_id"], H6)


@query("i2_children_per_parent", f"""WITH {PC}, j AS (SELECT parent_id, c, (ce - cs) / 1e6 AS dur, mk FROM par JOIN chi
    ON par.user_id = chi.user_id AND cs >= ps AND ce <= pe)
  SELECT par.parent_id, """ + ", ".join(
    f"""count(CASE WHEN c = '{x}' THEN 1 END) AS {x}_n, round(coalesce(sum(CASE WHEN c = '{x}' THEN dur END), 0), 3) AS {x}_total_s,
    round(coalesce(100 * sum(CASE WHEN c = '{x}' THEN dur END) / nullif((max(pe) - max(ps)) / 1e6, 0), 0), 6) AS {x}_pct,
    round(coalesce(avg(CASE WHEN c = '{x}' THEN mk END), 0), 6) AS {x}_mean""" for x in ("low", "high")) + """
  FROM par LEFT JOIN j USING (parent_id) GROUP BY par.parent_id""")
def i2(spark, d):
    x = intervals.children_per_parent(parents(spark, d), children(spark, d), ["user_id"], ["low", "high"], H6, "score")
    r = lambda c, n: F.round(c, n).alias(c)
    return x.select("parent_id", *[e for c in ("low", "high") for e in
                                   (f"{c}_n", r(f"{c}_total_s", 3), r(f"{c}_pct", 6), r(f"{c}_mean", 6))])


# each event opens a span of k hours
SPANS = f"{SIG}, sp AS (SELECT user_id, event_id, event_type, us AS s, us + CAST(k * 3600000000 AS BIGINT) AS e, value FROM sig)"
MERGED = """mb AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
  mg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS g FROM mb),
  mm AS (SELECT user_id, g, min(s) AS s, max(e) AS e, count(*) AS n FROM mg GROUP BY 1, 2)"""


def spans(spark, d):
    return signals(spark, d).select("user_id", "event_id", "event_type", "value", F.col("ts").alias("start_ts"),
                                    add_seconds("ts", F.col("k") * 3600).alias("end_ts"))


def span_axis(spark, d):
    return signal_axis(spark, d).with_(order=("start_ts", "event_id"))


@query("i3_merge_near_spans", f"WITH {SPANS}, {MERGED} SELECT user_id, s AS start_us, e AS end_us, n AS n_merged FROM mm")
def i3(spark, d):
    m = intervals.merge_near(spans(spark, d), span_axis(spark, d), gap_s=7200.0)
    return m.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "n_merged")


WIN0, WIN1 = "TIMESTAMP '2024-01-10 06:00:00'", "TIMESTAMP '2024-01-20 18:00:00'"


@query("i4_clip_to_window", f"""WITH {SPANS}, {MERGED} SELECT user_id, greatest(s, epoch_us({WIN0})) AS start_us, least(e, epoch_us({WIN1})) AS end_us
  FROM mm WHERE e > epoch_us({WIN0}) AND s < epoch_us({WIN1})""")
def i4(spark, d):
    m = intervals.merge_near(spans(spark, d), span_axis(spark, d), gap_s=7200.0)
    m = intervals.clip_to_window(m, F.expr(WIN0), F.expr(WIN1))
    return m.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"))


@query("i5_resolve_end", f"""WITH {SIG} SELECT event_id, CAST(CASE WHEN k - 20 > 0 THEN us + round((k - 20) * 60e6)
    WHEN event_type = 'view' THEN us + 30000000 WHEN event_type = 'click' THEN us + 5000000 END AS BIGINT) AS end_us FROM sig
  WHERE event_type <> 'click' UNION ALL
  SELECT event_id, CASE WHEN k > 20 THEN us + CAST((k - 20) * 60000000 AS BIGINT) ELSE us + 5000000 END FROM sig WHERE event_type = 'click'""")
def i5(spark, d):
    s = signals(spark, d).withColumns({"dur": (F.col("k") - 20) * 60, "end_ts": F.when(
        F.col("event_type") == "view", add_seconds("ts", 30.0)).when(F.col("event_type") == "click", add_seconds("ts", 5.0))})
    return s.select("event_id", F.unix_micros(intervals.resolve_end("ts", ["dur"], ["end_ts"])).alias("end_us"))


@query("i6_complement", f"""WITH {SPANS}, {MERGED}, bd AS (SELECT user_id, epoch_us(TIMESTAMP '2023-12-31') AS lo, epoch_us(TIMESTAMP '2024-02-10') AS hi FROM sig GROUP BY 1),
  q AS (SELECT user_id, coalesce(lag(e) OVER w, lo) AS a, s AS b FROM mm JOIN bd USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY s)
   UNION ALL SELECT user_id, max(e), max(hi) FROM mm JOIN bd USING (user_id) GROUP BY 1)
  SELECT user_id, a AS start_us, b AS end_us FROM q WHERE b > a""")
def i6(spark, d):
    ax = span_axis(spark, d)
    m = intervals.merge_near(spans(spark, d), ax, gap_s=7200.0)
    b = signals(spark, d).groupBy("user_id").agg(F.expr("first(TIMESTAMP '2023-12-31') lo"), F.expr("first(TIMESTAMP '2024-02-10') hi"))
    x = intervals.complement(m, ax.with_(order=("start_ts",)), b)
    return x.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"))


def two_methods(spark, d):
    p = parents(spark, d)
    c = children(spark, d).where("child_class = 'high'").select("user_id", "c_start", "c_end")
    return p, c


@query("i7_overlap_flags", f"""WITH {PC}, o AS (SELECT parent_id, max(least(ce, pe) - greatest(cs, ps)) / 1e6 AS ov FROM par JOIN chi
    ON par.user_id = chi.user_id AND ce > ps AND cs < pe AND c = 'high' GROUP BY 1)
  SELECT parent_id, round(coalesce(ov, 0), 6) AS overlap_s, CASE WHEN coalesce(ov, 0) > 0 THEN 'true_positive' ELSE 'false_positive' END AS flag
  FROM par LEFT JOIN o USING (parent_id)""")
def i7(spark, d):
    p, c = two_methods(spark, d)
    x = intervals.max_overlap(p, c, ["user_id"], "parent_id", ("p_start", "p_end"), ("c_start", "c_end"), H6)
    return x.select("parent_id", F.round("overlap_s", 6).alias("overlap_s"),
                    F.when(F.col("overlap_s") > 0, "true_positive").otherwise("false_positive").alias("flag"))


@query("i8_prorate_hours", f"""WITH {runs_sql('value > 20')} SELECT user_id, s AS start_us, b AS hour_us,
    round((least(e, b + 3600000000) - greatest(s, b)) / 1e6, 6) AS seconds
  FROM runs, generate_series(s // 3600000000 * 3600000000, e, 3600000000) t(b)
  WHERE p AND e > s AND least(e, b + 3600000000) > greatest(s, b)""")
def i8(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 20)
    x = intervals.prorate(s, "hour")
    return x.select("user_id", us("start_ts", "start_us"), us("bucket", "hour_us"), F.round("seconds", 6).alias("seconds"))


@query("i9_days_local_zone", f"""WITH {runs_sql('value > 20')},
  l AS (SELECT user_id, s, e, (make_timestamp(s) AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS ls FROM runs WHERE p AND e > s),
  g AS (SELECT user_id, s, e, epoch_us(b) - 19800000000 AS b0, b FROM l, generate_series(date_trunc('day', ls), ls + to_microseconds(e - s), INTERVAL 1 DAY) t(b))
  SELECT user_id, s AS start_us, strftime(b, '%Y-%m-%d') AS local_date,
    round((least(e, b0 + 86400000000) - greatest(s, b0)) / 1e6, 6) AS seconds FROM g WHERE least(e, b0 + 86400000000) > greatest(s, b0)""")
def i9(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 20)
    x = intervals.prorate(s, "day", "Asia/Kolkata")
    return x.select("user_id", us("start_ts", "start_us"), F.date_format("bucket", "yyyy-MM-dd").alias("local_date"),
                    F.round("seconds", 6).alias("seconds"))


@query("i10_days_scaled", f"""WITH {runs_sql('value > 20', ', sum(k) AS eff')}
  SELECT user_id, s AS start_us, strftime(make_timestamp(b), '%Y-%m-%d') AS local_date,
    round((least(e, b + 86400000000) - greatest(s, b)) / 1e6 * eff / ((e - s) / 1e6), 6) AS seconds
  FROM runs, generate_series(s // 86400000000 * 86400000000, e, 86400000000) t(b)
  WHERE p AND e > s AND least(e, b + 86400000000) > greatest(s, b)""")
def i10(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 20, aggs={"eff": ("sum", "k")})
    x = intervals.prorate_scaled(s, "eff")
    return x.select("user_id", us("start_ts", "start_us"), F.date_format("bucket", "yyyy-MM-dd").alias("local_date"),
                    F.round("seconds", 6).alias("seconds"))


@query("i11_paint_samples", f"""WITH {SPANS}, iv AS (SELECT * FROM sp WHERE event_type IN ('view', 'error')),
  h AS (SELECT x.event_id, arg_max(iv.event_type, (iv.s, iv.event_id)) AS lab FROM sig x JOIN iv ON iv.user_id = x.user_id
        AND x.us BETWEEN iv.s AND iv.e GROUP BY 1)
  SELECT x.event_id, coalesce(lab, CASE WHEN value < 5 THEN 'surfacing' ELSE 'diving' END) AS state_label FROM sig x LEFT JOIN h USING (event_id)""")
def i11(spark, d):
    iv = spans(spark, d).where(F.col("event_type").isin("view", "error")).select(
        "user_id", "start_ts", "end_ts", F.col("event_type").alias("label"), F.col("event_id").alias("rank"))
    x = intervals.paint(signals(spark, d), iv, signal_axis(spark, d), "start_ts", "end_ts", "label", "rank",
                        F.when(F.col("value") < 5, "surfacing").otherwise("diving"), bin_s=DAY)
    return x.select("event_id", "state_label")


@query("i12_centred_window", f"""WITH {runs_sql('value > 30')} SELECT user_id, s AS start_us, CAST(floor((s + e) / 2) AS BIGINT) - 900000000 AS lo_us,
  CAST(floor((s + e) / 2) AS BIGINT) + 900000000 AS hi_us FROM runs WHERE p""")
def i12(spark, d):
    s = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 30)
    lo, hi = intervals.centred_window("start_ts", "end_ts", 1800.0)
    return s.select("user_id", us("start_ts", "start_us"), F.unix_micros(lo).alias("lo_us"), F.unix_micros(hi).alias("hi_us"))


@query("j11_segment_channel_stat", f"""WITH {PC}, a AS (SELECT parent_id, avg(k) AS m, min(k) AS lo, max(k) AS hi, count(*) AS n FROM par JOIN sig
    ON sig.user_id = par.user_id AND us BETWEEN ps AND pe GROUP BY 1)
  SELECT parent_id, round(m, 6) AS seg_mean, lo AS seg_min, hi AS seg_max, coalesce(n, 0) AS seg_n FROM par LEFT JOIN a USING (parent_id)""")
def j11(spark, d):
    x = intervals.segment_signal_stats(signals(spark, d), parents(spark, d), ["user_id"], "parent_id", "ts", ("p_start", "p_end"), "k", H6)
    return x.select("parent_id", F.round("seg_mean", 6).alias("seg_mean"), "seg_min", "seg_max", "seg_n")
