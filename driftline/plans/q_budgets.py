"""Budgets, joins and event-set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, units
from ..operators import budgets, eventset, folds, intervals, islands, joins, project, sampling
from ..schema import add_seconds
from ..sources.tables import load, signal_axis, signals
from .q_intervals import SPANS, spans
from .q_islands import runs_sql, us
from .registry import SIG, query

ORD = "PARTITION BY user_id ORDER BY ts, event_id"
WT = f"""{SIG}, d_ AS (SELECT *, (lead(us) OVER ({ORD}) - us) / 1e6 AS dt FROM sig), md AS (SELECT user_id, median(dt) AS m FROM d_ GROUP BY 1),
  wt AS (SELECT d_.*, coalesce(dt, CASE WHEN m > 0 THEN m ELSE 60 END) AS w FROM d_ JOIN md USING (user_id))"""


def r(c, n=6):
    return F.round(c, n).alias(c)


def weighted(spark, d):
    return budgets.sample_weights(signals(spark, d), signal_axis(spark, d))


@query("a3_sample_weights", f"WITH {WT} SELECT event_id, round(w, 2) AS weight_s FROM wt")
def a3(spark, d):
    return weighted(spark, d).select("event_id", r("weight_s", 2))


@query("a4_daily_budget", f"""WITH {WT} SELECT user_id, strftime(ts, '%Y-%m-%d') AS local_date, event_type AS label, round(sum(w) / 3600, 5) AS duration_h,
  round(sum(w) / 36 / 24, 5) AS pct_of_24h FROM wt GROUP BY 1, 2, 3""")
def a4(spark, d):
    x = budgets.daily_budget(weighted(spark, d), ["user_id"], "ts", "event_type")
    return x.select("user_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), F.col("event_type").alias("label"), r("duration_h", 5), r("pct_of_24h", 5))


@query("a5_hourly_budget", f"""WITH {WT}, h AS (SELECT strftime(ts, '%Y-%m-%d') AS local_date, hour(ts) AS hour_of_day, event_type AS label, sum(w) / 3600 AS d FROM wt GROUP BY 1, 2, 3)
  SELECT local_date, hour_of_day, label, round(d, 5) AS duration_h, round(100 * d / nullif(sum(d) OVER (PARTITION BY local_date, hour_of_day), 0), 5) AS pct_of_observed_hour FROM h""")
def a5(spark, d):
    x = budgets.hourly_budget(weighted(spark, d), [], "ts", "event_type")
    return x.select(F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "hour_of_day", F.col("event_type").alias("label"), r("duration_h", 5), r("pct_of_observed_hour", 5))


STATES = ["click", "error", "purchase"]


@query("a6_daily_pivot", f"WITH {WT} SELECT user_id, strftime(ts, '%Y-%m-%d') AS local_date, " + ", ".join(
    f"round(coalesce(sum(w) FILTER (event_type = '{s}'), 0) / 3600, 5) AS {s}" for s in STATES) + " FROM wt GROUP BY 1, 2")
def a6(spark, d):
    x = budgets.daily_budget(weighted(spark, d), ["user_id"], "ts", "event_type")
    p = budgets.pivot_states(x, ["user_id", "local_date"], "event_type", STATES)
    return p.select("user_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), *[r(s, 5) for s in STATES])


@query("a7_exhaustive_hourly", f"""WITH {runs_sql('event_type')}, p AS (SELECT user_id, p AS label, b, (least(e, b + 3600000000) - greatest(s, b)) / 1e6 AS sec
    FROM runs, generate_series(s // 3600000000 * 3600000000, e, 3600000000) t(b) WHERE e > s AND least(e, b + 3600000000) > greatest(s, b)),
  l AS (SELECT user_id, us // 3600000000 * 3600000000 AS b, avg(k) AS lat FROM sig GROUP BY 1, 2)
  SELECT p.user_id, label, p.b AS hour_us, round(sum(sec) / 36, 5) AS pct_of_hour, round(any_value(lat), 6) AS mean_latitude
  FROM p LEFT JOIN l USING (user_id, b) GROUP BY 1, 2, 3""")
def a7(spark, d):
    from ..core.runs import find_runs
    from ..operators.timebase import bucket
    seg = find_runs(signals(spark, d), signal_axis(spark, d), "event_type").withColumnRenamed("value", "label")
    h = intervals.prorate(seg, "hour").groupBy("user_id", "label", "bucket").agg((F.sum("seconds") / 36).alias("pct_of_hour"))
    l = signals(spark, d).groupBy("user_id", bucket("ts", 3600.0).alias("bucket")).agg(F.avg("k").alias("mean_latitude"))
    return h.join(l, ["user_id", "bucket"], "left").select("user_id", "label", us("bucket", "hour_us"), r("pct_of_hour", 5), r("mean_latitude"))


@query("a8_rollup_levels", f"""WITH b AS (SELECT c_mktsegment AS m, n_name AS dep, r_name AS grp, CAST(c_nationkey % 4 AS VARCHAR) AS ds, o_totalprice AS v
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  d1 AS (SELECT m, ds, dep, grp, avg(v) AS v FROM b GROUP BY 1, 2, 3, 4)
  SELECT m AS label, ds AS dataset, dep AS deployment, grp AS group_name, round(v, 3) AS duration_h, 'deployment' AS comparison_level, dep AS comparison_key FROM d1
  UNION ALL SELECT m, ds, NULL, NULL, round(avg(v), 3), 'dataset', ds FROM d1 GROUP BY m, ds
  UNION ALL SELECT m, NULL, NULL, grp, round(avg(v), 3), 'group', grp FROM d1 GROUP BY m, grp""")
def a8(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    b = load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("label"), F.col("n_name").alias("deployment"), F.col("r_name").alias("group_name"),
        (F.col("c_nationkey") % 4).cast("string").alias("dataset"), F.col("o_totalprice").alias("duration_h"))
    return budgets.rollup_levels(b, ["label"], "deployment", "dataset", "group_name", ["duration_h"]).withColumn("duration_h", F.round("duration_h", 3))


@query("a9_mean_location", f"""WITH {SIG}, f AS (SELECT user_id, max(value) AS fl FROM sig GROUP BY 1)
  SELECT s.user_id, strftime(ts, '%Y-%m-%d') AS local_date, round(coalesce(avg(value) FILTER (k > 50), max(fl)), 6) AS mean_latitude,
    round(coalesce(avg(k) FILTER (k > 50), max(fl)), 6) AS mean_longitude FROM sig s JOIN f USING (user_id) GROUP BY 1, 2""")
def a9(spark, d):
    s = signals(spark, d)
    fb = s.groupBy("user_id").agg(F.max("value").alias("fallback_latitude")).withColumn("fallback_longitude", F.col("fallback_latitude"))
    loc = s.withColumns({"lat": F.when(F.col("k") > 50, F.col("value")), "lon": F.when(F.col("k") > 50, F.col("k"))})
    x = budgets.mean_location(loc, ["user_id"], "ts", "lat", "lon", fb)
    return x.select("user_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), r("mean_latitude"), r("mean_longitude"))


@query("a10_confusion_counts", "SELECT event_type AS method, value > 20 AS flag, count(*) AS n FROM events GROUP BY 1, 2")
def a10(spark, d):
    s = signals(spark, d).select(F.col("event_type").alias("method"), (F.col("value") > 20).alias("flag"))
    return budgets.confusion_counts(s, "method", "flag")


@query("a13_budget_table", f"""WITH {runs_sql('event_type')}, g AS (SELECT p AS label, sum(e - s) / 3.6e9 AS hours, count(*) AS n FROM runs GROUP BY 1)
  SELECT label, round(hours, 4) AS hours, n AS n_segments, round(100 * hours / sum(hours) OVER (), 5) AS pct_of_total,
    row_number() OVER (ORDER BY CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, label) AS position FROM g""")
def a13(spark, d):
    from ..core.runs import find_runs
    from ..schema import seconds_between
    seg = find_runs(signals(spark, d), signal_axis(spark, d), "event_type").withColumn("s", seconds_between("start_ts", "end_ts"))
    x = budgets.budget_table(seg.withColumnRenamed("value", "label"), "label", "s", ["view", "click"])
    return x.select("label", r("hours", 4), "n_segments", r("pct_of_total", 5), "position")


@query("a24_group_day_means", f"""WITH {WT}, dy AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, sum(w) / 3600 AS h FROM wt GROUP BY 1, 2, 3)
  SELECT user_id % 5 AS grp, event_type, round(avg(h), 5) AS mean_h FROM dy GROUP BY 1, 2""")
def a24(spark, d):
    x = budgets.daily_budget(weighted(spark, d), ["user_id"], "ts", "event_type").withColumn("grp", F.col("user_id") % 5)
    return budgets.group_day_means(x, "grp", "event_type").withColumn("mean_h", F.round("mean_h", 5))


@query("a25_state_bins", f"WITH {WT} SELECT user_id, us // 21600000000 * 21600000000 AS bin_us, " + ", ".join(
    f"round(coalesce(sum(w) FILTER (event_type = '{s}'), 0) / 3600, 5) AS {s}" for s in STATES) + " FROM wt GROUP BY 1, 2")
def a25(spark, d):
    x = budgets.state_bins(weighted(spark, d), ["user_id"], "ts", "event_type", STATES, 21600.0)
    return x.select("user_id", us("bin_ts", "bin_us"), *[r(s, 5) for s in STATES])


@query("a25_wrapped_state_bins", f"WITH {WT} SELECT user_id, us // 21600000000 * 21600000000 AS bin_us, strftime(make_timestamp(us) + INTERVAL 3 HOUR, '%Y-%m-%d') AS local_date, (us // 21600000000 * 6 + 3) % 24::DOUBLE AS local_hour, " + ", ".join(
    f"round(coalesce(sum(w) FILTER (event_type = '{s}'), 0) / 3600, 5) AS {s}" for s in STATES) + " FROM wt GROUP BY 1, 2, 3, 4")
def a25w(spark, d):
    """Six-hour bins over days of a zone three hours ahead, whose midnights part them."""
    x = budgets.state_bins(weighted(spark, d), ["user_id"], "ts", "event_type", STATES, 21600.0, wrap_tz="Africa/Nairobi")
    return x.select("user_id", us("bin_ts", "bin_us"), F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "local_hour", *[r(s, 5) for s in STATES])


@query("a22_daily_rest_along_track", f"""WITH {SPANS}, iv AS (SELECT * FROM sp WHERE event_type = 'error'), d_ AS (SELECT *, (lead(us) OVER ({ORD}) - us) / 1e6 AS dt FROM sig),
  md AS (SELECT user_id, median(dt) AS m FROM d_ GROUP BY 1), p AS (SELECT d_.*, coalesce(dt, CASE WHEN m > 0 THEN m ELSE 60 END) AS w,
     EXISTS (SELECT 1 FROM iv WHERE iv.user_id = d_.user_id AND d_.us BETWEEN iv.s AND iv.e) AS resting FROM d_ JOIN md USING (user_id))
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS local_date, round(avg(value), 6) AS lat, round(avg(k), 6) AS lon, round(coalesce(sum(w) FILTER (resting), 0) / 3600, 5) AS rest_h FROM p GROUP BY 1, 2""")
def a22(spark, d):
    ax = signal_axis(spark, d)
    iv = spans(spark, d).where("event_type = 'error'").select("user_id", "start_ts", "end_ts")
    p = islands.membership(weighted(spark, d), iv, ax, "resting", bin_s=86400.0)
    return p.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("local_date")).agg(
        F.round(F.avg("value"), 6).alias("lat"), F.round(F.avg("k"), 6).alias("lon"),
        F.round(F.coalesce(F.sum(F.when(F.col("resting"), F.col("weight_s"))), F.lit(0.0)) / 3600, 5).alias("rest_h"))


@query("a29_event_timing", f"""WITH {SPANS}, m AS (SELECT user_id, event_id, CAST(floor((s + e) / 2) AS BIGINT) AS mid, (e - s) / 3.6e9 AS h FROM sp)
  SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY mid // 86400000000) - 1 AS day_index, round((mid % 86400000000) / 3.6e9, 6) AS decimal_hour, round(h, 6) AS duration_h FROM m""")
def a29(spark, d):
    x = budgets.event_timing(spans(spark, d), ["user_id"], "start_ts", "end_ts")
    return x.select("event_id", "day_index", r("decimal_hour"), r("duration_h"))


# --- joins -------------------------------------------------------------------------------------------

@query("j1_nearest_asof", f"""WITH {SIG}, l AS (SELECT * FROM sig WHERE event_type = 'view'), rr AS (SELECT * FROM sig WHERE event_type = 'click'),
  b AS (SELECT l.*, x.us AS bu, x.value AS bv FROM l ASOF LEFT JOIN rr x ON x.user_id = l.user_id AND x.us <= l.us),
  f AS (SELECT b.*, x.us AS fu, x.value AS fv FROM b ASOF LEFT JOIN rr x ON x.user_id = b.user_id AND x.us >= b.us),
  p AS (SELECT event_id, us, CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bu ELSE fu END AS mu, CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bv ELSE fv END AS mv FROM f)
  SELECT event_id, CASE WHEN abs(mu - us) <= 43200000000 THEN mv END AS near_value, CASE WHEN abs(mu - us) <= 43200000000 THEN round((mu - us) / 1e6, 6) END AS near_dt_s FROM p""")
def j1(spark, d):
    s = signals(spark, d)
    right = s.where("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), "value")
    x = joins.asof(s.where("event_type = 'view'").drop("value"), right, signal_axis(spark, d), "rts", ["value"], 43200.0, prefix="near_")
    return x.select("event_id", "near_value", r("near_dt_s"))


@query("j1_backward_asof_shipments", """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem),
  q AS (SELECT DISTINCT o_custkey % 100 AS sk, o_orderdate AS d FROM orders)
  SELECT l_orderkey, l_linenumber, l_suppkey, max(q.d) IS NOT NULL AS found, date_diff('day', max(q.d), max(l_shipdate)) AS days_since_order
  FROM l LEFT JOIN q ON q.sk = l.l_suppkey AND q.d <= l.l_shipdate GROUP BY l_orderkey, l_linenumber, l_suppkey, l_shipdate""")
def j1b(spark, d):
    from ..core.axis import fit_axis
    li = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    o = load(spark, d, "orders").select((F.col("o_custkey") % 100).alias("l_suppkey"), F.col("o_orderdate").alias("rts")).distinct()
    li = li.groupBy("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate").agg(F.count(F.lit(1)).alias("c"))
    ax = fit_axis(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    x = joins.asof(li, o.withColumn("od", F.col("rts")), ax, "rts", ["od"], direction="backward")
    return x.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("od").isNotNull().alias("found"), F.datediff("l_shipdate", "od").cast("bigint").alias("days_since_order"))


@query("j2_asof_chain", f"""WITH {SIG}, b AS (SELECT l.*, x.us AS u1, x.value AS v1 FROM sig l ASOF LEFT JOIN (SELECT * FROM sig WHERE event_type = 'click') x ON x.user_id = l.user_id AND x.us <= l.us),
  c AS (SELECT b.*, x.us AS u2, x.k AS v2 FROM b ASOF LEFT JOIN (SELECT * FROM sig WHERE event_type = 'error') x ON x.user_id = b.user_id AND x.us <= b.us)
  SELECT event_id, v1 AS c_v1, v2 AS e_v2 FROM c""")
def j2(spark, d):
    s, ax = signals(spark, d), signal_axis(spark, d)
    a = s.where("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), F.col("value").alias("v1"))
    b = s.where("event_type = 'error'").select("user_id", F.col("ts").alias("rts"), F.col("k").alias("v2"))
    x = joins.asof(s, a, ax, "rts", ["v1"], direction="backward", prefix="c_")
    return joins.asof(x, b, ax, "rts", ["v2"], direction="backward", prefix="e_").select("event_id", "c_v1", "e_v2")


@query("j4_greedy_match", f"""WITH RECURSIVE {SIG}, b AS (SELECT user_id, us, side, row_number() OVER (PARTITION BY user_id ORDER BY us, side) AS i FROM (SELECT user_id, us, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side FROM sig WHERE event_type IN ('view', 'click'))),
  f(user_id, i, w, q, hit) AS (SELECT user_id, 0, 0, CAST([] AS BIGINT[]), FALSE FROM b GROUP BY user_id
   UNION ALL SELECT user_id, i, CASE WHEN len(p) > 0 AND w <> side THEN w ELSE side END, CASE WHEN len(p) > 0 AND w <> side THEN p[2:] ELSE list_append(p, us) END, len(p) > 0 AND w <> side
   FROM (SELECT b.user_id, b.i, f.w, b.side, b.us, list_filter(f.q, lambda t: b.us - t <= 21600000000) AS p FROM f JOIN b ON b.user_id = f.user_id AND b.i = f.i + 1)),
  c AS (SELECT b.user_id, count(*) FILTER (hit) AS tp, count(*) FILTER (side = 1) AS nf, count(*) FILTER (side = 0) AS nt FROM b JOIN f USING (user_id, i) GROUP BY 1),
  s AS (SELECT *, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(tp / nullif(nt, 0), 0) AS r FROM c)
  SELECT user_id, tp, nf - tp AS fp, nt - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s""")
def j4(spark, d):
    s = signals(spark, d)
    m = folds.match_in_order(s.where("event_type = 'view'"), s.where("event_type = 'click'"), signal_axis(spark, d), 21600.0)
    return folds.match_scores(m, ["user_id"]).select("user_id", "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


@query("j5_inner_binned", f"""WITH a AS (SELECT user_id, date_trunc('day', ts) AS b, avg(value) AS x FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  c AS (SELECT user_id, date_trunc('day', ts) AS b, avg(value) AS y FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT user_id, epoch_us(b) AS bin_us, round(x, 6) AS x, round(y, 6) AS y FROM a JOIN c USING (user_id, b)""")
def j5(spark, d):
    s = signals(spark, d)
    j = joins.binned_inner(s.where("event_type = 'view'"), s.where("event_type = 'click'"), ["user_id"], 86400.0, {"x": ("ts", "value"), "y": ("ts", "value")})
    return j.select("user_id", us("bin_ts", "bin_us"), r("x"), r("y"))


@query("f11_label_set", "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'error')")
def f11(spark, d):
    from ..operators import filters
    return filters.label_set(signals(spark, d), "event_type", ["view", "error"], False).select("event_id")


@query("p17_location_columns", "SELECT event_id, value AS latitude, user_id FROM events")
def p17(spark, d):
    from ..schema import LOCATION_ALIASES, canonical
    s = signals(spark, d).select("event_id", F.col("value").alias("GPS_Lat"), "user_id")
    return canonical(s, {"latitude": LOCATION_ALIASES["latitude"]}).select("event_id", "latitude", "user_id")


@query("j8_lookup_chain", """SELECT s_suppkey, n_name, r_name, CASE WHEN n_nationkey IS NULL THEN 'no_nation' WHEN r_regionkey IS NULL THEN 'no_region' ELSE 'ok' END AS match_status
  FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey""")
def j8(spark, d):
    n = joins.first_match(load(spark, d, "nation").where("n_nationkey <> 7"), "n_nationkey", ["n_name"])
    rg = joins.first_match(load(spark, d, "region").where("r_regionkey <> 2"), "r_regionkey", ["r_name"])
    return joins.lookup_chain(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
                              [(n, "s_nationkey", "n_nationkey", "no_nation"), (rg, "n_regionkey", "r_regionkey", "no_region")]
                              ).select("s_suppkey", "n_name", "r_name", "match_status")


@query("j9_relations", """WITH o AS (SELECT o_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT o_orderkey, array_to_string(list_transform(ids, lambda i: 'Supplier#' || lpad(CAST(i AS VARCHAR), 9, '0')), '|') AS names FROM o""")
def j9(spark, d):
    o = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"))
    o = o.join(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    x = joins.resolve_relations(o, "o_orderkey", "ids", load(spark, d, "supplier"), "s_suppkey", "s_name", "names")
    return x.select("o_orderkey", F.array_join("names", "|").alias("names"))


@query("j10_overlay_updates", """WITH u AS (SELECT o_custkey AS c, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
  SELECT c_custkey, coalesce(p, c_mktsegment) AS verdict FROM customer LEFT JOIN u ON c = c_custkey""")
def j10(spark, d):
    base = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("verdict"))
    up = load(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("verdict"), "o_orderkey")
    return joins.overlay(base, up, ["c_custkey"], ["o_orderkey"], ["verdict"])


@query("p15_outer_merge", """WITH a AS (SELECT user_id, date_trunc('hour', ts) AS h, min(value) AS x FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  b AS (SELECT user_id, date_trunc('hour', ts) AS h, min(value) AS y FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT user_id, epoch_us(h) AS us, x, y FROM a FULL JOIN b USING (user_id, h)""")
def p15(spark, d):
    s = signals(spark, d).withColumn("h", F.date_trunc("hour", "ts"))
    x = joins.outer_merge([s.where("event_type = 'view'").select("user_id", "h", F.col("value").alias("x")),
                           s.where("event_type = 'click'").select("user_id", "h", F.col("value").alias("y"))], ["user_id", "h"], "x")
    return x.select("user_id", us("h", "us"), "x", "y")


# --- event sets --------------------------------------------------------------------------------------

EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS key, value FROM events)"


def ev(spark, d):
    return signals(spark, d).select("user_id", "ts", F.col("event_type").alias("key"), "value")


@query("e1_state_events_replace", f"""WITH {runs_sql('value > 60')}, n AS (SELECT user_id, s AS us, 'view' AS key, CAST(NULL AS DOUBLE) AS value, (e - s) / 1e6 AS dur FROM runs WHERE p)
  SELECT user_id, us, key, value, NULL AS duration_s FROM (SELECT user_id, us, event_type AS key, value FROM sig) x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = x.user_id AND n.key = x.key)
  UNION ALL SELECT user_id, us, key, value, round(dur, 6) FROM n""")
def e1(spark, d):
    seg = islands.find_segments(signals(spark, d), signal_axis(spark, d), F.col("value") > 60)
    x = eventset.replace_keys(ev(spark, d), eventset.state_events(seg, ["user_id"], "view"), ["user_id", "key"])
    return x.select("user_id", us("ts", "us"), "key", "value", r("duration_s"))


@query("e2_replace_prefix", f"WITH {EV} SELECT user_id, us, key FROM ev WHERE key NOT LIKE 'c%' UNION ALL SELECT user_id, us, 'c_new' FROM ev WHERE key = 'error'")
def e2(spark, d):
    e = ev(spark, d).select("user_id", "ts", "key")
    return eventset.replace_keys(e, e.where("key = 'error'").withColumn("key", F.lit("c_new")), [], prefix="c").select("user_id", us("ts", "us"), "key")


@query("e3_logger_status", f"WITH {EV}, b AS (SELECT user_id, key, min(us) AS a, max(us) AS z FROM ev GROUP BY 1, 2) SELECT user_id, key AS logger, 'logger_start' AS key, a AS us FROM b UNION ALL SELECT user_id, key, 'logger_stop', z FROM b")
def e3(spark, d):
    s = signals(spark, d).withColumnRenamed("event_type", "logger")
    return eventset.logger_status(s, ["user_id"], "logger", "ts").select("user_id", "logger", "key", us("ts", "us"))


@query("e4_apply_edits", f"""WITH {EV} SELECT user_id, us, key FROM ev x WHERE NOT (key = 'view' AND value > 50) UNION ALL SELECT user_id, us + 1000000, 'added' FROM ev WHERE key = 'error'""")
def e4(spark, d):
    e = ev(spark, d)
    gone = e.where("key = 'view' AND value > 50").select("user_id", "key", F.timestamp_micros(F.unix_micros("ts") + 400).alias("ts"))
    new = e.where("key = 'error'").select("user_id", add_seconds("ts", 1.0).alias("ts"), F.lit("added").alias("key"))
    return eventset.apply_edits(e.select("user_id", "ts", "key"), new, gone, ["user_id", "key"]).select("user_id", us("ts", "us"), "key")


@query("e5_auto_and_manual", f"""WITH {EV}, au AS (SELECT user_id, us, 'view' AS key, value * 2 AS value FROM ev WHERE key IN ('view', 'signup'))
  SELECT user_id, us, key, value FROM ev WHERE key NOT IN ('view') UNION ALL SELECT * FROM au WHERE NOT EXISTS (SELECT 1 FROM ev m WHERE m.key = 'signup' AND m.user_id = au.user_id AND m.us = au.us)""")
def e5(spark, d):
    e = ev(spark, d)
    auto = e.where("key IN ('view', 'signup')").withColumns({"key": F.lit("view"), "value": F.col("value") * 2})
    return eventset.merge_auto_manual(e, auto, ["user_id"], ["view"], ["signup"]).select("user_id", us("ts", "us"), "key", "value")


@query("e6_complete_schema", f"WITH {SIG} SELECT event_id, CASE WHEN k > 50 THEN 'state' ELSE 'event' END AS type, us - 19800000000 AS us FROM sig")
def e6(spark, d):
    s = signals(spark, d).select("event_id", "ts", F.col("event_type").alias("key"), F.when(F.col("k") > 50, F.col("k")).alias("duration_s"))
    return eventset.complete_schema(s, "Asia/Kolkata", True).select("event_id", "type", us("ts", "us"))


@query("e7_key_groups", """WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN '2_k5_view' WHEN 'click' THEN 'rf_calm_click' WHEN 'error' THEN 'find_rest.long' WHEN 'signup' THEN 'a.signup' ELSE event_type END AS key FROM events)
  SELECT event_id, CASE key WHEN '2_k5_view' THEN 'k5' WHEN 'rf_calm_click' THEN 'behavior' WHEN 'find_rest.long' THEN 'find_rest' WHEN 'a.signup' THEN 'a' ELSE key END AS parent,
    CASE WHEN key = '2_k5_view' THEN 2 END AS rank FROM k""")
def e7(spark, d):
    t = F.col("event_type")
    k = F.when(t == "view", "2_k5_view").when(t == "click", "rf_calm_click").when(t == "error", "find_rest.long").when(t == "signup", "a.signup").otherwise(t)
    s = signals(spark, d).withColumn("key", k)
    return s.select("event_id", labels.key_parent(F.col("key")).alias("parent"), labels.cluster_rank(F.col("key"))[0].cast("bigint").alias("rank"))


@query("e8_overlay_rows", f"""WITH {SIG} SELECT event_id, 'pre_context' AS overlay FROM sig WHERE k > 30 UNION ALL SELECT event_id, 'kept' FROM sig WHERE value > 20
  UNION ALL SELECT event_id, 'rejected' FROM sig WHERE k > 30 AND NOT value > 20 UNION ALL SELECT event_id, 'focus' FROM sig WHERE k = 77""")
def e8(spark, d):
    s = signals(spark, d).withColumns({"base_keep": F.col("k") > 30, "keep": F.col("value") > 20})
    return eventset.overlay_rows(s, F.col("k") == 77).select("event_id", "overlay")


@query("e9_segment_rows", f"WITH {SIG} SELECT us AS start_us, us + CAST((k - 50) * 1000000 AS BIGINT) AS end_us, event_type AS label FROM sig WHERE k > 50")
def e9(spark, d):
    s = signals(spark, d).select(F.col("ts").alias("window_start"), add_seconds("ts", F.col("k") - 50).alias("END"), F.col("event_type").alias("predicted_label"))
    return eventset.segment_rows(s).select(us("start_ts", "start_us"), us("end_ts", "end_us"), "label")


@query("e10_event_keys", "SELECT DISTINCT event_type AS key FROM events")
def e10(spark, d):
    return eventset.event_keys(ev(spark, d))


@query("e10_prefix_selectors", "SELECT 'u' || (user_id % 10) || '.*' AS selector, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def e10p(spark, d):
    s = signals(spark, d).select(F.concat_ws(".", F.concat(F.lit("u"), F.col("user_id") % 10), "event_type").alias("key"))
    return eventset.prefix_selectors(s)


@query("e11_wildcards", "SELECT DISTINCT event_type AS key FROM events WHERE event_type LIKE 'c%' OR event_type LIKE '%up'")
def e11(spark, d):
    return eventset.expand_wildcards(ev(spark, d), ["c*", "*up"])


@query("e12_publish_report", f"WITH {EV} SELECT user_id, count(*) FILTER (key = 'view') AS removed, count(*) FILTER (key = 'error') AS added FROM ev GROUP BY 1 HAVING count(*) FILTER (key IN ('view', 'error')) > 0")
def e12(spark, d):
    e = ev(spark, d)
    _, rep = eventset.publish(e, e.where("key = 'error'").withColumn("key", F.lit("view")), ["view"], ["user_id"])
    return rep


@query("e13_sparse_signal", f"WITH {SPANS} SELECT event_id, CAST(floor((s + e) / 2) AS BIGINT) AS us, CASE WHEN value > 30 THEN value END AS metric FROM sp WHERE value > 30")
def e13(spark, d):
    s = spans(spark, d).withColumn("metric", F.when(F.col("value") > 30, F.col("value")))
    return eventset.sparse_signal(s, ["event_id"], ["metric"]).select("event_id", us("ts", "us"), "metric")


# --- projection and units ----------------------------------------------------------------------------

@query("p1_rename_channels", "SELECT l_orderkey AS deployment, l_quantity AS depth, l_extendedprice AS depth__pressure, l_discount AS depth__dup1 FROM lineitem")
def p1(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("Deployment"), F.col("l_quantity").alias("Depth [m]"),
                                           F.col("l_extendedprice").alias("Press (bar)"), F.col("l_discount").alias("DEPTH"))
    return project.rename_channels(li, {"Depth": ("depth", None), "press": ("depth", "pressure")})


@query("p2_signal_stats", f"""WITH {SIG} SELECT user_id, 'motion' AS signal, 'value' AS channel, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value FROM sig GROUP BY 1
  UNION ALL SELECT user_id, 'stroke', 'k', count(k), min(k), max(k), round(avg(k), 6) FROM sig GROUP BY 1""")
def p2(spark, d):
    long = project.split_signals(signals(spark, d), ["user_id"], "ts", {"value": "motion", "k": "stroke", "event_type": "label"})
    x = project.signal_stats(long, ["user_id"], "ts")
    return x.select("user_id", "signal", "channel", "n", "min_value", "max_value", r("mean_value"))


@query("p3_acceleration_units", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN value ELSE value * 9.80665 END, 8) AS value, 'm/s^2' AS unit FROM events")
def p3(spark, d):
    s = signals(spark, d).withColumn("unit", F.when(F.col("event_type") == "view", "m/s2").otherwise("G"))
    x = project.standardize_acceleration(project.standardize_acceleration(s, ["value"], "unit"), ["value"], "unit")
    return x.select("event_id", r("value", 8), "unit")


@query("p4_rate_units", "SELECT event_id, round(CASE event_type WHEN 'view' THEN value * 12 WHEN 'click' THEN value * 60 ELSE value END, 6) AS rate, CASE WHEN event_type IN ('view', 'click') THEN 'spm' ELSE 'm' END AS unit FROM events")
def p4(spark, d):
    t = F.col("event_type")
    s = signals(spark, d).select("event_id", F.col("value").alias("rate"), F.when(t == "view", "count/5 s").when(t == "click", "Hz").otherwise("m").alias("unit"))
    return project.standardize_rate(s, "rate", "unit").select("event_id", r("rate"), "unit")


@query("p5_clean_archival", f"WITH {SIG} SELECT event_id, -value AS depth, CASE WHEN value * 1000 > 60000 AND k > 2 THEN 0 ELSE k END AS velocity FROM sig")
def p5(spark, d):
    s = signals(spark, d).select("event_id", F.col("value").alias("depth"), F.col("k").alias("velocity"), (F.col("value") * 1000).alias("light"))
    return project.clean_archival(s, "depth", "velocity", "light").select("event_id", "depth", "velocity")


@query("p6_calibrate_angle", f"WITH {SIG}, m AS (SELECT user_id, max(abs(value)) > 110 AS raw FROM sig GROUP BY 1) SELECT event_id, round(CASE WHEN raw THEN value * 0.5 - 10 ELSE value END, 6) AS pitch FROM sig JOIN m USING (user_id)")
def p6(spark, d):
    s = signals(spark, d).withColumnRenamed("value", "pitch")
    return project.calibrate_angle(s, ["user_id"], "pitch", 110.0, 0.5, -10.0).select("event_id", r("pitch"))


@query("p7_unit_conversions", """SELECT event_id, round(CASE event_type WHEN 'view' THEN value * 100 WHEN 'click' THEN value * 2000 * pi() WHEN 'error' THEN value * 180 / pi() WHEN 'signup' THEN value * 10 ELSE value / 100 END, 5) AS value FROM events""")
def p7(spark, d):
    t = F.col("event_type")
    u = F.when(t == "view", "Gauss").when(t == "click", "rps").when(t == "error", "radians").when(t == "signup", "bar").otherwise("cm")
    g = F.when(t == "view", "uT").when(t == "click", "mrad/s").when(t == "error", "deg").otherwise("m")
    return signals(spark, d).select("event_id", F.round(units.convert(F.col("value"), u, g), 5).alias("value"))


@query("p10_rate_groups", """SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 100.0::DOUBLE ELSE 250.0::DOUBLE END AS rate_hz, string_agg(DISTINCT CASE event_type WHEN 'view' THEN 'eeg' WHEN 'click' THEN 'emg' ELSE 'ecg' END, '|' ORDER BY CASE event_type WHEN 'view' THEN 'eeg' WHEN 'click' THEN 'emg' ELSE 'ecg' END) AS signals FROM events GROUP BY 1, 2""")
def p10(spark, d):
    t = F.col("event_type")
    s = signals(spark, d).select("user_id", F.when(t == "view", "eeg").when(t == "click", "emg").otherwise("ecg").alias("signal"), F.lit(500.0).alias("fs"))
    return project.group_by_rate(s, ["user_id"], "signal", "fs").select("user_id", "rate_hz", F.array_join("signals", "|").alias("signals"))


@query("p10_frames_by_rate", """WITH s AS (SELECT user_id, epoch_us(ts) AS us, event_type, value FROM events),
  v AS (SELECT user_id, us, min(value) AS view FROM s WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT user_id, us // 1000000 * 1000000 AS us, avg(value) AS click FROM s WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT user_id, us, round(view, 6) AS view, round(click, 6) AS click FROM v FULL JOIN c USING (user_id, us)""")
def p10f(spark, d):
    """Two channels that land on 1 Hz, one of them from 1.5 Hz, become one frame."""
    s = signals(spark, d)
    one = lambda t: s.where(F.col("event_type") == t).withColumnRenamed("value", t)
    x = project.frames_by_rate({"view": one("view"), "click": one("click")}, {"view": 1.0, "click": 1.5}, signal_axis(spark, d))
    return x[1].select("user_id", F.unix_micros("ts").alias("us"), F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query("s14_older_run_outputs", """WITH s AS (SELECT event_id, ts, value, CASE user_id % 5 WHEN 0 THEN 'long_flat' WHEN 1 THEN 'long_drift' WHEN 2 THEN 'surface_sleep' WHEN 3 THEN 'not_sleep' END AS c FROM events)
  SELECT event_id, epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) // 2 AS mid_us, CAST(floor(value * 1000) AS BIGINT) / 1e6 AS duration_s, value > 20 AS base_keep_filtered,
    CASE c WHEN 'long_flat' THEN 'putative_rest.benthic_sleep' WHEN 'long_drift' THEN 'putative_rest.drift_sleep' WHEN 'surface_sleep' THEN 'putative_rest.surface_sleep' WHEN 'not_sleep' THEN 'find_rest.not_sleep'
      ELSE 'putative_rest.unfiltered' END AS state_name, CASE c WHEN 'not_sleep' THEN 'find_rest' ELSE 'putative_rest' END AS group_label FROM s""")
def s14(spark, d):
    """Segments as older versions wrote them."""
    from ..sources.sinks import standard_segments
    k = F.col("user_id") % 5
    old = signals(spark, d).select("event_id", F.col("ts").alias("start_datetime"), F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1000)).alias("end_datetime"), (F.col("value") > 20).alias("context_keep"),
                                   F.when(k == 0, "long_flat").when(k == 1, "long_drift").when(k == 2, "surface_sleep").when(k == 3, "not_sleep").alias("nominal_class"), F.lit(" ").alias("unused"))
    return standard_segments(old).select("event_id", F.unix_micros("segment_midpoint_ts").alias("mid_us"), "duration_s", "base_keep_filtered", "state_name", "group_label")


@query("p11_p13_names", "SELECT event_id, event_type || CASE WHEN user_id % 2 = 0 THEN '_2' ELSE '' END AS name FROM events WHERE event_type <> 'error'")
def p11(spark, d):
    s = project.drop_intermediate(signals(spark, d), ["error"], "event_type")
    lg = F.when(F.col("user_id") % 2 == 0, "Derived-A").otherwise("Tag-B")
    return s.select("event_id", project.recomputed_name(F.col("event_type"), lg).alias("name"))


@query("p12_attach_metadata", """WITH m AS (SELECT n_name AS key, n_nationkey AS position, CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE 'label ' || n_nationkey END AS label FROM nation)
  SELECT s_suppkey, trim(coalesce(nullif(trim(a.label), ''), nullif(trim(b.label), ''))) AS label FROM supplier LEFT JOIN m a ON a.key = 'NATION_' || s_nationkey LEFT JOIN m b ON b.key = 'NATION_' || (s_nationkey + 1)""")
def p12(spark, d):
    n = load(spark, d, "nation")
    meta = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("position"),
                    F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.concat(F.lit("label "), "n_nationkey")).alias("label"))
    s = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), "s_nationkey").alias("a"), F.concat(F.lit("NATION_"), F.col("s_nationkey") + 1).alias("b"))
    return project.attach_metadata(s, "a", "b", meta, ["label"]).select("s_suppkey", "label")


@query("l1_stable_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey) - 1 AS position FROM orders")
def l1(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return sampling.sort_positions(o, ["s"], "o_orderkey").select("o_orderkey", "position")


@query("l5_top_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest([event_type, 'u' || (user_id % 7)]) AS reason FROM events) GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
def l5(spark, d):
    s = signals(spark, d).select(F.concat_ws("|", "event_type", F.concat(F.lit("u"), F.col("user_id") % 7)).alias("why"))
    return sampling.top_reasons(s, "why", 8)


@query("scalar_text_and_time", """SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) AS slug_raw, strftime(make_timestamp(CAST(round(o_totalprice % 24 * 60) % 1440 AS BIGINT) * 60000000), '%H:%M') AS hhmm,
  strftime(o_orderdate, '%Y-%m-%d') AS file_date FROM orders""")
def scalars(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.lower(F.regexp_replace("o_orderpriority", " ", "_")).alias("slug_raw"), labels.hh_mm(F.col("o_totalprice") % 24).alias("hhmm"),
                    F.date_format(labels.filename_date(F.concat(F.lit("acc_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv"))), "yyyy-MM-dd").alias("file_date"))


@query("p8_unit_tokens", "SELECT event_id, CASE event_type WHEN 'view' THEN 'm' WHEN 'click' THEN 's' WHEN 'error' THEN '' WHEN 'signup' THEN 'm/s^2' ELSE 'lux' END AS unit FROM events")
def p8(spark, d):
    t = F.col("event_type")
    raw = F.when(t == "view", " Metres ").when(t == "click", "sec").when(t == "error", "N/A").when(t == "signup", "M / s2").otherwise("Lux")
    return signals(spark, d).select("event_id", units.unit_token(raw).alias("unit"))


@query("p9_decimation_step", "SELECT event_id, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 2 ELSE 1 END AS step FROM events")
def p9(spark, d):
    t = F.col("event_type")
    sig = F.when(t == "view", "EEG").when(t == "click", "ecg").otherwise("depth")
    return signals(spark, d).select("event_id", project.decimation_step(sig, F.lit(500.0)).cast("bigint").alias("step"))


@query("e5_manual_edit_counts", "SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_manual, count(*) FILTER (event_type = 'view') AS n_auto FROM events GROUP BY 1")
def e5c(spark, d):
    return eventset.edit_counts(ev(spark, d), ["user_id"], ["view"], ["signup"])
