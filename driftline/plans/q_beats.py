"""Peak and beat chains, features and learning on the events signal and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, learn, peaks, sampling
from ..schema import add_seconds
from ..sources.tables import load, signal_axis, signals
from .q_intervals import SPANS, spans
from .q_islands import us
from .registry import SIG, query

ORD = "PARTITION BY user_id ORDER BY ts, event_id"
BEAT = f"{SIG}, bt AS (SELECT * FROM sig WHERE event_type <> 'error')"
RATE = f"""{BEAT}, r1 AS (SELECT *, lag(us) OVER ({ORD}) AS pus, lead(us) OVER ({ORD}) AS nus FROM bt), r2 AS (SELECT *, 60 / ((us - pus) / 1e6) AS hr FROM r1),
  r3 AS (SELECT *, lag(hr) OVER ({ORD}) AS phr FROM r2), r4 AS (SELECT *, (hr - phr) / phr AS fc FROM r3)"""


def r(c, n=6):
    return F.round(c, n).alias(c)


def beats(spark, d):
    return signals(spark, d).where("event_type <> 'error'")


def peaks_sql(height: float, distance: int, column: str = "value") -> str:
    return f"""WITH RECURSIVE {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) AS i, lag({column}) OVER ({ORD}) AS pv, lead({column}) OVER ({ORD}) AS nv FROM sig),
  run AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> {column} THEN 1 ELSE 0 END) OVER ({ORD}) AS g FROM i_),
  pl AS (SELECT user_id, g, any_value({column}) AS v, min(i) AS a, max(i) AS b FROM run GROUP BY 1, 2),
  nb AS (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM pl WINDOW w AS (PARTITION BY user_id ORDER BY g)),
  pk AS (SELECT user_id, v, (a + b) // 2 AS i, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, (a + b) // 2 DESC) AS rk FROM nb WHERE lv < v AND rv < v AND v >= {height}),
  f(user_id, rk, kept) AS (SELECT user_id, 0, CAST([] AS BIGINT[]) FROM pk GROUP BY user_id
   UNION ALL SELECT f.user_id, f.rk + 1, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - pk.i) < {distance})) = 0 THEN list_append(f.kept, pk.i) ELSE f.kept END
   FROM f JOIN pk ON pk.user_id = f.user_id AND pk.rk = f.rk + 1),
  last AS (SELECT user_id, arg_max(kept, rk) AS kept FROM f GROUP BY 1), k_ AS (SELECT user_id, unnest(kept) AS i FROM last)
  SELECT event_id FROM k_ JOIN i_ USING (user_id, i)"""


@query("h1_select_peaks", peaks_sql(10, 4))
def h1(spark, d):
    return peaks.select_peaks(signals(spark, d), signal_axis(spark, d), "value", 10.0, 4).select("event_id")


@query("h1_detect_beats")
def h1b(spark, d):
    p, _ = peaks.detect_beats(signals(spark, d), signal_axis(spark, d), "value", 1.0, (0.05, 0.45), (0.1, 0.4), 50.0, 3.0, 12.0, 0.2, 2.0, 0.05)
    return p.select("event_id", r("smoothed", 5), r("normalized", 5))


@query("h1_pooled_peaks", f"SELECT event_id FROM ({peaks_sql(10, 4)}) UNION SELECT event_id FROM ({peaks_sql(10, 4, 'k')})")
def h1p(spark, d):
    return peaks.pooled_peaks(signals(spark, d), signal_axis(spark, d), ["value", "k"], 10.0, 4).select("event_id")


@query("h2_refine_peaks", f"""WITH {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) AS i FROM sig), p AS (SELECT user_id, i FROM i_ WHERE k > 90),
  b AS (SELECT p.user_id, p.i, arg_max(x.event_id, (x.value, -x.i)) AS best FROM p JOIN i_ x ON x.user_id = p.user_id AND abs(x.i - p.i) <= 3 GROUP BY 1, 2)
  SELECT DISTINCT best AS event_id FROM b""")
def h2(spark, d):
    s = signals(spark, d)
    return peaks.refine_peaks(s.where("k > 90"), s, signal_axis(spark, d), "value", 3).select("event_id")


@query("h4_accept_by_height", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 60 THEN 'beat_auto_detect_accepted' ELSE 'beat_auto_detect_rejected' END AS key FROM events")
def h4(spark, d):
    return peaks.accept_by_height(signals(spark, d), "value", 10.0, 60.0).select("event_id", "key")


@query("h5_rate_signal", f"""WITH {RATE}, b AS (SELECT *, 60 / nullif((nus - us) / 1e6, 0) AS rate FROM r1), c AS (SELECT *, coalesce(rate, last_value(rate IGNORE NULLS) OVER ({ORD})) AS rt FROM b)
  SELECT s.event_id, round(c.rt / 2 * 1e4, 6) AS rate FROM sig s ASOF LEFT JOIN c ON c.user_id = s.user_id AND c.us <= s.us""")
def h5(spark, d):
    x = peaks.rate_signal(signals(spark, d), beats(spark, d), signal_axis(spark, d), halve=True)
    return x.select("event_id", F.round(F.col("rate") * 1e4, 6).alias("rate"))


@query("h6_rate_jumps", f"WITH {RATE} SELECT event_id, round(fc, 6) AS frac_change, CASE WHEN fc > 0 THEN 'up' ELSE 'down' END AS direction FROM r4 WHERE abs(fc) > 0.8")
def h6(spark, d):
    return peaks.rate_jumps(beats(spark, d), signal_axis(spark, d), 0.8).select("event_id", r("frac_change"), "direction")


@query("h7_suggest_beats", f"""WITH {RATE}, dj AS (SELECT user_id, pus AS a, us AS b FROM r4 WHERE abs(fc) > 0.8 AND fc < 0),
  c AS (SELECT dj.user_id, a, b, arg_max(x.us, (x.value, -x.us)) AS u, max(x.value) AS v, count(*) AS n FROM dj JOIN sig x ON x.user_id = dj.user_id AND x.us >= a AND x.us < b GROUP BY 1, 2, 3)
  SELECT user_id, u AS us, v AS value FROM c WHERE n >= 2 AND v >= 20""")
def h7(spark, d):
    ax = signal_axis(spark, d)
    j = peaks.rate_jumps(beats(spark, d), ax, 0.8)
    return peaks.suggest_beats(j, signals(spark, d), ax, "value", 20.0, 2, 86400.0).select("user_id", us("ts", "us"), "value")


@query("h8_conflict_pairs", f"""WITH {BEAT}, p AS (SELECT user_id, event_id, us, lead(us) OVER ({ORD}) AS nus FROM bt), q AS (SELECT *, (nus - us) / 1e6 AS rr, CAST(floor((us + nus) / 2) AS BIGINT) AS mid FROM p WHERE nus IS NOT NULL),
  m AS (SELECT *, median(rr) OVER (PARTITION BY user_id ORDER BY mid RANGE BETWEEN 129600000000 PRECEDING AND 129600000000 FOLLOWING) AS ref FROM q)
  SELECT event_id FROM m WHERE rr < 0.3 * ref""")
def h8(spark, d):
    return peaks.conflict_pairs(beats(spark, d), signal_axis(spark, d), 0.3, 259200.0).select("event_id")


UPJ = f"""{RATE}, uj AS (SELECT *, coalesce(lead(fc) OVER ({ORD}) > 0.8, FALSE) AS rej FROM r4),
  st AS (SELECT *, last_value(CASE WHEN NOT rej THEN us END IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_us FROM uj)"""


@query("h9_up_jump_rejections", f"WITH {UPJ} SELECT event_id FROM st WHERE rej")
def h9(spark, d):
    rej, _ = peaks.up_jump_rejections(beats(spark, d), signal_axis(spark, d), 0.8, 3600.0)
    return rej.select("event_id")


@query("h9_repair_gaps", f"WITH {UPJ} SELECT user_id, before_us AS start_us, nus AS end_us FROM st WHERE rej AND before_us IS NOT NULL AND (nus - before_us) / 1e6 < 7200")
def h9g(spark, d):
    _, gaps = peaks.up_jump_rejections(beats(spark, d), signal_axis(spark, d), 0.8, 7200.0)
    return gaps.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"))


@query("h10_strict_rate", f"""WITH {BEAT}, p AS (SELECT user_id, us, lead(us) OVER ({ORD}) AS nus FROM bt), q AS (SELECT user_id, us, CASE WHEN (nus - us) / 1e6 >= 3600 THEN least(greatest(60 / ((nus - us) / 1e6), 0.001), 0.01) END AS rt FROM p),
  s AS (SELECT x.*, q.rt FROM sig x ASOF LEFT JOIN q ON q.user_id = x.user_id AND q.us <= x.us),
  g AS (SELECT s.*, EXISTS (SELECT 1 FROM sig e WHERE e.event_type = 'error' AND e.value > 50 AND e.user_id = s.user_id AND s.us >= e.us AND s.us < e.us + 14400000000) AS gap FROM s),
  n AS (SELECT *, CASE WHEN NOT gap THEN rt END AS rn FROM g)
  SELECT event_id, round(rn * 1e4, 5) AS rate_nan FROM n""")
def h10(spark, d):
    ax, s = signal_axis(spark, d), signals(spark, d)
    sp = s.where("event_type = 'error' AND value > 50").select("user_id", F.col("ts").alias("start_ts"), add_seconds("ts", 14400.0).alias("end_ts"))
    x = peaks.strict_rate(s, beats(spark, d), ax, sp, sp.where("day(start_ts) < 10"), 3600.0, 0.001, 0.01, 43200.0)
    return x.select("event_id", F.round(F.col("rate_nan") * 1e4, 5).alias("rate_nan"))


@query("h10_strict_rate_fixed", f"""WITH {BEAT}, p AS (SELECT user_id, us, lead(us) OVER ({ORD}) AS nus FROM bt), q AS (SELECT user_id, us, CASE WHEN (nus - us) / 1e6 >= 3600 THEN least(greatest(60 / ((nus - us) / 1e6), 0.001), 0.01) END AS rt FROM p),
  s AS (SELECT x.*, q.rt FROM sig x ASOF LEFT JOIN q ON q.user_id = x.user_id AND q.us <= x.us),
  g AS (SELECT s.*, EXISTS (SELECT 1 FROM sig e WHERE e.event_type = 'error' AND e.value > 50 AND e.user_id = s.user_id AND s.us >= e.us AND s.us < e.us + 14400000000) AS gap,
    EXISTS (SELECT 1 FROM sig e WHERE e.event_type = 'error' AND e.value > 50 AND day(e.ts) < 10 AND e.user_id = s.user_id AND s.us >= e.us AND s.us < e.us + 14400000000) AS bad FROM s),
  n AS (SELECT *, CASE WHEN NOT gap THEN rt END AS rn FROM g),
  z AS (SELECT *, last_value(CASE WHEN rn IS NOT NULL THEN us END IGNORE NULLS) OVER a AS bu, last_value(rn IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN rn IS NOT NULL THEN us END IGNORE NULLS) OVER b AS fu, first_value(rn IGNORE NULLS) OVER b AS fv FROM n
     WINDOW a AS ({ORD} ROWS UNBOUNDED PRECEDING), b AS ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, CASE WHEN NOT bad THEN round(1e4 * least(greatest(coalesce(rn, bv + (fv - bv) * CASE WHEN fu > bu THEN (us - bu) / (fu - bu) ELSE 0 END, bv, fv), 0.001), 0.01), 5) END AS rate_fixed FROM z""")
def h10f(spark, d):
    ax, s = signal_axis(spark, d), signals(spark, d)
    sp = s.where("event_type = 'error' AND value > 50").select("user_id", F.col("ts").alias("start_ts"), add_seconds("ts", 14400.0).alias("end_ts"))
    x = peaks.strict_rate(s, beats(spark, d), ax, sp, sp.where("day(start_ts) < 10"), 3600.0, 0.001, 0.01, 43200.0)
    return x.select("event_id", F.round(F.col("rate_fixed") * 1e4, 5).alias("rate_fixed"))


@query("h1_h10_beat_chain")
def beat_chain(spark, d):
    """The whole chain: band-pass, smoothing, local z-score, peaks, then the strict rate on every sample."""
    ax, s = signal_axis(spark, d), signals(spark, d)
    found, _ = peaks.detect_beats(s, ax, "value", 1.0, (0.05, 0.45), (0.1, 0.4), 50.0, 3.0, 12.0, 0.2, 2.0, 0.05)
    sp = s.where("event_type = 'error' AND value > 50").select("user_id", F.col("ts").alias("start_ts"), add_seconds("ts", 14400.0).alias("end_ts"))
    x = peaks.strict_rate(s, found, ax, sp, sp.where("day(start_ts) < 10"), 3600.0, 0.001, 0.01, 43200.0)
    return x.select("event_id", F.round(F.col("rate_nan") * 1e4, 5).alias("rate_nan"), F.round(F.col("rate_fixed") * 1e4, 5).alias("rate_fixed"))


@query("h11_snap_labels", f"""WITH {SIG}, sm AS (SELECT * FROM sig WHERE event_type = 'view'), lb AS (SELECT user_id, us FROM sig WHERE event_type = 'click'),
  b AS (SELECT lb.*, x.us AS bu FROM lb ASOF LEFT JOIN sm x ON x.user_id = lb.user_id AND x.us <= lb.us), f AS (SELECT b.*, x.us AS fu FROM b ASOF LEFT JOIN sm x ON x.user_id = b.user_id AND x.us >= b.us),
  p AS (SELECT user_id, us, CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bu ELSE fu END AS m FROM f)
  SELECT DISTINCT user_id, m AS us FROM p WHERE abs(m - us) <= 21600000000""")
def h11(spark, d):
    s = signals(spark, d)
    x = peaks.snap_to_samples(s.where("event_type = 'click'").select("user_id", "ts", "event_id"), s.where("event_type = 'view'"), signal_axis(spark, d), 21600.0, [])
    return x.select("user_id", us("sample_ts", "us"))


@query("h12_quality_states", f"""WITH {SPANS}, un AS (SELECT * FROM sp WHERE event_type = 'error' AND e > s), mb AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM un),
  mg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM mb), mm AS (SELECT user_id, min(s) AS s, max(e) AS e FROM mg GROUP BY user_id, g),
  bd AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM sig GROUP BY 1),
  q AS (SELECT user_id, coalesce(lag(e) OVER w, lo) AS a, s AS b FROM mm JOIN bd USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY s) UNION ALL
    SELECT bd.user_id, coalesce(max(e), any_value(lo)), any_value(hi) FROM bd LEFT JOIN mm USING (user_id) GROUP BY 1)
  SELECT user_id, s AS start_us, e AS end_us, 'QC_unusable_ecg' AS key FROM mm UNION ALL SELECT user_id, a, b, 'QC_usable_ecg' FROM q WHERE b > a""")
def h12(spark, d):
    u = spans(spark, d).where("event_type = 'error'").select("user_id", "start_ts", "end_ts")
    x = peaks.quality_states(u, signals(spark, d), signal_axis(spark, d))
    return x.select("user_id", us("start_ts", "start_us"), us("end_ts", "end_us"), "key")


@query("h13_chunk_parameters", f"""WITH {SIG}, b AS (SELECT user_id, min(us) AS lo FROM sig GROUP BY 1) SELECT event_id, CASE WHEN ((us - lo) // 432000000000) % 2 = 1 THEN 9.0::DOUBLE ELSE 2.0::DOUBLE END AS peak_height,
  0.5::DOUBLE AS distance FROM sig JOIN b USING (user_id)""")
def h13(spark, d):
    from ..operators.timebase import grid
    s = signals(spark, d)
    b = s.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    g = grid(b, ["user_id"], "lo", "hi", 432_000_000_000, "chunk_start").join(b, "user_id")
    i = F.floor((F.unix_micros("chunk_start") - F.unix_micros("lo")) / 432_000_000_000)
    g = g.select("user_id", "chunk_start", add_seconds("chunk_start", 432000.0).alias("chunk_end"),
                 F.when(i % 2 == 1, F.create_map(F.lit("peak_height"), F.lit("9"))).alias("params_override"))
    x = peaks.with_chunk_parameters(s, g, signal_axis(spark, d), {"peak_height": 2.0, "distance": 0.5}, 86400.0)
    return x.select("event_id", "peak_height", "distance")


BY_CHUNK = f"""WITH RECURSIVE {SIG}, b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM sig GROUP BY 1),
  ch AS (SELECT user_id, i, lo + i * 432000000000 AS s, CASE WHEN i % 2 = 1 THEN 9 ELSE 2 END AS h, CASE WHEN i % 3 = 2 THEN 5 ELSE 2 END AS d FROM b, LATERAL (SELECT unnest(range(0, (hi - lo) // 432000000000 + 1)) AS i) WHERE i % 7 <> 3),
  x AS (SELECT sig.*, ch.i AS c, ch.s, h, d FROM sig JOIN ch ON ch.user_id = sig.user_id AND us >= s AND us <= s + 432000000000),
  i_ AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS pv, lead(value) OVER w AS nv, row_number() OVER (PARTITION BY user_id ORDER BY c, us, event_id) - 1 AS gi FROM x WINDOW w AS (PARTITION BY user_id, c ORDER BY us, event_id)),
  run AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> value THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, c ORDER BY i) AS g FROM i_),
  pl AS (SELECT user_id, c, g, any_value(value) AS v, min(i) AS a, max(i) AS b, any_value(h) AS h, any_value(d) AS d FROM run GROUP BY 1, 2, 3),
  nb AS (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM pl WINDOW w AS (PARTITION BY user_id, c ORDER BY g)),
  pk AS (SELECT user_id, c, d, (a + b) // 2 AS i, row_number() OVER (PARTITION BY user_id, c ORDER BY v DESC, (a + b) // 2 DESC) AS rk FROM nb WHERE lv < v AND rv < v AND v >= h),
  f(user_id, c, rk, kept) AS (SELECT user_id, c, 0, CAST([] AS BIGINT[]) FROM pk GROUP BY user_id, c
   UNION ALL SELECT f.user_id, f.c, f.rk + 1, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - pk.i) < pk.d)) = 0 THEN list_append(f.kept, pk.i) ELSE f.kept END
   FROM f JOIN pk ON pk.user_id = f.user_id AND pk.c = f.c AND pk.rk = f.rk + 1),
  last AS (SELECT user_id, c, arg_max(kept, rk) AS kept FROM f GROUP BY 1, 2), k_ AS (SELECT user_id, c, unnest(kept) AS i FROM last)
  SELECT event_id, s AS start_us, gi AS refined_index, CASE WHEN value BETWEEN 0 AND 60 THEN 'beat_auto_detect_accepted' ELSE 'beat_auto_detect_rejected' END AS key FROM k_ JOIN i_ USING (user_id, c, i)"""
BARE = {"height": 2.0, "distance_s": 2.0, "max_height": 60.0, **{f"enable_{x}": 0.0 for x in ("bandpass", "spike_removal", "absolute", "smoothing", "normalization")}}


def override_grid(spark, d):
    """Five-day chunks; every other one asks for higher peaks, every third for wider distances, every seventh is a gap."""
    from ..operators.timebase import grid
    b = signals(spark, d).groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    g = grid(b, ["user_id"], "lo", "hi", 432_000_000_000, "chunk_start").join(b, "user_id")
    i = F.floor((F.unix_micros("chunk_start") - F.unix_micros("lo")) / 432_000_000_000)
    maps = F.map_concat(F.when(i % 2 == 1, F.create_map(F.lit("height"), F.lit("9"))).otherwise(F.create_map(F.lit("noted"), F.lit("x"))),
                        F.when(i % 3 == 2, F.create_map(F.lit("distance_s"), F.lit("5.0"))).otherwise(F.create_map(F.lit("distance_s"), F.lit(None).cast("string"))))
    return g.select("user_id", "chunk_start", add_seconds("chunk_start", 432000.0).alias("chunk_end"), F.when(i % 7 == 3, "gap").otherwise("pending").alias("status"), maps.alias("params_override"))


@query("h13_detect_by_chunk", BY_CHUNK)
def h13d(spark, d):
    x = peaks.detect_beats_by_chunk(signals(spark, d), signal_axis(spark, d), "value", 1.0, override_grid(spark, d), BARE, 86400.0)
    return x.select("event_id", us("chunk_start", "start_us"), "refined_index", "key")


@query("h14_candidate_features", f"""WITH {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i FROM sig), c AS (SELECT * FROM i_ WHERE k > 80),
  w AS (SELECT c.event_id, any_value(c.value) AS v, avg(x.value) AS m, stddev_pop(x.value) AS sd, min(x.value) FILTER (x.i <= c.i) AS lt, min(x.value) FILTER (x.i >= c.i) AS rt
    FROM c JOIN i_ x ON x.user_id = c.user_id AND x.i BETWEEN c.i - 4 AND c.i + 4 GROUP BY 1),
  n AS (SELECT event_id, (us - lag(us) OVER ({ORD})) / 1e6 AS pr, (lead(us) OVER ({ORD}) - us) / 1e6 AS nr FROM c),
  z AS (SELECT c.event_id, x.value - w.m AS dv, x.i FROM c JOIN w USING (event_id) JOIN i_ x ON x.user_id = c.user_id AND x.i BETWEEN c.i - 4 AND c.i + 4),
  zl AS (SELECT event_id, dv, lag(dv) OVER (PARTITION BY event_id ORDER BY i) AS pd FROM z),
  ac AS (SELECT event_id, avg(dv * pd) / nullif(avg(dv * dv), 0) AS q, count(*) AS cnt, sum(dv * pd) AS sp, sum(dv * dv) AS sq, count(CASE WHEN dv * pd < 0 THEN 1 END) AS zc, avg(abs(dv - pd)) AS mad FROM zl GROUP BY 1)
  SELECT event_id, round(m, 6) AS value_mean, round(sd, 5) AS value_std, round(v - greatest(lt, rt), 6) AS prominence, round(pr, 6) AS rr_prev_s, round(nr, 6) AS rr_next_s,
    round((sp / (cnt - 1)) / (sq / cnt), 5) AS value_ac1, round(zc / (cnt - 1), 6) AS value_zero_cross_rate, round(mad, 5) AS value_mean_abs_diff FROM w JOIN n USING (event_id) JOIN ac USING (event_id)""")
def h14(spark, d):
    s = signals(spark, d)
    x = peaks.candidate_features(s.where("k > 80"), s, signal_axis(spark, d), ["value"], "value", 4)
    return x.select("event_id", r("value_mean"), r("value_std", 5), r("prominence"), r("rr_prev_s"), r("rr_next_s"), r("value_ac1", 5), r("value_zero_cross_rate"), r("value_mean_abs_diff", 5))


@query("h15_label_candidates", f"""WITH {SIG}, c AS (SELECT * FROM sig WHERE event_type = 'view'), ev AS (SELECT user_id, us, value > 20 AS pos FROM sig WHERE event_type = 'click'),
  b AS (SELECT c.*, x.us AS bu, x.pos AS bp FROM c ASOF LEFT JOIN ev x ON x.user_id = c.user_id AND x.us <= c.us), f AS (SELECT b.*, x.us AS fu, x.pos AS fp FROM b ASOF LEFT JOIN ev x ON x.user_id = b.user_id AND x.us >= b.us),
  p AS (SELECT event_id, us, CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bu ELSE fu END AS mu, CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bp ELSE fp END AS mp FROM f)
  SELECT event_id, CASE WHEN abs(mu - us) <= 21600000000 AND mp THEN 1 ELSE 0 END AS label FROM p""")
def h15(spark, d):
    s = signals(spark, d)
    e = s.where("event_type = 'click'").select("user_id", "ts", (F.col("value") > 20).alias("positive"))
    x = peaks.label_candidates(s.where("event_type = 'view'"), e, signal_axis(spark, d), 21600.0)
    return x.select("event_id", F.col("label").cast("bigint").alias("label"))


def training_sql(manual_only: bool) -> str:
    near = lambda src: f"""(SELECT p.event_id, CASE WHEN p.fu IS NULL OR p.us - p.bu <= p.fu - p.us THEN p.bu ELSE p.fu END AS mu, CASE WHEN p.fu IS NULL OR p.us - p.bu <= p.fu - p.us THEN p.bk ELSE p.fk END AS mk, p.us FROM
    (SELECT b.*, x.us AS fu, x.key AS fk FROM (SELECT c.*, x.us AS bu, x.key AS bk FROM c ASOF LEFT JOIN {src} x ON x.user_id = c.user_id AND x.us <= c.us) b ASOF LEFT JOIN {src} x ON x.user_id = b.user_id AND x.us >= b.us) p)"""
    return f"""WITH {SIG}, c AS (SELECT event_id, user_id, us, k FROM sig WHERE event_type = 'view'),
  ev AS (SELECT user_id, us, CASE WHEN value > 30 THEN 'ok' WHEN value > 15 THEN 'acc' ELSE 'rej' END AS key FROM sig WHERE event_type = 'click'), mn AS (SELECT * FROM ev WHERE key = 'ok'),
  sp AS (SELECT user_id, min(us) AS a, max(us) AS b FROM mn GROUP BY 1), n AS {near('mn' if manual_only else 'ev')}, m AS {near('mn')}
  SELECT c.event_id, CASE WHEN abs(n.mu - c.us) <= 21600000000 THEN CASE WHEN n.mk = 'rej' THEN 0 ELSE 1 END ELSE {'0' if manual_only else 'CASE WHEN k > 50 THEN 1 ELSE 0 END'} END AS label,
    CASE WHEN abs(n.mu - c.us) <= 21600000000 THEN 'event' ELSE '{'manual_only' if manual_only else 'detector'}' END AS label_source, coalesce(abs(m.mu - c.us) <= 21600000000, FALSE) AS manual_positive,
    coalesce(c.us BETWEEN a AND b, FALSE) AS in_training_span FROM c JOIN n USING (event_id) JOIN m USING (event_id) LEFT JOIN sp ON sp.user_id = c.user_id"""


def _training(spark, d, manual_only):
    s, v = signals(spark, d), F.col("value")
    e = s.where("event_type = 'click'").select("user_id", "ts", F.when(v > 30, peaks.MANUAL_OK).when(v > 15, peaks.ACCEPTED).otherwise(peaks.REJECTED).alias("key"))
    c = s.where("event_type = 'view'").withColumn("key", F.when(F.col("k") > 50, peaks.ACCEPTED).otherwise(peaks.REJECTED))
    x = peaks.training_labels(c, e, signal_axis(spark, d), tolerance_s=21600.0, manual_only=manual_only)
    return x.select("event_id", F.col("label").cast("bigint").alias("label"), "label_source", "manual_positive", "in_training_span")


@query("h15_training_labels", training_sql(False))
def h15t(spark, d):
    return _training(spark, d, False)


@query("h15_manual_only_labels", training_sql(True))
def h15m(spark, d):
    return _training(spark, d, True)


SCORED = f"{SIG}, sc AS (SELECT event_id, user_id, ts, us, k / 100 AS p, CASE WHEN value > 20 THEN 1 ELSE 0 END AS y FROM sig)"


def scored(spark, d):
    return signals(spark, d).select("event_id", "user_id", "ts", (F.col("k") / 100).alias("p"), (F.col("value") > 20).cast("int").alias("y"))


@query("h16_threshold_sweep", f"""WITH {SCORED}, t AS (SELECT i, 0.05 + i * 0.01 AS t FROM generate_series(0, 90) g(i)),
  c AS (SELECT i, count(CASE WHEN y = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 THEN 1 END) AS fp, (SELECT sum(y) FROM sc) AS pos FROM t JOIN sc ON round(p * 100) >= 5 + i GROUP BY 1)
  SELECT round(0.05 + i * 0.01, 4) AS threshold, round(CASE WHEN tp = 0 THEN 0 ELSE 5 * (tp / (tp + fp)) * (tp / pos) / (4 * (tp / (tp + fp)) + tp / pos) END, 6) AS fbeta FROM c""")
def h16(spark, d):
    x = peaks.threshold_sweep(scored(spark, d), "y", "p")
    return x.select(r("threshold", 4), r("fbeta"))


@query("h17_hash_downsample", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (y = 0) AS maj, count(*) FILTER (y <> 0) AS mino FROM sc)
  SELECT event_id, y FROM sc, c WHERE y <> 0 OR CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(1, mino * 0.25::DOUBLE / maj)""")
def h17(spark, d):
    return sampling.hash_downsample(scored(spark, d), "y", 0, 0.25, "event_id").select("event_id", "y")


@query("h18_tail_pseudo_labels", f"""WITH {SCORED}, q AS (SELECT user_id, quantile_cont(p, 0.2) AS lo, quantile_cont(p, 0.8) AS hi FROM sc GROUP BY 1)
  SELECT event_id, CASE WHEN p >= hi THEN 1 WHEN p <= lo THEN 0 END AS pseudo_label FROM sc JOIN q USING (user_id)""")
def h18(spark, d):
    x = peaks.tail_pseudo_labels(scored(spark, d), ["user_id"], "p")
    return x.select("event_id", F.col("pseudo_label").cast("bigint").alias("pseudo_label"))


@query("h19_smoothness_penalty", f"""WITH {SCORED}, n AS (SELECT *, (us - lag(us) OVER w) / 36e8 AS a, (lead(us) OVER w - us) / 36e8 AS b FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  h AS (SELECT *, CASE WHEN a > 0 THEN 60 / a END AS ph, CASE WHEN b > 0 THEN 60 / b END AS nh FROM n)
  SELECT event_id, round(least(greatest(p * exp(-0.5 * (coalesce(greatest(abs(nh - ph) / greatest(abs(ph), 1e-9) - 0.8, 0), 0)
    + (coalesce(greatest(0.1 - ph, 0) + greatest(ph - 240, 0), 0) + coalesce(greatest(0.1 - nh, 0) + greatest(nh - 240, 0), 0)) / 240)), 0), 1), 6) AS penalized FROM h""")
def h19(spark, d):
    from ..core.scan import scan
    from ..schema import seconds_between
    s = scan(scored(spark, d), signal_axis(spark, d), prev={"__p": "ts"}, nxt={"__n": "ts"})
    s = s.withColumns({"rr_prev_s": seconds_between("__p", "ts") / 3600, "rr_next_s": seconds_between("ts", "__n") / 3600})
    return peaks.smoothness_penalty(s, "p", 0.5).select("event_id", r("penalized"))


@query("h20_probability_signal")
def h20(spark, d):
    s = scored(spark, d)
    b = s.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    _, c = peaks.probability_signal(s, b, signal_axis(spark, d), "p", 86400.0, 14400.0)
    return c.select("event_id", r("prob_local", 5))


@query("h22_precision_recall", f"""WITH {SCORED}, c AS (SELECT user_id, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM sc GROUP BY 1)
  SELECT user_id, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def h22(spark, d):
    x = peaks.precision_recall(scored(spark, d), ["user_id"], F.col("y") == 1, F.col("p") >= 0.5)
    return x.select("user_id", "tp", "fp", "fn", r("f1"))


@query("h23_dense_peaks", peaks_sql(0, 2))
def h23(spark, d):
    return peaks.select_peaks(signals(spark, d), signal_axis(spark, d), "value", 0.0, 2).select("event_id")


@query("h24_down_jump_insertions", f"""WITH {RATE}, dj AS (SELECT user_id, pus AS a, us AS b FROM r4 WHERE abs(fc) > 0.8 AND fc < 0), cd AS (SELECT * FROM sig WHERE event_type = 'error' AND k >= 30 AND value >= 5),
  c AS (SELECT dj.user_id, a, b, arg_max(cd.event_id, (cd.k, cd.value, -cd.us)) AS event_id FROM dj JOIN cd ON cd.user_id = dj.user_id AND cd.us BETWEEN a AND b GROUP BY 1, 2, 3) SELECT DISTINCT event_id FROM c""")
def h24(spark, d):
    s = signals(spark, d)
    x = peaks.down_jump_insertions(beats(spark, d), s, signal_axis(spark, d), 0.8, "k", "value", 30.0, 5.0, 86400.0)
    return x.select("event_id")


CLEANUP = f"""WITH RECURSIVE {BEAT}, p AS (SELECT 0 AS n, user_id, event_id, us, k FROM bt UNION ALL
    SELECT n + 1, user_id, event_id, us, k FROM (SELECT *, bool_or(bad) OVER () AS any_bad FROM (
      SELECT *, rr IS NOT NULL AND cnt >= 3 AND med > 0 AND rr < med * 0.75 AS bad FROM (
        SELECT *, median(rr) OVER (PARTITION BY user_id) AS med, count(*) OVER (PARTITION BY user_id) AS cnt FROM (
          SELECT *, (lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us) / 1e6 AS rr FROM p)))) WHERE any_bad AND NOT bad),
  jb AS (SELECT user_id, event_id, us / 1e6 AS t, k, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS cnt
         FROM p WHERE n = (SELECT max(n) FROM p)),
  js AS (SELECT user_id, i, CAST(NULL AS DOUBLE) AS t2, t AS t1, k AS p1, event_id AS id1, CAST(NULL AS BIGINT) AS dropped FROM jb WHERE i = 1 UNION ALL
    SELECT user_id, i, CASE WHEN bad THEN t2 ELSE t1 END, CASE WHEN bad AND NOT p1 <= k THEN t1 ELSE t END, CASE WHEN bad AND NOT p1 <= k THEN p1 ELSE k END,
           CASE WHEN bad AND NOT p1 <= k THEN id1 ELSE event_id END, CASE WHEN bad THEN CASE WHEN p1 <= k THEN id1 ELSE event_id END END FROM (
      SELECT b.user_id, b.i, b.t, b.k, b.event_id, s.t1, s.t2, s.p1, s.id1,
             b.cnt >= 4 AND s.t2 IS NOT NULL AND b.t - s.t1 > 0 AND s.t1 - s.t2 > 0 AND s.t1 - s.t2 > (b.t - s.t1) * 1.8 AS bad
      FROM js s JOIN jb b ON b.user_id = s.user_id AND b.i = s.i + 1))
  SELECT event_id FROM jb WHERE event_id NOT IN (SELECT dropped FROM js WHERE dropped IS NOT NULL)"""


@query("h25_model_cleanup", CLEANUP)
def h25(spark, d):
    return peaks.model_cleanup(beats(spark, d), signal_axis(spark, d), "k").select("event_id")


@query("h26_fused_windows", """WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
  m AS (SELECT *, list_avg(a) AS ma, list_avg(b) AS mb, list_stddev_pop(a) AS sa, list_stddev_pop(b) AS sb FROM e)
  SELECT vec_id, round(((a[1] - ma) / sa + (b[1] - mb) / sb) / 2, 5) AS first_value, 40 AS width FROM m""")
def h26(spark, d):
    e = load(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    e = e.withColumns({"a": F.slice("v", 1, 32), "b": F.slice("v", 33, 32)})
    x = peaks.fused_windows(e, ["a", "b"], 40)
    return x.select("vec_id", F.round(F.get("fused", F.lit(0)), 5).alias("first_value"), F.size("fused").cast("bigint").alias("width"))


@query("h28_rate_from_candidates", f"""WITH {RATE}, b AS (SELECT user_id, us, max(hr) AS rate FROM r2 WHERE us > pus GROUP BY 1, 2),
  pr AS (SELECT s.user_id, s.us, b.us AS bu, b.rate AS br FROM (SELECT DISTINCT user_id, us FROM sig) s ASOF LEFT JOIN b ON b.user_id = s.user_id AND b.us <= s.us),
  nx AS (SELECT pr.*, b.us AS fu, b.rate AS fr FROM pr ASOF LEFT JOIN b ON b.user_id = pr.user_id AND b.us >= pr.us)
  SELECT user_id, us, round(1e4 * CASE WHEN bu IS NULL THEN fr WHEN fu IS NULL OR fu = bu THEN br ELSE br + (fr - br) * (us - bu) / (fu - bu) END, 5) AS rate FROM nx""")
def h28(spark, d):
    x = peaks.rate_from_candidates(signals(spark, d), beats(spark, d), signal_axis(spark, d))
    return x.select("user_id", us("ts", "us"), F.round(F.col("rate") * 1e4, 5).alias("rate"))


@query("h29_model_verdicts", f"WITH {SCORED} SELECT event_id, CASE WHEN p >= 0.7 THEN 'beat_ml_accepted' WHEN p >= 0.4 THEN 'beat_ml_suggested' ELSE 'beat_ml_rejected' END AS key FROM sc")
def h29(spark, d):
    from ..operators.eventset import model_verdict_events
    return model_verdict_events(scored(spark, d), ["event_id"], "p", 0.7, 0.4).select("event_id", "key")


@query("h29_verdicts_replaced", f"""WITH {SCORED}, ev AS (SELECT user_id, us, CASE event_type WHEN 'view' THEN 'beat_ml_accepted' WHEN 'click' THEN 'beat_ml_rejected' ELSE 'note' END AS key FROM sig WHERE user_id % 3 <> 1),
  nw AS (SELECT user_id, us, CASE WHEN p >= 0.7 THEN 'beat_ml_accepted' WHEN p >= 0.4 THEN 'beat_ml_suggested' ELSE 'beat_ml_rejected' END AS key FROM sc WHERE user_id % 2 = 0),
  al AS (SELECT * FROM ev WHERE NOT (starts_with(key, 'beat_ml_') AND user_id IN (SELECT user_id FROM nw)) UNION ALL SELECT * FROM nw)
  SELECT user_id, us, replace(key, 'beat_ml_', '') AS verdict, count(*) AS n FROM al WHERE starts_with(key, 'beat_ml_') GROUP BY 1, 2, 3""")
def h29r(spark, d):
    """A second model run over some entities replaces their verdicts and leaves all else; then events are read back as beats."""
    from ..operators.eventset import replace_verdicts, verdict_beats
    s, t = scored(spark, d), F.col("event_type")
    old = signals(spark, d).where("user_id % 3 <> 1").select("user_id", "ts", F.when(t == "view", "beat_ml_accepted").when(t == "click", "beat_ml_rejected").otherwise("note").alias("key"),
                                                             F.lit("point").alias("type"), F.lit(0.5).alias("value"))
    x = verdict_beats(replace_verdicts(old, s.where("user_id % 2 = 0"), ["user_id"], "p", 0.7, 0.4))
    return x.groupBy("user_id", us("ts", "us"), "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("h31_suggest_parameters", f"""WITH {RATE}, q AS (SELECT user_id, (us - pus) / 1e6 AS rr FROM r1) SELECT user_id, round(median(rr) * 0.5, 4) AS peak_distance_s, round(least(500, 78 / min(rr)), 6) AS max_bpm FROM q WHERE rr > 0 GROUP BY 1""")
def h31(spark, d):
    b = peaks.rate_preview(beats(spark, d), signal_axis(spark, d))
    return peaks.suggest_parameters(b, ["user_id"], "rr_s").select("user_id", r("peak_distance_s", 4), r("max_bpm"))


@query("h32_rate_preview", f"WITH {RATE} SELECT event_id, round(hr * 1e4, 6) AS rate FROM r2 WHERE us > pus")
def h32(spark, d):
    return peaks.rate_preview(beats(spark, d), signal_axis(spark, d)).select("event_id", F.round(F.col("rate") * 1e4, 6).alias("rate"))


# --- features ----------------------------------------------------------------------------------------

@query("x1_sliding_epochs", f"""WITH {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i FROM sig), n AS (SELECT user_id, max(i) AS mx FROM i_ GROUP BY 1), f AS (SELECT user_id, unnest(generate_series(0, (mx - 15) // 8)) AS fr FROM n WHERE mx >= 15)
  SELECT f.user_id, fr AS frame, min(us) AS start_us, round(sum(value), 5) AS total FROM f JOIN i_ ON i_.user_id = f.user_id AND i BETWEEN fr * 8 AND fr * 8 + 15 GROUP BY 1, 2""")
def x1(spark, d):
    e = features.epochs(signals(spark, d), signal_axis(spark, d), "value", 1.0, 16.0, 8.0)
    return e.select("user_id", "frame", us("frame_start", "start_us"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("x2_describe_windows", f"""WITH {SIG}, w AS (SELECT *, us // 432000000000 * 432000000000 AS b, value - 20 AS v FROM sig), d1 AS (SELECT *, CASE WHEN lag(b) OVER w_ = b THEN v - lag(v) OVER w_ END AS d, lag(v) OVER w_ AS pv, lag(b) OVER w_ AS pb FROM w WINDOW w_ AS ({ORD})),
  d2 AS (SELECT *, CASE WHEN pb = b THEN d - lag(d) OVER ({ORD}) END AS dd FROM d1)
  SELECT user_id, b AS window_us, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
    count(CASE WHEN d IS NOT NULL AND (v < 0) <> (pv < 0) THEN 1 END) AS zero_crossings, round(sqrt(var_pop(d) / nullif(var_pop(v), 0)), 5) AS hjorth_mobility FROM d2 GROUP BY 1, 2""")
def x2(spark, d):
    s = signals(spark, d).withColumn("v", F.col("value") - 20)
    x = features.describe_windows(s, signal_axis(spark, d), "v", 432000.0)
    return x.select("user_id", us("window_start", "window_us"), "n", r("mean"), r("std"), r("iqr"), "zero_crossings", r("hjorth_mobility", 5))


@query("x3_hrv_features")
def x3(spark, d):
    e = features.epochs(signals(spark, d), signal_axis(spark, d), "value", 1.0, 32.0, 8.0)
    f = features.hrv_ratios(features.epoch_features(e, 1.0, [(0.03, 0.1, "vlf"), (0.1, 0.2, "lf"), (0.2, 0.45, "hf")], 16.0))
    return f.select("user_id", "frame", r("lf_hf", 5), r("p_total", 4), r("hmob", 5), r("perm", 5))


@query("x4_embedding_epoch_features")
def x4(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    f = features.eeg_ratios(features.epoch_features(e, 64.0, features.EEG_BANDS, 0.5, features.EEG_BROAD), ["label"])
    return f.select("vec_id", r("abspow", 6), r("dt", 5), r("alpha_relative", 5), r("petrosian", 5), r("higuchi", 5))


@query("x6_limited_ffill", f"""WITH {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) AS i, CASE WHEN k > 70 THEN value END AS v FROM sig), l AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS li,
   last_value(v IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS lv FROM i_) SELECT event_id, CASE WHEN i - li <= 2 THEN lv END AS v FROM l""")
def x6(spark, d):
    from ..operators.timebase import limited_ffill
    s = signals(spark, d).withColumn("v", F.when(F.col("k") > 70, F.col("value")))
    return limited_ffill(s, signal_axis(spark, d), ["v"], 2).select("event_id", "v")


@query("x6_features_on_grid", f"""WITH {SIG}, bd AS (SELECT user_id, min(us) // 3600000000 * 3600000000 AS a, max(us) AS b FROM sig GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, b, 3600000000)) AS us FROM bd),
  f AS (SELECT user_id, us // 3600000000 * 3600000000 AS us, arg_max(value, (us, event_id)) AS v FROM sig WHERE k > 70 GROUP BY 1, us // 3600000000 * 3600000000),
  i_ AS (SELECT g.user_id, g.us, v, row_number() OVER (PARTITION BY g.user_id ORDER BY g.us) AS i FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.us = g.us),
  n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER x AS bi, last_value(v IGNORE NULLS) OVER x AS bv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER y AS fi, first_value(v IGNORE NULLS) OVER y AS fv FROM i_
    WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT user_id, us, CASE WHEN v IS NOT NULL THEN v WHEN i - bi <= 8 THEN bv WHEN fi - i <= 9 THEN fv END AS v FROM n""")
def x6g(spark, d):
    from ..operators.timebase import on_regular_grid
    s = signals(spark, d)
    b = s.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return on_regular_grid(s.where("k > 70").withColumnRenamed("value", "v"), b, signal_axis(spark, d), ["v"], 8, 3600.0).select("user_id", us("ts", "us"), "v")


@query("x7_channel_features", f"""WITH {SIG}, z AS (SELECT *, us // 432000000000 * 432000000000 AS b, value - lag(value) OVER w AS dv, avg(value) OVER f AS sv FROM sig WINDOW w AS ({ORD}), f AS ({ORD} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT user_id, b AS window_us, count(*) AS n_samples, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(avg(dv), 6) AS value_diff_mean, round(max(sv) - min(sv), 6) AS value_smoothed_range FROM z GROUP BY 1, 2 HAVING count(*) >= 5""")
def x7(spark, d):
    x = features.channel_features(signals(spark, d), signal_axis(spark, d), ["value"], 432000.0, ["raw", "diff", "smoothed"], "medium", 5)
    return x.select("user_id", us("window_start", "window_us"), "n_samples", r("value_mean"), r("value_std"), r("value_diff_mean"), r("value_smoothed_range"))


@query("x8_correlation_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def x8(spark, d):
    return features.correlation_matrix(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r"))


@query("x9_z_normalise", "WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN sd > 0 THEN (l_quantity - m) / sd ELSE 0 END, 6) AS l_quantity_z FROM lineitem JOIN s USING (l_suppkey)")
def x9(spark, d):
    return features.z_normalise(load(spark, d, "lineitem"), ["l_quantity"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", r("l_quantity_z"))


# --- learning ----------------------------------------------------------------------------------------

def wide(spark, d, n=64):
    """All values of the vectors as columns."""
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)])


FS = [f"f{i}" for i in range(64)]


@query("m1_m2_kmeans_ranked")
def m1(spark, d):
    c, k = learn.kmeans_pass(wide(spark, d), FS, 5)
    return learn.rank_clusters(c, "f0", k).groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"))


@query("m3_select_pass", "SELECT vec_id FROM embeddings WHERE label % 3 = 1")
def m3(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.concat(F.lit("p"), F.col("label") % 3).alias("pass_name"), F.col("label").alias("k"))
    return learn.select_pass(e, "p1", 4).select("vec_id")


@query("m4_pca")
def m4(spark, d):
    return learn.pca_projection(wide(spark, d), FS, 2).select("vec_id", F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"))


@query("m5_random_forest")
def m5(spark, d):
    w = learn.hash_split(wide(spark, d), "vec_id", 0.4)
    m = learn.train(w.where("NOT is_test"), FS, "label", "rf")
    return m.transform(w.where("is_test")).select("vec_id", "label", "predicted_label", r("pred_confidence", 4))


@query("m6_other_classifiers")
def m6(spark, d):
    w = wide(spark, d).withColumn("label", (F.col("label").cast("int") % 2).cast("string"))
    w = learn.stratified_split(w, "vec_id", "label", 0.4)
    seen, new = w.where("NOT is_test"), w.where("is_test")
    a = learn.train(seen, FS, "label", "svm").transform(new).select("vec_id", F.lit("svm").alias("kind"), "predicted_label")
    b = learn.train(seen, FS, "label", "gbt", 20).transform(new).select("vec_id", F.lit("gbt").alias("kind"), "predicted_label")
    return a.unionByName(b)


@query("m7_stratify", "SELECT event_id, 'd' || (user_id % 3) || '||' || event_type AS stratum, 'composite' AS stratify_note FROM events")
def m7(spark, d):
    s = signals(spark, d).withColumn("ds", F.concat(F.lit("d"), F.col("user_id") % 3))
    return learn.stratify_key(s, "ds", "event_type").select("event_id", "stratum", "stratify_note")


@query("m8_m9_folds_calibrated")
def m8(spark, d):
    w = wide(spark, d).withColumns({"label": (F.col("label").cast("int") < 5).cast("int").cast("string"), "grp": F.col("vec_id") % 7})
    o = learn.out_of_fold(learn.group_folds(w, "grp", 3), FS, "label", 3)
    return learn.platt(o, "score", "label").select("vec_id", "label", r("calibrated", 4))


@query("m11_window_labels", f"""WITH {SPANS}, w AS (SELECT user_id, us // 172800000000 * 172800000000 AS a FROM sig GROUP BY 1, 2), ev AS (SELECT * FROM sp WHERE e > s),
  o AS (SELECT w.user_id, w.a, event_type, sum(least(e, a + 172800000000) - greatest(s, a)) / 1e6 AS sec FROM w JOIN ev ON ev.user_id = w.user_id AND e > a AND s < a + 172800000000 GROUP BY 1, 2, 3),
  b AS (SELECT user_id, a, arg_min(event_type, (-sec, event_type)) AS label FROM o GROUP BY 1, 2) SELECT w.user_id, w.a AS window_us, coalesce(label, 'none') AS label FROM w LEFT JOIN b USING (user_id, a)""")
def m11(spark, d):
    from ..operators.timebase import bucket
    s = spans(spark, d)
    w = s.select("user_id", bucket("start_ts", 172800.0).alias("w_start")).distinct()
    w = w.withColumns({"w_end": add_seconds("w_start", 172800.0), "wid": F.concat_ws(":", "user_id", F.unix_micros("w_start"))})
    e = s.where("end_ts > start_ts").select("user_id", F.col("start_ts").alias("e_start"), F.col("end_ts").alias("e_end"), F.col("event_type").alias("label"))
    return learn.window_labels(w, e, ["user_id"], "wid", 86400.0).select("user_id", us("w_start", "window_us"), "label")


@query("m11_windows_to_states", f"""WITH {SIG}, w AS (SELECT user_id, us // 86400000000 * 86400000000 AS a, max(event_type) AS lab FROM sig GROUP BY 1, 2), b AS (SELECT *, max(a + 86400000000) OVER (PARTITION BY user_id, lab ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, lab ORDER BY a) AS g FROM b) SELECT user_id, lab AS label, min(a) AS start_us, max(a) + 86400000000 AS end_us, count(*) AS n_merged FROM g GROUP BY user_id, lab, g""")
def m11s(spark, d):
    from ..operators.timebase import bucket
    w = signals(spark, d).groupBy("user_id", bucket("ts", 86400.0).alias("window_start")).agg(F.max("event_type").alias("label"))
    w = w.withColumn("window_end", add_seconds("window_start", 86400.0))
    x = learn.windows_to_states(w, signal_axis(spark, d).with_(order=("window_start",)), "label")
    return x.select("user_id", "label", us("start_ts", "start_us"), us("end_ts", "end_us"), "n_merged")


@query("m13_common_events", f"WITH {SPANS} SELECT user_id, s AS us, 'observed.' || event_type AS key FROM sp WHERE k_ = 0 UNION ALL SELECT user_id, s, 'cluster.c' FROM sp WHERE k_ = 1".replace("value FROM sig)", "value, event_id % 2 AS k_ FROM sig)"))
def m13(spark, d):
    s = spans(spark, d).withColumn("label", F.col("event_type"))
    x = learn.common_events({"observed": s.where("event_id % 2 = 0"), "cluster": s.where("event_id % 2 = 1").withColumn("label", F.lit("c"))}, ["user_id"])
    return x.select("user_id", us("ts", "us"), "key")


@query("h21_two_cluster_model")
def h21m(spark, d):
    return learn.two_cluster_model(wide(spark, d), FS, F.col("label") == "3").select("vec_id", "cluster", "predicted")


@query("h27_tuned_out_of_fold")
def h27(spark, d):
    w = wide(spark, d).withColumn("label", (F.col("label").cast("int") < 3).cast("int").cast("string"))
    scores, best = learn.tuned_out_of_fold(w, FS, "label", "vec_id", 3, trees=30, depth=6)
    return scores.crossJoin(F.broadcast(best)).select("vec_id", "label", "fold", r("score", 4), r("threshold", 4))


@query("m8_transfer")
def m8t(spark, d):
    w = wide(spark, d).withColumn("ds", F.concat(F.lit("d"), F.col("vec_id") % 3))
    return learn.transfer(w, FS, "label", "ds", "d0", "d1", trees=30, depth=6).select("vec_id", "label", "predicted_label")


@query("m10_forward_ablation")
def m10(spark, d):
    groups = {f"block{k}": FS[16 * k:16 * k + 16] for k in range(4)}
    got = learn.forward_ablation(wide(spark, d), groups, "label", "vec_id", trees=10)
    return spark.createDataFrame([(k, g, a) for k, (g, a) in enumerate(got)], "step int, feature_group string, accuracy double")


@query("h21_best_cluster_by_f1", f"""WITH {SCORED}, c AS (SELECT user_id % 4 AS cluster, count(*) FILTER (y = 1) AS tp, count(*) AS n, (SELECT sum(y) FROM sc) AS pos FROM sc GROUP BY 1)
  SELECT cluster, round(2 * tp / (n + pos), 6) AS f1 FROM c ORDER BY 2 * tp / (n + pos) DESC, cluster LIMIT 1""")
def h21(spark, d):
    s = scored(spark, d).withColumn("cluster", F.col("user_id") % 4)
    return learn.best_cluster_by_f1(s, "cluster", F.col("y") == 1).select("cluster", r("f1"))


@query("m12_filters_on_predictions", f"WITH {SCORED} SELECT event_id, CASE WHEN p >= 0.5 AND y = 1 THEN 'sleep' WHEN p >= 0.5 THEN 'not_sleep' ELSE 'not_sleep' END AS nominal_class, CASE WHEN p >= 0.5 AND y = 0 THEN 'no_support' END AS context_reject_reason FROM sc")
def m12(spark, d):
    from ..operators import rules
    s = scored(spark, d).withColumns({"base_keep_filtered": F.col("p") >= 0.5, "base_nominal_class": F.lit("sleep")})
    f = [{"id": "supported", "rule": {"mode": "threshold_gate", "field": "y", "keep_if": {"comparator": ">=", "threshold": 1}}, "reject_reason": "no_support"}]
    return rules.final_class(rules.apply_filters(s, f)).select("event_id", "nominal_class", "context_reject_reason")
