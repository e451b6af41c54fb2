"""Rolling filters, depth, orientation and tracks on the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import depth, folds, geo, islands, orient, rolling, sampling, timebase as tb
from ..sources.tables import load, signal_axis, signals
from .q_islands import runs_sql, us
from .registry import SIG, query

W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
ORD = "PARTITION BY user_id ORDER BY ts, event_id"


def r(c, n=6):
    return F.round(c, n).alias(c)


def xyz(spark, d):
    """Triaxial view: value, k and their sum, shifted to both signs."""
    return signals(spark, d).withColumns({"ax": F.col("value") / 25 - 1, "ay": F.col("k") / 50 - 1, "az": (F.col("value") + F.col("k")) / 80 - 1})


XYZ = SIG + ", x AS (SELECT *, value / 25 - 1 AS ax, k / 50 - 1 AS ay, (value + k) / 80 - 1 AS az FROM sig)"
A3 = ["ax", "ay", "az"]


@query("w1_rolling_mean", f"""WITH {SIG} SELECT event_id, round(CASE WHEN count(value) OVER f >= 3 THEN avg(value) OVER f END, 6) AS value_mean FROM sig
  WINDOW f AS ({ORD} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def w1(spark, d):
    return rolling.rolling_mean(signals(spark, d), signal_axis(spark, d), 9, ["value"], 3).select("event_id", r("value_mean"))


def _odba_sql(norm):
    part = lambda c: (f"{c} - (sum({c}) OVER f + greatest(0, 3 - (row_number() OVER w - 1)) * first_value({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
                      f" + greatest(0, row_number() OVER w + 3 - count(*) OVER (PARTITION BY user_id)) * last_value({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7")
    return f"""WITH {XYZ}, q AS (SELECT event_id, {part('ax')} AS dx, {part('ay')} AS dy, {part('az')} AS dz FROM x
      WINDOW w AS ({ORD}), f AS ({ORD} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT event_id, round({norm}, 6) AS odba FROM q"""


@query("w2_vedba", _odba_sql("sqrt(dx * dx + dy * dy + dz * dz)"))
def w2(spark, d):
    return rolling.odba(xyz(spark, d), signal_axis(spark, d), 7, A3).select("event_id", r("odba"))


@query("w2_odba_wilson", _odba_sql("abs(dx) + abs(dy) + abs(dz)"))
def w2w(spark, d):
    return rolling.odba(xyz(spark, d), signal_axis(spark, d), 6, A3, "wilson").select("event_id", r("odba"))


def _taps_sql(h) -> str:
    return "tp AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {float(v)!r}::DOUBLE)" for j, v in enumerate(h)) + ") t(j, h))"


def _odba_fir_sql() -> str:
    import numpy as np
    h = dsp.fir_highpass(16, 0.5)
    pad = 3 * len(h)
    far = lambda end, c: f"2 * f.{end}_{c} - i_.{c} AS {c}"
    return f"""WITH {XYZ}, i_ AS (SELECT event_id, user_id, ax, ay, az, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM x), {_taps_sql(np.convolve(h, h[::-1]))},
  f AS (SELECT user_id, any_value(n) AS n, {', '.join(f"arg_min({c}, i) AS a_{c}, arg_max({c}, i) AS z_{c}" for c in ('ax', 'ay', 'az'))} FROM i_ GROUP BY 1),
  e AS (SELECT user_id, i, ax, ay, az FROM i_ UNION ALL SELECT i_.user_id, -i, {', '.join(far('a', c) for c in ('ax', 'ay', 'az'))} FROM i_ JOIN f USING (user_id) WHERE i BETWEEN 1 AND {pad}
    UNION ALL SELECT i_.user_id, 2 * (f.n - 1) - i, {', '.join(far('z', c) for c in ('ax', 'ay', 'az'))} FROM i_ JOIN f USING (user_id) WHERE i BETWEEN f.n - 1 - {pad} AND f.n - 2),
  y AS (SELECT a.event_id, sum(h * e.ax) AS x1, sum(h * e.ay) AS y1, sum(h * e.az) AS z1 FROM i_ a CROSS JOIN tp JOIN e ON e.user_id = a.user_id AND e.i = a.i + {len(h) - 1} - j GROUP BY 1)
  SELECT event_id, round(sqrt(x1 * x1 + y1 * y1 + z1 * z1), 6) AS odba FROM y"""


@query("w3_odba_fir", _odba_fir_sql())
def w3(spark, d):
    return rolling.odba_fir(xyz(spark, d), signal_axis(spark, d), 1.0, 0.25, A3).select("event_id", r("odba"))


@query("w4_activity_index", f"""WITH {XYZ}, m AS (SELECT event_id, ax - CASE WHEN count(*) OVER f >= 3 THEN avg(ax) OVER f END AS dx, ay - CASE WHEN count(*) OVER f >= 3 THEN avg(ay) OVER f END AS dy,
    az - CASE WHEN count(*) OVER f >= 3 THEN avg(az) OVER f END AS dz FROM x WINDOW f AS ({ORD} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
  SELECT event_id, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS activity FROM m""")
def w4(spark, d):
    return rolling.activity_index(xyz(spark, d), signal_axis(spark, d), 10 / 3600, A3, 1.0).select("event_id", r("activity"))


@query("w5_running_median", f"""WITH {SIG}, p AS (SELECT event_id, [coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value) OVER w, 0), value,
    coalesce(lead(value) OVER w, 0), coalesce(lead(value, 2) OVER w, 0)] AS v FROM sig {W}) SELECT event_id, list_sort(v)[3] AS smoothed FROM p""")
def w5(spark, d):
    return rolling.running_median(signals(spark, d), signal_axis(spark, d), 5, "value", "smoothed").select("event_id", "smoothed")


@query("w6_gradient", f"""WITH {SIG} SELECT event_id, round(coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w), 6) AS d1 FROM sig {W}""")
def w6(spark, d):
    return rolling.gradient(signals(spark, d), signal_axis(spark, d), {"d1": "value"}).select("event_id", r("d1"))


@query("w7_local_z", f"""WITH {SIG}, g AS (SELECT user_id, stddev_pop(value) AS gs FROM sig GROUP BY 1),
  m AS (SELECT event_id, value, gs, avg(value) OVER f AS mu, stddev_pop(value) OVER f AS sd FROM sig JOIN g USING (user_id)
    WINDOW f AS ({ORD} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))
  SELECT event_id, round((value - mu) / greatest(sd, 0.05 * gs), 5) AS z FROM m""")
def w7(spark, d):
    return rolling.local_z(signals(spark, d), signal_axis(spark, d), 12, "value", "z", 0.05).select("event_id", r("z", 5))


@query("w8_remove_spikes", f"""WITH {SIG}, a AS (SELECT user_id, median(value) AS m FROM sig GROUP BY 1),
  b AS (SELECT user_id, any_value(m) AS m, median(abs(value - m)) AS mad FROM sig JOIN a USING (user_id) GROUP BY 1)
  SELECT event_id, round(CASE WHEN abs(value - m) > 3 * mad THEN m ELSE value END, 6) AS clean FROM sig JOIN b USING (user_id)""")
def w8(spark, d):
    return rolling.remove_spikes(signals(spark, d), ["user_id"], "value", "clean", 3.0).select("event_id", r("clean"))


@query("w9_bartlett_smooth", f"""WITH {SIG} SELECT event_id, round(0.25 * coalesce(lag(value) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, 0), 6) AS smooth FROM sig {W}""")
def w9(spark, d):
    return rolling.bartlett_smooth(signals(spark, d), signal_axis(spark, d), 5, "value", "smooth").select("event_id", r("smooth"))


@query("w10_butterworth_band")
def w10(spark, d):
    return rolling.butterworth(signals(spark, d), signal_axis(spark, d), 1.0, (0.1, 0.3), {"band": "value"}).select("event_id", r("band"))


@query("w11_decimate", f"""WITH {SIG}, i_ AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i FROM sig), {_taps_sql(dsp.fir_lowpass(81, 0.25))}
  SELECT a.event_id, round(sum(h * b.value), 6) AS low FROM i_ a JOIN tp ON a.i % 4 = 0 JOIN i_ b ON b.user_id = a.user_id AND b.i = a.i + 40 - j GROUP BY 1""")
def w11(spark, d):
    return rolling.decimate(signals(spark, d), signal_axis(spark, d), 4, {"low": "value"}).select("event_id", r("low"))


@query("w12_rolling_mean_std", f"""WITH {SIG}, m AS (SELECT event_id, row_number() OVER ({ORD}) - 1 AS i, avg(value) OVER f AS mu, stddev_pop(value) OVER f AS sd, count(*) OVER f AS n FROM sig
    WINDOW f AS ({ORD} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
  SELECT event_id, round(CASE WHEN n = 10 THEN mu END, 6) AS rolling_mean, round(CASE WHEN n = 10 THEN sd END, 5) AS rolling_std FROM m WHERE i % 3 = 0""")
def w12(spark, d):
    return rolling.rolling_mean_std(signals(spark, d), signal_axis(spark, d), 10, 3, "value").select("event_id", r("rolling_mean"), r("rolling_std", 5))


@query("w13_norm_jerk", f"""WITH {XYZ} SELECT event_id, round(coalesce(5 * sqrt((ax - lag(ax) OVER w) ** 2 + (ay - lag(ay) OVER w) ** 2 + (az - lag(az) OVER w) ** 2), 0), 6) AS jerk FROM x {W}""")
def w13(spark, d):
    return rolling.norm_jerk(xyz(spark, d), signal_axis(spark, d), A3, 5.0).select("event_id", r("jerk"))


@query("w15_distance", f"""WITH {SIG}, s AS (SELECT *, coalesce(CASE WHEN value > 20 THEN k * (us - lag(us) OVER w) / 1e6 END, 0) AS st FROM sig {W})
  SELECT event_id, round(sum(st) OVER ({ORD}), 1) AS distance FROM s""")
def w15(spark, d):
    return rolling.travelled(signals(spark, d), signal_axis(spark, d), "k", F.col("value") > 20).select("event_id", r("distance", 1))


@query("w16_spectrogram")
def w16(spark, d):
    s = rolling.spectrogram(signals(spark, d), signal_axis(spark, d), "value", 1.0, 16, 0.5, (0.1, 0.4))
    return s.select("user_id", "frame", F.transform("db", lambda v: F.round(v, 4)).alias("db"))


@query("w18_wavelet_power")
def w18(spark, d):
    h = tb.resample(signals(spark, d), signal_axis(spark, d), 6 * 3600.0, {"v": ("mean", "value")})
    ax = signal_axis(spark, d).with_(order=("bin_ts",))
    h = tb.linear_fill(h, ax, ["v"], "both")
    p = rolling.wavelet_power(h, ax, "v", 6.0, [12.0, 24.0, 36.0, 48.0, 72.0, 96.0])
    return p.select("user_id", "period_hours", r("power"), "n_samples", r("coi_hours"))


@query("w19_dominant_periods", f"""WITH {SIG}, s AS (SELECT event_type, hour(ts) + 1 AS p, avg(value) AS pw FROM sig GROUP BY 1, 2),
  l AS (SELECT *, coalesce(pw > lag(pw) OVER w AND pw >= lead(pw) OVER w, FALSE) AS pk FROM s WINDOW w AS (PARTITION BY event_type ORDER BY p)),
  q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pk DESC, pw DESC, p) AS rk FROM l)
  SELECT event_type, CAST(p AS DOUBLE) AS period_hours, CAST(rk AS BIGINT) AS rank, p <= 12 AS within_coi,
    CASE WHEN least(abs(p - 6) / 6, abs(p - 12) / 12, abs(p - 24) / 24) > 0.25 THEN '—' WHEN abs(p - 6) / 6 <= least(abs(p - 12) / 12, abs(p - 24) / 24) THEN '6 h'
         WHEN abs(p - 12) / 12 <= abs(p - 24) / 24 THEN '12 h (semi-diel / tidal)' ELSE '24 h (diel)' END AS nearest_cycle
  FROM q WHERE pk AND rk <= 3""")
def w19(spark, d):
    s = signals(spark, d).groupBy("event_type", (F.hour("ts") + 1).cast("double").alias("period_hours")).agg(
        F.avg("value").alias("power")).withColumn("coi_hours", F.lit(12.0))
    p = rolling.dominant_periods(s, ["event_type"], 3)
    return p.select("event_type", "period_hours", F.col("rank").cast("bigint").alias("rank"), "within_coi", "nearest_cycle")


# --- depth -------------------------------------------------------------------------------------------

@query("z1_convert_depth", f"""WITH {SIG}, f AS (SELECT event_id, user_id, (value - 60) * 0.5 AS dm FROM sig), m AS (SELECT user_id, median(dm) AS md FROM f GROUP BY 1)
  SELECT event_id, round(CASE WHEN md < -10 THEN -dm ELSE dm END, 6) AS depth FROM f JOIN m USING (user_id)""")
def z1(spark, d):
    s = signals(spark, d).withColumn("p", F.col("value") - 60)
    return depth.convert_depth(s, ["user_id"], "p", F.lit(0.5), "depth").select("event_id", r("depth"))


def _chunks(spark, d):
    s = signals(spark, d).withColumn("slope", F.col("k") - 50)
    return s, islands.flat_chunks(s, signal_axis(spark, d), "value", "slope", 35.0, 3, 20.0)


FLAT = f"""{runs_sql('abs(k - 50) < 35')}, md AS (SELECT user_id, isl, median(value) AS md FROM rows_ WHERE p GROUP BY 1, 2),
  ch AS (SELECT runs.user_id, s, e, md FROM runs JOIN md USING (user_id, isl) WHERE p AND n >= 3 AND abs(md) < 20)"""


@query("z2_zero_offset", f"""WITH {FLAT}, o AS (SELECT x.*, ch.md AS o FROM rows_ x LEFT JOIN ch ON ch.user_id = x.user_id AND x.us BETWEEN ch.s AND ch.e),
  nb AS (SELECT *, last_value(CASE WHEN o IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS bi, last_value(o IGNORE NULLS) OVER a AS bv,
     first_value(CASE WHEN o IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS fi, first_value(o IGNORE NULLS) OVER b AS fv FROM o
     WINDOW a AS ({ORD} ROWS UNBOUNDED PRECEDING), b AS ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(value - coalesce(o, bv + (fv - bv) * (idx - bi) / (fi - bi), bv, 0), 6) AS depth_zoc FROM nb""")
def z2(spark, d):
    s = signals(spark, d).withColumn("slope", F.col("k") - 50)
    return depth.level_surface(s, signal_axis(spark, d), "value", "slope", 35.0, 3, 20.0, bin_s=21600.0).select("event_id", r("depth_zoc"))


@query("z3_chunk_regression", f"""WITH {FLAT} SELECT ch.user_id, ch.s AS start_us, round(regr_slope(x.value, x.k - 20), 5) AS slope, round(regr_intercept(x.value, x.k - 20), 5) AS intercept
  FROM ch JOIN sig x ON x.user_id = ch.user_id AND x.us BETWEEN ch.s AND ch.e GROUP BY 1, 2 HAVING count(*) > 1""")
def z3(spark, d):
    s, ch = _chunks(spark, d)
    x = depth.chunk_regression(s, ch, signal_axis(spark, d), "value", "k", bin_s=21600.0)
    return x.select("user_id", us("start_ts", "start_us"), r("slope", 5), r("intercept", 5))


@query("z4_surface_outside_dives", f"""WITH {runs_sql('value > 40')}, b AS (SELECT user_id, min(s) AS a, max(e) AS z FROM runs WHERE p AND e - s >= 3600000000 GROUP BY 1)
  SELECT event_id, CASE WHEN us < a OR us > z THEN 0 ELSE value END AS value FROM sig LEFT JOIN b USING (user_id)""")
def z4(spark, d):
    s, ax = signals(spark, d), signal_axis(spark, d)
    return depth.surface_outside_dives(s, islands.dives(s, ax, "value", 40.0, 3600.0), ax, "value").select("event_id", "value")


@query("z5_pressure_to_depth", f"""WITH {SIG}, p AS (SELECT *, list_sort([coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value) OVER w, 0), value, coalesce(lead(value) OVER w, 0), coalesce(lead(value, 2) OVER w, 0)])[3] AS sm,
    row_number() OVER w AS idx FROM sig WINDOW w AS ({ORD})),
  g AS (SELECT *, coalesce((lead(sm) OVER w - lag(sm) OVER w) / 2, lead(sm) OVER w - sm, sm - lag(sm) OVER w) AS d1 FROM p WINDOW w AS ({ORD})),
  f AS (SELECT *, coalesce(abs(d1) < 20, FALSE) AS fl FROM g), r1 AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, fl ORDER BY ts, event_id) AS isl FROM f),
  ch AS (SELECT user_id, min(us) AS s, max(us) AS e, median(sm) AS md FROM r1 WHERE fl GROUP BY user_id, isl HAVING count(*) >= 3 AND abs(median(sm)) < 30),
  o AS (SELECT x.*, ch.md AS o FROM r1 x LEFT JOIN ch ON ch.user_id = x.user_id AND x.us BETWEEN ch.s AND ch.e),
  nb AS (SELECT *, last_value(CASE WHEN o IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS bi, last_value(o IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN o IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS fi, first_value(o IGNORE NULLS) OVER b AS fv FROM o
     WINDOW a AS ({ORD} ROWS UNBOUNDED PRECEDING), b AS ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  z AS (SELECT *, sm - coalesce(o, bv + (fv - bv) * (idx - bi) / (fi - bi), bv, 0) AS depth FROM nb), dv AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, depth > 15 ORDER BY ts, event_id) AS di FROM z),
  dr AS (SELECT user_id, min(us) AS s, max(us) AS e FROM dv WHERE depth > 15 GROUP BY user_id, di HAVING max(us) - min(us) >= 10000000), bd AS (SELECT user_id, min(s) AS a, max(e) AS b FROM dr GROUP BY 1)
  SELECT event_id, round(CASE WHEN us < a OR us > b THEN 0 ELSE depth END, 6) AS depth FROM z LEFT JOIN bd USING (user_id)""")
def z5(spark, d):
    s, _ = depth.pressure_to_depth(signals(spark, d), signal_axis(spark, d), "value", F.lit(1.0),
                                   {"max_flat_slope": 20.0, "min_flat_samples": 3, "flat_cap_m": 30.0, "min_flat_chunks": 1, "dive_threshold_m": 15.0})
    return s.select("event_id", r("depth"))


# --- orientation -------------------------------------------------------------------------------------

@query("v1_field_intensity", f"""WITH {XYZ} SELECT event_id, round(sqrt(ax * ax + ay * ay + az * az), 6) AS acc_intensity, round(sqrt(value * value + k * k + 9), 6) AS mag_intensity,
  round(-degrees(asin((ax * value + ay * k + az * 3) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(value * value + k * k + 9)))), 5) AS inclination_deg FROM x""")
def v1(spark, d):
    x = orient.field_intensity(xyz(spark, d).withColumn("m3", F.lit(3.0)), A3, ["value", "k", "m3"])
    return x.select("event_id", r("acc_intensity"), r("mag_intensity"), r("inclination_deg", 5))


@query("v2_triaxial_offset", f"""WITH {SIG}, x AS (SELECT user_id, sin(event_id) + 0.1 AS x, cos(event_id * 1.7) - 0.2 AS y, sin(event_id * 0.3 + k) AS z FROM sig WHERE k IS NOT NULL),
  m AS (SELECT user_id, count(*) AS n, sum(x * x + y * y + z * z) AS b, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum((x * x + y * y + z * z) * x) AS bx, sum((x * x + y * y + z * z) * y) AS by_, sum((x * x + y * y + z * z) * z) AS bz,
    sum(x * x) AS xx, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * y) AS yy, sum(y * z) AS yz, sum(z * z) AS zz FROM x GROUP BY 1),
  q AS (SELECT user_id, 4 * (xx - sx * sx / n) AS a, 4 * (xy - sx * sy / n) AS h, 4 * (xz - sx * sz / n) AS g, 4 * (yy - sy * sy / n) AS d, 4 * (yz - sy * sz / n) AS f, 4 * (zz - sz * sz / n) AS c,
    2 * (bx - sx * b / n) AS u, 2 * (by_ - sy * b / n) AS v, 2 * (bz - sz * b / n) AS w FROM m),
  e AS (SELECT *, a * (d * c - f * f) - h * (h * c - f * g) + g * (h * f - d * g) AS det FROM q)
  SELECT user_id, round(-(u * (d * c - f * f) - h * (v * c - f * w) + g * (v * f - d * w)) / det, 6) AS ox, round(-(a * (v * c - f * w) - u * (h * c - f * g) + g * (h * w - v * g)) / det, 6) AS oy,
    round(-(a * (d * w - v * f) - h * (h * w - v * g) + u * (h * f - d * g)) / det, 6) AS oz, 'ok' AS status FROM e""")
def v2(spark, d):
    s = signals(spark, d).withColumns({"ax": F.sin("event_id") + 0.1, "ay": F.cos(F.col("event_id") * 1.7) - 0.2, "az": F.sin(F.col("event_id") * 0.3 + F.col("k"))})
    return orient.estimate_offsets(s, ["user_id"], A3).select("user_id", r("ox"), r("oy"), r("oz"), "status")


@query("v3_v4_animal_frame", f"""WITH {XYZ}, cm AS (SELECT user_id, coalesce(avg(ax) FILTER (event_type = 'view'), avg(ax), 1) AS a, coalesce(avg(ay) FILTER (event_type = 'view'), avg(ay), 0) AS b,
    coalesce(avg(az) FILTER (event_type = 'view'), avg(az), -1) AS c FROM x GROUP BY 1),
  an AS (SELECT user_id, -asin(a / sqrt(a * a + b * b + c * c)) AS p, atan2(b, c) AS r FROM cm),
  q AS (SELECT event_id, ax * cos(p) + (ay * sin(r) + az * cos(r)) * sin(p) AS x1, ay * cos(r) - az * sin(r) AS y1, (ay * sin(r) + az * cos(r)) * cos(p) - ax * sin(p) AS z1,
    value * cos(p) + (k * sin(r) + 3 * cos(r)) * sin(p) AS mx, k * cos(r) - 3 * sin(r) AS my, (k * sin(r) + 3 * cos(r)) * cos(p) - value * sin(p) AS mz FROM x JOIN an USING (user_id)),
  h AS (SELECT *, -asin(x1 / sqrt(x1 * x1 + y1 * y1 + z1 * z1)) AS pp, atan2(y1, z1) AS rr FROM q)
  SELECT event_id, round(degrees(pp), 5) AS pitch_deg, round(degrees(rr), 5) AS roll_deg,
    round(degrees(atan2(my * cos(rr) - mz * sin(rr), mx * cos(pp) + (my * sin(rr) + mz * cos(rr)) * sin(pp))) + 1.5, 5) AS heading_deg FROM h""")
def v3(spark, d):
    x = xyz(spark, d).withColumns({"m3": F.lit(3.0), "decl": F.lit(1.5)})
    ang = orient.posture_angles(orient.mean_posture(x, ["user_id"], A3, F.col("event_type") == "view"), ["user_id"])
    y = orient.animal_frame(x, ang, ["user_id"], A3, mag=["value", "k", "m3"], declination="decl")
    return y.select("event_id", r("pitch_deg", 5), r("roll_deg", 5), r("heading_deg", 5))


@query("v5_mean_posture", f"""WITH {XYZ} SELECT user_id, round(coalesce(avg(ax) FILTER (value > 150), avg(ax)), 6) AS abar0, round(coalesce(avg(ay) FILTER (value > 150), avg(ay)), 6) AS abar1,
  round(coalesce(avg(az) FILTER (value > 150), avg(az)), 6) AS abar2 FROM x GROUP BY 1""")
def v5(spark, d):
    return orient.mean_posture(xyz(spark, d), ["user_id"], A3, F.col("value") > 150).select("user_id", r("abar0"), r("abar1"), r("abar2"))


@query("v6_accel_orientation", f"""WITH {XYZ}, m AS (SELECT *, avg(ax) OVER f AS sx, avg(ay) OVER f AS sy, avg(az) OVER f AS sz FROM x WINDOW f AS ({ORD} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
  SELECT event_id, round(-degrees(asin(sx / sqrt(sx * sx + sy * sy + sz * sz))), 5) AS pitch_deg, round(abs(degrees(atan2(sy, sz))), 5) AS roll_deg,
    round(sqrt((ax - sx) ** 2 + (ay - sy) ** 2 + (az - sz) ** 2), 6) AS odba FROM m""")
def v6(spark, d):
    x = orient.accel_orientation(xyz(spark, d), signal_axis(spark, d), A3, 1.0)
    return x.select("event_id", r("pitch_deg", 5), F.round(F.abs("roll_deg"), 5).alias("roll_deg"), r("odba"))


@query("v7_embedding_unit_norm", """WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS l, embedding FROM embeddings)
  SELECT vec_id, round(l, 5) AS length, round(CAST(embedding[1] AS DOUBLE) / l, 5) AS first_unit FROM n""")
def v7(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.withColumn("length", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v)))
    return e.select("vec_id", r("length", 5), F.round(F.get("e", F.lit(0)) / F.col("length"), 5).alias("first_unit"))


@query("v7_unit_norm", f"WITH {XYZ}, n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS l FROM x) SELECT event_id, round(ax / l, 6) AS ax, round(ay / l, 6) AS ay, round(az / l, 6) AS az FROM n")
def v7u(spark, d):
    return orient.unit_norm(xyz(spark, d), A3).select("event_id", r("ax"), r("ay"), r("az"))


@query("v8_orientation_frame", f"WITH {SIG} SELECT user_id, epoch_us(ts) AS us, value AS pitch, k AS roll, 0.0::DOUBLE AS heading FROM sig")
def v8(spark, d):
    s = signals(spark, d)
    x = orient.orientation_frame([s.select("user_id", "ts", F.col("value").alias("Pitch")), s.select("user_id", "ts", F.col("k").alias("ROLL_DEG"))], ["user_id"], "ts")
    return x.select("user_id", us("ts", "us"), "pitch", "roll", "heading")


# --- tracks ------------------------------------------------------------------------------------------

TRK = SIG + ", t AS (SELECT event_id, user_id, ts, us, event_type, value % 60 AS lat, k - 50 AS lon FROM sig)"
HAV = lambda a, b, c, e: f"2 * 6371.0088 * asin(sqrt(least(1, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({e} - {b}) / 2) ** 2)))"


def track(spark, d):
    return signals(spark, d).withColumns({"lat": F.col("value") % 60, "lon": F.col("k") - 50})


@query("k1_haversine", f"WITH {TRK} SELECT event_id, round({HAV('lat', 'lon', '10', '20')}, 5) AS km FROM t")
def k1(spark, d):
    return track(spark, d).select("event_id", F.round(geo.haversine("lat", "lon", F.lit(10.0), F.lit(20.0)), 5).alias("km"))


@query("k2_speed_outliers", f"""WITH RECURSIVE {TRK}, n_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM t),
  f(user_id, rn, event_id, bad, pus, plat, plon) AS (SELECT user_id, rn, event_id, FALSE, us, lat, lon FROM n_ WHERE rn = 1
   UNION ALL SELECT n_.user_id, n_.rn, n_.event_id, b, CASE WHEN b THEN pus ELSE us END, CASE WHEN b THEN plat ELSE lat END, CASE WHEN b THEN plon ELSE lon END
   FROM (SELECT n_.*, f.pus, f.plat, f.plon, n_.us - f.pus <= 0 OR {HAV('f.plat', 'f.plon', 'n_.lat', 'n_.lon')} / ((n_.us - f.pus) / 3.6e9) > 300 AS b
         FROM f JOIN n_ ON n_.user_id = f.user_id AND n_.rn = f.rn + 1) n_)
  SELECT event_id, bad AS outlier FROM f""")
def k2(spark, d):
    return folds.speed_filter(track(spark, d), signal_axis(spark, d), "lat", "lon", 300.0).select("event_id", "outlier")


@query("k3_two_pass_speed_filter")
def k3(spark, d):
    x = geo.two_pass_speed_filter(track(spark, d), signal_axis(spark, d), "lat", "lon", 300.0, F.col("event_type") != "view")
    return x.select("event_id", "lat", "lon")


@query("k4_quality_filter", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 6")
def k4(spark, d):
    return signals(spark, d).where("k >= 6").select("event_id")


@query("k5_equinox_sigma", """WITH e AS (SELECT o_orderkey, epoch_us(o_orderdate) AS us, least(""" + ", ".join(
    f"abs(floor((epoch_us(o_orderdate) - epoch_us(make_timestamp(year(o_orderdate) + {dy}, {m}, {dd}, 0, 0, 0))) / 86400e6))" for dy in (-1, 0, 1) for m, dd in ((3, 20), (9, 22)))
    + """) AS d FROM orders) SELECT o_orderkey, CAST(d AS DOUBLE) AS equinox_days, CASE WHEN d <= 21 THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END AS lat_sigma_deg FROM e""")
def k5(spark, d):
    return load(spark, d, "orders").select("o_orderkey", geo.days_from_equinox("o_orderdate").alias("equinox_days"), geo.latitude_sigma("o_orderdate").alias("lat_sigma_deg"))


@query("k6_kernel_smooth", f"""WITH {TRK}, wt AS (SELECT *, 1 / (1 + abs(lon)) AS w FROM t)
  SELECT a.event_id, round(sum(exp(-0.5 * ((a.us - b.us) / 86400e6) ** 2) * b.w * b.lat) / sum(exp(-0.5 * ((a.us - b.us) / 86400e6) ** 2) * b.w), 6) AS lat_smoothed,
    round(sum(exp(-0.5 * ((a.us - b.us) / 86400e6) ** 2) * b.lon) / sum(exp(-0.5 * ((a.us - b.us) / 86400e6) ** 2)), 6) AS lon_smoothed
  FROM wt a JOIN wt b USING (user_id) GROUP BY a.event_id""")
def k6(spark, d):
    x = geo.kernel_smooth(track(spark, d), signal_axis(spark, d), {"lat": 1 / (1 + F.abs("lon")), "lon": F.lit(1.0)}, 86400.0)
    return x.select("event_id", r("lat_smoothed"), r("lon_smoothed"))


@query("k6_smooth_geolocation")
def k6s(spark, d):
    x = geo.smooth_geolocation(track(spark, d), signal_axis(spark, d), "lat", "lon", 24.0, 300.0)
    return x.select("event_id", "outlier", r("lat_smoothed", 5), r("lon_smoothed", 5), "lat_sigma_deg")


@query("k7_hourly_smooth", f"""WITH {TRK}, bd AS (SELECT user_id, min(us) // 1000000 * 1000000 AS a, max(us) AS b FROM t GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, b, 3600000000)) AS us FROM bd),
  one AS (SELECT user_id, us, arg_max(lat, event_id) AS lat, arg_max(lon, event_id) AS lon FROM t GROUP BY 1, 2),
  pq AS (SELECT g.*, p.us AS pu, p.lat AS pa, p.lon AS po FROM g ASOF JOIN one p ON p.user_id = g.user_id AND p.us <= g.us),
  nx AS (SELECT pq.*, n.us AS nu, n.lat AS na, n.lon AS no_ FROM pq ASOF LEFT JOIN one n ON n.user_id = pq.user_id AND n.us >= pq.us),
  v AS (SELECT user_id, us, CASE WHEN pu = us THEN pa ELSE pa + (na - pa) * (us - pu) / (nu - pu) END AS lat, CASE WHEN pu = us THEN po ELSE po + (no_ - po) * (us - pu) / (nu - pu) END AS lon FROM nx),
  i_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM v WHERE lat IS NOT NULL AND lon IS NOT NULL)
  SELECT a.user_id, a.us, round(sum(exp(-0.5 * (j / 2.0) ** 2) * b.lat) / sum(exp(-0.5 * (j / 2.0) ** 2)), 5) AS lat_smoothed, round(sum(exp(-0.5 * (j / 2.0) ** 2) * b.lon) / sum(exp(-0.5 * (j / 2.0) ** 2)), 5) AS lon_smoothed
  FROM i_ a CROSS JOIN generate_series(-4, 4) t(j) JOIN i_ b ON b.user_id = a.user_id AND b.i = a.i + j GROUP BY 1, 2""")
def k7(spark, d):
    x = geo.hourly_smooth(track(spark, d), signal_axis(spark, d), ["lat", "lon"])
    return x.select("user_id", us("ts", "us"), r("lat_smoothed", 5), r("lon_smoothed", 5))


@query("k8_bin_locations", f"""WITH {TRK} SELECT user_id, us // 43200000000 * 43200000000 AS bin_us, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, arg_min(event_type, us) AS event_type FROM t GROUP BY 1, 2""")
def k8(spark, d):
    x = geo.bin_locations(track(spark, d), ["user_id"], "ts", "lat", "lon", 43200.0, ["event_type"])
    return x.select("user_id", us("bin_ts", "bin_us"), r("lat"), r("lon"), "event_type")


@query("j7_values_at_locations", f"""WITH {TRK}, b AS (SELECT user_id, us // 43200000000 * 43200000000 AS bin_us, avg(lat) AS lat, avg(lon) AS lon FROM t GROUP BY 1, 2),
  v AS (SELECT user_id, us // 43200000000 * 43200000000 AS bin_us, avg(value) AS value FROM (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'view') GROUP BY 1, 2)
  SELECT user_id, bin_us, round(lat, 6) AS lat, round(lon, 6) AS lon, round(value, 6) AS value FROM b LEFT JOIN v USING (user_id, bin_us)""")
def j7(spark, d):
    x = geo.values_at_locations(track(spark, d), signals(spark, d).where("event_type = 'view'"), ["user_id"], "ts", "lat", "lon", "value", 43200.0, [])
    return x.select("user_id", us("bin_ts", "bin_us"), r("lat"), r("lon"), r("value"))


@query("k9_track_extent", f"""WITH {TRK}, e AS (SELECT user_id, min(lat) - 20 AS a, max(lat) + 20 AS b, min(((lon % 360) + 360) % 360) - 20 AS c, max(((lon % 360) + 360) % 360) + 20 AS d FROM t GROUP BY 1)
  SELECT user_id, round(greatest(-90, a), 6) AS lat_min, round(least(90, b), 6) AS lat_max, ((((c % 360) + 360) % 360 + 180) % 360) - 180 AS lon_min,
    ((((d % 360) + 360) % 360 + 180) % 360) - 180 AS lon_max FROM e""")
def k9(spark, d):
    return geo.track_extent(track(spark, d), ["user_id"], "lat", "lon").select("user_id", r("lat_min"), r("lat_max"), "lon_min", "lon_max")


@query("k10_sun_hours", """WITH b AS (SELECT o_orderkey, dayofyear(o_orderdate) AS n, (o_custkey % 120) - 60.0 AS lat, (o_custkey % 300) - 150.0 AS lon FROM orders),
  """ + ", ".join(f"""t{s} AS (SELECT *, n + ({h} - lon / 15) / 24 AS t FROM b), m{s} AS (SELECT *, 0.9856 * t - 3.289 AS m FROM t{s}),
  l{s} AS (SELECT *, (m + 1.916 * sin(radians(m)) + 0.020 * sin(radians(2 * m)) + 282.634) % 360 AS lq FROM m{s}), ln{s} AS (SELECT *, (lq + 360) % 360 AS L FROM l{s}),
  ra{s} AS (SELECT *, (degrees(atan(0.91764 * tan(radians(L)))) + 360) % 360 AS ra0 FROM ln{s}),
  rb{s} AS (SELECT *, (ra0 + floor(L / 90) * 90 - floor(ra0 / 90) * 90) / 15 AS ra, 0.39782 * sin(radians(L)) AS sd FROM ra{s}),
  ch{s} AS (SELECT *, (cos(radians(90.833)) - sd * sin(radians(lat))) / (cos(asin(sd)) * cos(radians(lat))) AS c FROM rb{s}),
  h{s} AS (SELECT o_orderkey, CASE WHEN c BETWEEN -1 AND 1 THEN ({a}) / 15 + ra - 0.06571 * t - 6.622 - lon / 15 END AS u FROM ch{s}),
  f{s} AS (SELECT o_orderkey, floor((((u % 24) + 24) % 24) * 3600) / 3600 AS hr FROM h{s})""" for s, h, a in (("r", 6.0, "360 - degrees(acos(c))"), ("s", 18.0, "degrees(acos(c))"))) + """
  SELECT o_orderkey, round(fr.hr, 6) AS sunrise, round(fs.hr, 6) AS sunset FROM fr JOIN fs USING (o_orderkey)""")
def k10(spark, d):
    o = load(spark, d, "orders")
    day, lat, lon = F.to_date("o_orderdate"), (F.col("o_custkey") % 120) - 60.0, (F.col("o_custkey") % 300) - 150.0
    return o.select("o_orderkey", F.round(geo.sun_local_hour(day, lat, lon, "UTC", True), 6).alias("sunrise"),
                    F.round(geo.sun_local_hour(day, lat, lon, "UTC", False), 6).alias("sunset"))


@query("k11_grid_covariates", f"""WITH {TRK}, g AS (SELECT CAST(round((c_acctbal % 60) / 5) AS BIGINT) AS cy, CAST(round((c_custkey % 100 - 50) / 5) AS BIGINT) AS cx, avg(c_acctbal) AS sst FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2)
  SELECT event_id, round(sst, 6) AS sst FROM t LEFT JOIN g ON cy = CAST(round(lat / 5) AS BIGINT) AND cx = CAST(round(lon / 5) AS BIGINT)""")
def k11(spark, d):
    c = load(spark, d, "customer").where("c_acctbal >= 0").select(
        (F.col("c_acctbal") % 60).alias("lat"), (F.col("c_custkey") % 100 - 50).alias("lon"), F.col("c_acctbal").alias("sst"))
    return geo.grid_covariates(track(spark, d), c, "lat", "lon", 5.0, ["sst"]).select("event_id", r("sst"))


@query("p16_offset_to_latlon", f"WITH {SIG} SELECT event_id, round(10 + value / 111320, 8) AS lat, round(20 + k / (111320 * cos(radians(10))), 8) AS lon FROM sig")
def p16(spark, d):
    lat, lon = geo.offset_to_latlon(F.lit(10.0), F.lit(20.0), F.col("k"), F.col("value"))
    return signals(spark, d).select("event_id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


# --- limits ------------------------------------------------------------------------------------------

@query("l2_nth_candidate", f"""WITH {SIG}, k_ AS (SELECT *, row_number() OVER ({ORD}) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM sig WHERE value > 60)
  SELECT user_id, event_id FROM k_ WHERE rn = least(12, c)""")
def l2(spark, d):
    return sampling.nth_candidate(signals(spark, d), signal_axis(spark, d), F.col("value") > 60, 12).select("user_id", "event_id")


@query("l3_even_subsample", f"""WITH {SIG}, k_ AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM sig)
  SELECT user_id, event_id FROM k_ WHERE c <= 10 OR i IN (SELECT unnest([j * (c - 1) // 9 for j in range(10)]))""")
def l3(spark, d):
    return sampling.even_subsample(signals(spark, d), signal_axis(spark, d), 10).select("user_id", "event_id")
