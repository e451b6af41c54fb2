"""Beat detection, clean-up and levelling: whole entities and chunked passes agree; order statistics, lags and p-values."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.core.axis import Axis
from driftline.core.order import SlidingOrder
from driftline.functions.special import correlation_p, t_two_sided
from driftline.operators import depth, islands, peaks, rolling, timebase

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
AXIS = Axis(("animal",), ("ts", "n"), width=40_000_000, rows=1_000_000)


def signal(spark, hz=20.0, seconds=120, animals=2, seed=1):
    """Beats of changing height in noise, with a spike and two missing samples."""
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(animals):
        n = int(hz * seconds)
        t = np.arange(n) / hz
        v = 0.2 * rng.normal(size=n) + (1 + a) * np.exp(-((t % (0.9 + 0.2 * a)) - 0.4) ** 2 / 0.002) * (1 + 0.5 * np.sin(t / 5))
        v[n // 3] = 400.0
        for i in range(n):
            rows.append((f"a{a}", T0 + timedelta(seconds=float(t[i])), i, None if i in (777, 778) else float(v[i])))
    return spark.createDataFrame(rows, "animal string, ts timestamp, n long, x double")


def test_sliding_order_equals_numpy():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300):
        v = np.round(rng.normal(size=n), 1)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(lo + rng.integers(0, n + 1, 200), n)
        tree = SlidingOrder(v)
        got = tree.quantile(lo, hi, 0.3)
        want = [np.quantile(v[a:b], 0.3) if b > a else np.nan for a, b in zip(lo, hi)]
        assert np.allclose(got, want, equal_nan=True, atol=1e-12)
    assert np.isnan(SlidingOrder(np.empty(0)).kth(np.array([0]), np.array([0]), np.array([0]))).all()


@pytest.mark.parametrize("kernel", [5, 401])
def test_running_median_of_any_width(spark, kernel):
    s = signal(spark, animals=1)
    got = rolling.running_median(s, AXIS.with_(rows=500), kernel, "x", "m").orderBy("n").toPandas()
    v = np.pad(got["x"].fillna(0.0).to_numpy(), kernel // 2)
    want = [np.median(v[i:i + kernel]) for i in range(len(got))]
    assert np.allclose(got["m"], want)


BANDS = dict(broad=(0.5, 8.0), narrow=(1.0, 6.0), smooth_s=0.2, window_s=3.0, height=0.7, distance_s=0.4)


def test_detection_does_not_depend_on_how_an_entity_is_cut(spark):
    s = signal(spark)
    for noise in (1e-10, 0.05):
        got = []
        for rows in (1_000_000, 700):
            found, d = peaks.detect_beats(s, AXIS.with_(rows=rows), "x", 20.0, **BANDS, noise=noise)
            assert d.count() == s.count() and found.columns == d.columns == [*s.columns, "smoothed", "normalized"]
            got.append(found.orderBy("animal", "n").toPandas())
        a, b = got
        assert len(a) > 150 and a[["animal", "n"]].equals(b[["animal", "n"]])
        assert np.allclose(a[["smoothed", "normalized"]], b[["smoothed", "normalized"]], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("rows", [1_000_000, 250])
def test_chunks_with_their_own_parameters_equal_runs_of_their_own(spark, rows):
    s = signal(spark)
    at = lambda k: T0 + timedelta(seconds=30 * k)
    over = {0: None, 1: {"height": "1.4", "narrow_high": "5.0"}, 2: {"distance_s": "0.7", "smooth_s": "0.4", "enable_spike_removal": "0"}, 3: {"height": "no number", "max_height": "0.1"}, 4: None}
    chunks = spark.createDataFrame([(f"a{a}", at(k), at(k + 1), "gap" if (a, k) == (1, 0) else "pending", o) for a in range(2) for k, o in over.items()],
                                   "animal string, chunk_start timestamp, chunk_end timestamp, status string, params_override map<string,string>")
    base = {"broad_low": 0.5, "broad_high": 8.0, "narrow_low": 1.0, "narrow_high": 6.0, "smooth_s": 0.2, "window_s": 3.0, "height": 0.7, "distance_s": 0.4}
    got = peaks.detect_beats_by_chunk(s, AXIS.with_(rows=rows), "x", 20.0, chunks, base, 30.0).toPandas()
    want, before = [], 0
    for a in range(2):
        before = 0
        for k, o in over.items():
            if (a, k) == (1, 0) or k == 4:
                continue
            part = s.where((F.col("animal") == f"a{a}") & F.col("ts").between(at(k), at(k + 1)))
            own = {**base, **{n: float(v) for n, v in (o or {}).items() if v != "no number"}}
            p = {**peaks.BEAT_DEFAULTS, **own}
            found, d = peaks._detect(part, AXIS, "x", 20.0, p, peaks.band_reach(p, 20.0))
            f = found.toPandas()
            want += [(f"a{a}", k, n, i + before, round(z, 6), peaks.ACCEPTED if p["min_height"] <= sm <= p["max_height"] else peaks.REJECTED)
                     for n, i, z, sm in zip(f["n"], f["__idx"], f["normalized"], f["smoothed"])]
            before += part.count()
    mine = [(r.animal, round((r.chunk_start.tz_localize("UTC") - T0).total_seconds() / 30), r.n, r.refined_index, round(r.normalized, 6), r.key) for r in got.itertuples()]
    assert len(want) > 120 and sorted(mine) == sorted(want)
    assert {k for _, k, *_, key in mine if key == peaks.REJECTED} == {3}


@pytest.mark.parametrize("keep_later", [True, False])
def test_cleanup_of_whole_entities_and_in_passes(spark, keep_later):
    rng = np.random.default_rng(3)
    rows = []
    for a, n in (("a", 300), ("b", 3), ("c", 1), ("d", 120)):
        t = np.cumsum(np.where(rng.random(n) < 0.3, rng.random(n) * 0.4, 1.0 + rng.random(n) * 0.2))
        rows += [(a, T0 + timedelta(microseconds=int(x * 1e6)), i, None if i % 50 == 7 else float(rng.random())) for i, x in enumerate(t)]
    b = spark.createDataFrame(rows, "animal string, ts timestamp, n long, p double")
    whole, passes = (sorted((r["animal"], r["n"]) for r in peaks.model_cleanup(b, AXIS.with_(rows=k), "p", keep_later=keep_later).collect()) for k in (1_000, 2))
    assert whole == passes and 100 < len(whole) < 424


def test_levelling_of_whole_entities_and_by_operators(spark):
    rng = np.random.default_rng(4)
    rows = []
    for a in range(3):
        n = 900
        flat = np.repeat(rng.random(n // 30) < 0.5, 30) if a < 2 else np.zeros(n, bool)
        v = np.where(flat, 1.5 + a + np.linspace(0, 2, n), 40.0) + 0.1 * rng.normal(size=n)
        rows += [(f"a{a}", T0 + timedelta(seconds=i), i, None if i % 97 == 3 else float(v[i]), 0.0 if flat[i] else 1.0) for i in range(n)]
    s = spark.createDataFrame(rows, "animal string, ts timestamp, n long, x double, slope double")
    for least in (1, 10):
        a, b = (depth.level_surface(s, AXIS.with_(rows=k), "x", "slope", 0.5, 20, 5.0, min_chunks=least, bin_s=60.0).orderBy("animal", "n").toPandas() for k in (1_000, 10))
        assert a["depth_zoc"].notna().sum() > 2_000 and np.allclose(a[["depth_zoc", "offset"]], b[["depth_zoc", "offset"]], equal_nan=True)
        assert (a.loc[a["animal"] == "a2", "offset"] == 0).all() and (least > 1 or (a["offset"] != 0).any())
    found = islands.flat_chunks(s, AXIS, "x", "slope", 0.5, 20, 5.0)
    assert found.count() > 5


def test_strict_rate_of_whole_entities_and_by_joins(spark):
    rng = np.random.default_rng(8)
    rows = [(f"a{a}", T0 + timedelta(seconds=int(i)), k) for a in range(3) for k, i in enumerate(np.sort(rng.integers(0, 600, 500)))]
    s = spark.createDataFrame(rows, "animal string, ts timestamp, n long")
    beats = s.where("animal <> 'a2' AND n % 7 = 3")  # the last one has none
    spans = spark.createDataFrame([("a0", T0 + timedelta(seconds=x), T0 + timedelta(seconds=x + w)) for x, w in ((50, 40), (60, 5), (300, 1), (400, 0))], "animal string, start_ts timestamp, end_ts timestamp")
    got = [peaks.strict_rate(s, beats, AXIS.with_(rows=k), spans, spans.where("start_ts < '2024-01-01 00:01:00'"), 6.0, 3.0, 9.0, 60.0).orderBy("animal", "n").toPandas() for k in (1_000, 10)]
    assert 300 < got[0]["rate_nan"].notna().sum() < 1_000 and got[0]["rate_fixed"].notna().sum() > 900
    assert np.allclose(got[0][["rate_nan", "rate_fixed"]], got[1][["rate_nan", "rate_fixed"]], equal_nan=True)


def test_conflicts_of_wide_and_narrow_windows(spark):
    rng = np.random.default_rng(5)
    us = np.cumsum(rng.integers(1, 3_000_000, 400))
    b = spark.createDataFrame([("a", T0 + timedelta(microseconds=int(u)), i) for i, u in enumerate(us)], "animal string, ts timestamp, n long")
    rr, mid = np.diff(us) / 1e6, (us[1:] + us[:-1]) // 2
    for window in (8.0, 5_000.0):
        want = [i for i in range(len(rr)) if rr[i] < 0.5 * np.median(rr[np.abs(mid - mid[i]) <= window * 500_000])]
        got = sorted(r["n"] for r in peaks.conflict_pairs(b, AXIS.with_(width=20_000_000), 0.5, window).collect())
        assert got == want


def test_lags_by_fft_equal_shifted_correlations(spark):
    rng = np.random.default_rng(6)
    n = 2_500
    x = rng.normal(size=n).cumsum()
    y = np.roll(x, -7) + rng.normal(size=n)
    x[rng.random(n) < 0.1], y[rng.random(n) < 0.1] = np.nan, np.nan
    none = lambda v: None if np.isnan(v) else float(v)
    d = spark.createDataFrame([("a", T0 + timedelta(seconds=i), i, none(x[i]), none(y[i])) for i in range(n)], "animal string, ts timestamp, n long, x double, y double")
    for reach, rows in ((50, 600), (2_400, 600)):
        got = {r["lag"]: r for r in timebase.lag_curve(d, AXIS.with_(rows=rows), "x", "y", reach, 10).collect()}
        for lag in range(-reach, reach + 1, 1 if reach == 50 else 37):
            a, b = (x[lag:], y[:n - lag]) if lag >= 0 else (x[:lag], y[-lag:])
            ok = ~np.isnan(a) & ~np.isnan(b)
            if ok.sum() < 10:
                assert lag not in got
                continue
            assert got[lag]["pairs"] == ok.sum() and math.isclose(got[lag]["r"], np.corrcoef(a[ok], b[ok])[0, 1], rel_tol=1e-8, abs_tol=1e-9)
    flat = d.withColumn("y", F.lit(3.0))
    assert timebase.lag_curve(flat, AXIS, "x", "y", 3).where("r IS NOT NULL").count() == 0


def test_p_values(spark):
    table = [(12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (3.1692726726169513, 10, 0.01), (2.0422724563012373, 30, 0.05),
             (0.0, 5, 1.0), (1.0, 1, 0.5), (1.0, 2, 1 - math.sqrt(1 / 3))]
    d = spark.createDataFrame(table, "t double, df long, p double")
    for r in d.withColumn("got", t_two_sided(F.col("t"), F.col("df"))).collect():
        assert math.isclose(r["got"], r["p"], rel_tol=1e-10), r

    def closed(r, n):  # finite sums over powers of the cosine
        v, c = n - 2, 1 - r * r
        if v % 2 == 0:
            return 1 - r * sum(math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / math.sqrt(math.pi) * c ** k for k in range(v // 2))
        return 1 - 2 / math.pi * (math.asin(r) + r * math.sqrt(c) * sum(math.exp(math.lgamma(k + 1) - math.lgamma(k + 1.5)) * math.sqrt(math.pi) / 2 * c ** k for k in range((v - 1) // 2)))

    pairs = [(r, n) for r in (0.01, 0.2, 0.5, 0.8) for n in (3, 4, 5, 12, 43, 101, 600, 5_001)]
    got = spark.createDataFrame(pairs, "r double, n long").withColumn("p", correlation_p(-F.col("r"), F.col("n"))).collect()
    for row in got:
        assert math.isclose(row["p"], closed(row["r"], row["n"]), rel_tol=1e-8, abs_tol=1e-11)
    edge = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.3, 2), (None, 9)], "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect()
    assert [r["p"] for r in edge] == [0.0, 0.0, 1.0, None]


@pytest.mark.parametrize("n, span", [(1, 1.0), (60, 300.0), (900, 40.0), (1_500, 2.0)])
def test_fast_gauss_sums_equal_all_pairs(n, span):
    from driftline.functions import dsp
    rng = np.random.default_rng(n)
    t, w = np.sort(rng.random(n) * span), rng.random((2, n))
    want = w @ np.exp(-0.5 * (t[:, None] - t) ** 2)
    assert np.allclose(dsp.gauss_sums(t, w, 8.0), want, rtol=1e-11, atol=0)


def test_correlations_of_many_columns(spark):
    from driftline.operators import features
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 140)) + 1_000.0
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 7.0
    names = [f"f{i}" for i in range(140)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in features.correlation_matrix(df, names).collect()}
    assert len(got) == 140 * 139 // 2 and got["f0", "f5"] is None and got["f5", "f139"] is None
    for i, j in ((0, 1), (0, 139), (3, 130), (127, 128), (138, 139)):
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert math.isclose(got[names[i], names[j]], np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs_tol=1e-10)
