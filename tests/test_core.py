"""Chunked scans, runs, folds and quantiles against plain Python on random data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.core.axis import Axis, fit_axis
from driftline.core.fold import chunked_fold
from driftline.core.runs import find_runs, label_runs
from driftline.core.scan import scan
from driftline.core.stats import modes, quantiles
from driftline.operators import folds, learn, peaks, rolling
from driftline.operators.peaks import select_peaks

AX = Axis(("k",), ("t",), width=7, rows=11)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(3):
        t = np.sort(rng.choice(400, 120, replace=False))
        v = rng.integers(0, 4, 120).astype(float)
        rows += [(k, int(a), None if rng.random() < 0.2 else float(b)) for a, b in zip(t, v)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    return spark.createDataFrame(rows, "k bigint, t bigint, v double"), pdf


def test_scan_matches_pandas(data):
    df, pdf = data
    got = scan(df, AX, prev={"p": "v"}, nxt={"n": "v"}, run_sum={"s": "t"}, run_max={"m": "v"}, ffill={"f": "v"}, bfill={"b": "v"},
               max_before={"mb": "v"}, index="i").toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.groupby("k")
    want = pdf.assign(p=g.v.shift(1), n=g.v.shift(-1), s=g.t.cumsum(), f=g.v.ffill(), b=g.v.bfill(), i=g.cumcount())
    want["m"] = g.v.transform(lambda x: x.expanding().max())
    want["mb"] = g.v.transform(lambda x: x.expanding().max().shift(1))
    for c in ("p", "n", "s", "m", "mb", "f", "b", "i"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_runs_stitched_over_chunks(data):
    df, pdf = data
    got = find_runs(df, AX, "v", {"st": ("sum", "t"), "fi": ("first", "t")}, with_index=True).toPandas().sort_values(["k", "start_ts"]).reset_index(drop=True)
    x = pdf.assign(w=pdf.v.fillna(-1))
    gid = ((x.w != x.w.shift()) | (x.k != x.k.shift())).cumsum()
    x = x.assign(i=x.groupby("k").cumcount())
    want = x.groupby(gid).agg(k=("k", "first"), a=("t", "min"), b=("t", "max"), n=("t", "size"), s=("t", "sum"), i0=("i", "min"), i1=("i", "max"))
    for g, w in (("start_ts", "a"), ("end_ts", "b"), ("n", "n"), ("st", "s"), ("fi", "a"), ("start_index", "i0"), ("end_index", "i1")):
        assert got[g].tolist() == want[w].tolist(), g
    rows = label_runs(df, AX, "v").toPandas().sort_values(["k", "t"])
    assert rows.run_start.tolist() == x.groupby(gid).t.transform("min").tolist()
    assert rows.run_end.tolist() == x.groupby(gid).t.transform("max").tolist()


def test_fold_equals_one_pass(data):
    df, pdf = data

    def fold(cols, state):
        last, out = (state[0] if state else None), []
        for t in cols["t"]:
            ok = last is None or t - last >= 25
            out.append(ok)
            last = t if ok else last
        return out, None if last is None else [last]

    got = chunked_fold(df, AX.with_(width=100), ["t"], fold, "keep").where("keep").toPandas()
    for k, g in pdf.groupby("k"):
        last, want = None, []
        for t in g.t:
            if last is None or t - last >= 25:
                want.append(t)
                last = t
        assert sorted(got[got.k == k].t) == want


@pytest.mark.parametrize("few", [0, 4_000])
def test_quantiles_exact_even_when_narrowed(spark, monkeypatch, few):
    monkeypatch.setattr("driftline.core.stats.FEW", few)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 30_000), "t": np.round(rng.lognormal(size=30_000), 2)})
    d = spark.createDataFrame(pdf).withColumn("x", F.col("t") * 1.5)
    got = quantiles(d, ["k"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, q in (("lo", 0.1), ("mid", 0.5), ("hi", 0.93)):
            assert got.loc[k, n] == pytest.approx(np.quantile(g.t * 1.5, q))


def test_median_between_two_frequent_values(spark):
    d = spark.range(400).select(F.lit(0).alias("k"), (F.col("id") % 2).alias("x"))
    assert quantiles(d, ["k"], "x", {"m": 0.5}).first()["m"] == 0.5


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("a", 1), ("a", 1), ("a", 3)], "k string, v int")
    assert modes(df, ["k"], "v", "m").first()["m"] == 1


def test_rolling_sums_cross_chunks(data):
    df, pdf = data
    got = rolling.rolling_mean(df, AX, 9, ["v"], 2).toPandas().sort_values(["k", "t"])
    want = pdf.groupby("k").v.transform(lambda x: x.rolling(9, center=True, min_periods=2).mean())
    np.testing.assert_allclose(got.v_mean.astype(float), want, equal_nan=True)


def test_peaks_need_no_whole_recording(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=600), 1)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k bigint, t bigint, v double")
    got = sorted(r["t"] for r in select_peaks(df, Axis(("k",), ("t",), width=50, rows=40), "v", 0.2, 6, halo=8).collect())
    edge = np.flatnonzero(np.diff(x) != 0)
    first, last = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    val = x[first]
    cand = [(f + l) // 2 for j, (f, l) in enumerate(zip(first, last)) if 0 < j < len(val) - 1 and val[j - 1] < val[j] > val[j + 1] and val[j] >= 0.2]
    kept = []
    for c in sorted(cand, key=lambda c: (x[c], c), reverse=True):
        if all(abs(c - q) >= 6 for q in kept):
            kept.append(c)
    assert got == sorted(kept)


def test_axis_narrows_on_a_burst(spark):
    rows = [(0, i) for i in range(2000)] + [(1, i * 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, t bigint")
    ax = fit_axis(df, ["k"], ["t"], target_rows=100, probe_width=100_000)
    fullest = df.groupBy("k", ax.chunk(df)).count().agg(F.max("count")).first()[0]
    assert fullest <= 250


def test_greedy_match_counts(spark):
    truth, found = [0, 10, 20, 30, 31], [1, 9, 25, 30, 50]
    mk = lambda ts: spark.createDataFrame([(0, t) for t in ts], "k bigint, s bigint").select("k", F.timestamp_seconds("s").alias("t"))
    m = folds.match_in_order(mk(truth), mk(found), Axis(("k",), ("t",), width=4_000_000), 2.0)
    r = folds.match_scores(m, ["k"]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (3, 2, 2)


def test_filters_do_not_depend_on_chunks_with_nulls(spark):
    rng = np.random.default_rng(1)
    v = [None if i in (100, 101, 700) else float(x) for i, x in enumerate(rng.normal(size=1_000))]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k bigint, t bigint, v double")
    out = []
    for rows in (150, 100_000):
        ax = Axis(("k",), ("t",), width=10_000, rows=rows)
        b = rolling.bartlett_smooth(df, ax, 7, "v", "s").orderBy("t").toPandas()["s"]
        w = rolling.butterworth(df, ax, 10.0, (0.5, 2.0), {"w": "v"}).orderBy("t").toPandas()["w"]
        out.append((b, w))
    for a, b in zip(*out):
        np.testing.assert_allclose(a.astype(float), b.astype(float), atol=1e-8)
    assert out[0][0].isna().sum() == 8 + 7 and out[0][1].isna().sum() == 3


def test_cleanup_works_off_a_long_chain(spark):
    t = np.cumsum([1.0] * 1_000 + [0.5] * 500)
    df = spark.createDataFrame([(0, i, float(x), 0.5) for i, x in enumerate(t)], "k bigint, id bigint, s double, p double").select(
        "k", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("ts"), "p")
    got = peaks.model_cleanup(df, Axis(("k",), ("ts", "id"), width=100_000_000), "p").orderBy("ts").select(F.unix_micros("ts")).toPandas().iloc[:, 0] / 1e6
    rr = np.diff(got)
    assert (rr >= 0.75 * np.median(rr)).all() and not (rr[:-1] > 1.8 * rr[1:]).any() and len(got) < 1_010


def test_split_holds_its_share_in_every_stratum(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") < 2_900, "a").otherwise("b").alias("s"))
    got = {r["s"]: r["n"] for r in learn.stratified_split(df, "id", "s", 0.4).groupBy("s").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()}
    assert abs(got["a"] - 1_160) <= 2 and abs(got["b"] - 40) <= 1
    folds_ = learn.group_folds(df.withColumn("g", F.col("id") % 7), "g", 5).groupBy("fold").agg(F.countDistinct("g").alias("n")).collect()
    assert len(folds_) == 5 and sum(r["n"] for r in folds_) == 7
