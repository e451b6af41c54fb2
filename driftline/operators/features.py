"""Epoch and window features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..core.facts import with_facts
from ..core.axis import Axis
from ..core.scan import scan
from ..functions import dsp


def epochs(df: DataFrame, axis: Axis, column: str, fs: float, window_s: float, step_s: float) -> DataFrame:
    """Full sliding epochs of a regular signal as arrays, stamped at their centre."""
    from .rolling import frames
    f = frames(df, axis, column, int(window_s * fs), int(step_s * fs))
    return f.withColumn("centre_ts", F.timestamp_micros(F.unix_micros("frame_start") + int(window_s * 500_000)))


# Bands in Hz.
HRV_BANDS = [(0.0033, 0.04, "vlf"), (0.04, 0.15, "lf"), (0.15, 0.4, "hf")]
EEG_BANDS = [(0.4, 1, "sdelta"), (1, 4, "fdelta"), (4, 8, "theta"), (8, 12, "alpha"), (12, 16, "sigma"), (16, 30, "beta")]
EEG_BROAD = (0.4, 30.0)

_SHAPE = ["mean", "std", "iqr", "skew", "kurt", "nzc", "hmob", "hcomp", "perm", "higuchi", "petrosian"]


def _shape(x: np.ndarray) -> dict[str, np.ndarray]:
    q = np.percentile(x, [25, 75], axis=1)
    c = x - x.mean(1, keepdims=True)
    m2 = (c ** 2).mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        skew, kurt = (c ** 3).mean(1) / m2 ** 1.5, (c ** 4).mean(1) / m2 ** 2 - 3
    mob, comp = dsp.hjorth(x)
    return {"mean": x.mean(1), "std": x.std(1, ddof=1), "iqr": q[1] - q[0], "skew": skew, "kurt": kurt, "nzc": dsp.zero_crossings(x).astype(float),
            "hmob": mob, "hcomp": comp, "perm": dsp.permutation_entropy(x), "higuchi": dsp.higuchi(x), "petrosian": dsp.petrosian(x)}


def epoch_features(ep: DataFrame, fs: float, bands: list[tuple[float, float, str]], welch_s: float, broad: tuple[float, float] | None = None) -> DataFrame:
    """Shape, complexity and band-power features of epochs: one Arrow batch of epochs at a time, any number of tasks."""
    names = [*_SHAPE, *[b for _, _, b in bands], "abspow"]
    schema = ", ".join(f"{n} double" for n in names)
    nper = int(fs * welch_s)
    lo, hi = broad or (bands[0][0], bands[-1][1])

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        x = np.stack(s.to_numpy()).astype(float)
        out = _shape(x)
        freqs, psd = dsp.welch(x, fs, nper)
        for a, b, n in bands:
            out[n] = dsp.band_power(freqs, psd, a, b)
        out["abspow"] = dsp.band_power(freqs, psd, lo, hi)
        return pd.DataFrame(out)[names]

    return ep.withColumn("__f", run("samples")).select(*[c for c in ep.columns if c != "samples"], "__f.*")


def hrv_ratios(df: DataFrame) -> DataFrame:
    """Low/high ratio, total, percentages and normalised units of heart-rate bands."""
    tot = F.col("vlf") + F.col("lf") + F.col("hf")
    lh = F.col("lf") + F.col("hf")
    return df.withColumns({"lf_hf": F.try_divide("lf", "hf"), "p_total": tot, **{f"{b}_perc": F.try_divide(F.col(b) * 100, tot) for b in ("vlf", "lf", "hf")},
                           "lf_nu": F.try_divide(F.col("lf") * 100, lh), "hf_nu": F.try_divide(F.col("hf") * 100, lh)})


def eeg_ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    """Band ratios, relative powers and the deviation of each band over the entity's epochs."""
    delta = F.col("sdelta") + F.col("fdelta")
    bands = [b for _, _, b in EEG_BANDS]
    sd = df.groupBy(*keys).agg(*[F.stddev_pop(b).alias(f"{b}_std") for b in bands])
    return df.join(sd, keys).withColumns({"dt": F.try_divide(delta, "theta"), "ds": F.try_divide(delta, "sigma"), "db": F.try_divide(delta, "beta"),
                                          "at": F.try_divide("alpha", "theta"), **{f"{b}_relative": F.try_divide(b, "abspow") for b in bands}})


def describe_windows(df: DataFrame, axis: Axis, column: str, window_s: float) -> DataFrame:
    """Tumbling-window statistics in SQL: mean, std, IQR, skewness, kurtosis, zero crossings, Hjorth parameters.

    Differences are taken along the axis and kept within their window; everything else is one aggregate.
    """
    from .timebase import bucket
    keys = list(axis.keys)
    d = df.select(*keys, *axis.order, F.col(column).cast("double").alias("v")).withColumn("window_start", bucket(axis.ts, window_s))
    d = scan(d, axis, prev={"__p": "v", "__pw": "window_start"})
    d = d.withColumn("__d1", F.when(F.col("__pw") == F.col("window_start"), F.col("v") - F.col("__p")))
    d = scan(d, axis, prev={"__pd": "__d1"}).withColumn("__d2", F.when(F.col("__pw") == F.col("window_start"), F.col("__d1") - F.col("__pd")))
    zc = F.when(F.col("__d1").isNotNull() & ((F.col("v") < 0) != (F.col("__p") < 0)), 1)
    g = d.groupBy(*keys, "window_start").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"),
        F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), F.count(zc).alias("zero_crossings"),
        F.var_pop("v").alias("__v0"), F.var_pop("__d1").alias("__v1"), F.var_pop("__d2").alias("__v2"))
    mob = F.sqrt(F.try_divide("__v1", "__v0"))
    return g.withColumns({"hjorth_mobility": mob, "hjorth_complexity": F.try_divide(F.sqrt(F.try_divide("__v2", "__v1")), mob)}).drop("__v0", "__v1", "__v2")


# Statistics per feature set.
FEATURE_SETS = {"minimal": ["mean", "std"], "medium": ["mean", "std", "min", "max", "range"],
                "full": ["mean", "std", "min", "max", "range", "skew", "kurt", "sum"]}
_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "range": lambda c: F.max(c) - F.min(c), "skew": F.skewness, "kurt": F.kurtosis, "sum": F.sum}


def channel_features(df: DataFrame, axis: Axis, channels: list[str], window_s: float, transforms: list[str] = ("raw",), feature_set: str = "medium",
                     min_samples: int = 1, smooth_rows: int = 5) -> DataFrame:
    """Tumbling-window features per channel and transform (raw, diff, smoothed); sparse windows are dropped."""
    from .rolling import rolling_mean
    from .timebase import bucket
    keys = list(axis.keys)
    d = df.select(*keys, *axis.order, *[F.col(c).cast("double").alias(c) for c in channels])
    names = list(channels) if "raw" in transforms else []
    if "diff" in transforms:
        d = scan(d, axis, prev={f"__p_{c}": c for c in channels}).withColumns({f"{c}_diff": F.col(c) - F.col(f"__p_{c}") for c in channels})
        names += [f"{c}_diff" for c in channels]
    if "smoothed" in transforms:
        d = rolling_mean(d, axis, smooth_rows, list(channels), 1, "_smoothed")
        names += [f"{c}_smoothed" for c in channels]
    return d.groupBy(*keys, bucket(axis.ts, window_s).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_samples"), *[_STATS[s](F.col(c)).alias(f"{c}_{s}") for c in names for s in FEATURE_SETS[feature_set]]
    ).where(F.col("n_samples") >= min_samples).withColumn("window_end", F.timestamp_micros(F.unix_micros("window_start") + int(window_s * 1e6)))


def cap_windows(df: DataFrame, keys: list[str], id_cols: list[str], per_entity: int, seed: int = 42) -> DataFrame:
    """The requested number of windows per entity, chosen by a seeded hash (this is the sampling feature of a run).

    The hash is the axis of a chunked scan, so even one entity's windows are ranked in pieces.
    """
    d = df.withColumn("__h", F.xxhash64(F.lit(seed), *id_cols))
    ax = Axis(tuple(keys), ("__h", *id_cols), width=2 ** 64 // 4096)
    return scan(d, ax, index="__r").where(F.col("__r") < per_entity).drop("__h", "__r")


def z_normalise(df: DataFrame, columns: list[str], level: list[str]) -> DataFrame:
    """Z-scores within a level (entity, dataset or, with no keys, all); constant columns become 0."""
    s = df.groupBy(*level).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    j = df.join(s, level) if level else with_facts(df, s)
    return j.withColumns({f"{c}_z": F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(
        F.when(F.col(c).isNotNull(), 0.0)) for c in columns}).drop(*[f"__{a}_{c}" for a in "ms" for c in columns])


#: Columns of a block of the matrix: a block pair's sums are one row of a partition.
BLOCK = 128


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlations of feature columns over the rows that have both: rows (a, b, r), a before b; null where either
    is constant.

    One pass: each partition takes matrix products of its rows, block by block of columns, with a mask of what is known, and the
    blocks' sums are added up in two steps. Columns are centred first.
    """
    mean = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([mean[f"m{i}"] or 0.0 for i in range(len(columns))])
    spread = np.array([mean[f"v{i}"] or 0.0 for i in range(len(columns))])
    blocks = [(i, min(i + BLOCK, len(columns))) for i in range(0, len(columns), BLOCK)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    schema = "i int, j int, part int, sums binary"

    def products(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns], 1) - centre
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            for i, j in pairs:
                (p, q), (r, s) = blocks[i], blocks[j]
                u, w, mu, mw = x[:, p:q], x[:, r:s], m[:, p:q], m[:, r:s]
                got = np.stack([mu.T @ mw, u.T @ mw, mu.T @ w, (u * u).T @ mw, mu.T @ (w * w), u.T @ w])
                total[i, j] = total[i, j] + got if (i, j) in total else got
        part = TaskContext.get().partitionId() % 64
        for (i, j), t in total.items():
            yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "part": part, "sums": t.tobytes()}], schema=arrow)

    arrow = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])

    def added(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in t["sums"]], axis=0)
        return t.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    def correlated(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        (p, q), (r, s) = blocks[i], blocks[j]
        n, sx, sy, sxx, syy, sxy = np.sum([np.frombuffer(x.as_py()) for x in t["sums"]], axis=0).reshape(6, q - p, s - r)
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        ok = (vx > 1e-13 * n * n * spread[p:q, None]) & (vy > 1e-13 * n * n * spread[None, r:s])
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(ok, np.clip((n * sxy - sx * sy) / np.sqrt(vx * vy), -1, 1), np.nan)
        at = [(k, m) for k in range(q - p) for m in range(s - r) if p + k < r + m]
        return pa.table({"a": pa.array([columns[p + k] for k, _ in at], pa.string()), "b": pa.array([columns[r + m] for _, m in at], pa.string()),
                         "r": pa.array([v[k, m] for k, m in at], pa.float64(), from_pandas=True)})

    partial = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(products, schema)
    return partial.groupBy("i", "j", "part").applyInArrow(added, schema).groupBy("i", "j").applyInArrow(correlated, "a string, b string, r double")


def drop_correlated(matrix: DataFrame, columns: list[str], limit: float = 0.8) -> tuple[list[str], list[str]]:
    """Columns kept and dropped: of each pair above the limit the later one goes. The matrix is columns², read on the driver."""
    bad = {(r["a"], r["b"]) for r in matrix.where(F.abs("r") > limit).collect()}
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in bad for k in kept):
            kept.append(c)
    return kept, [c for c in columns if c not in kept]
