"""Rolling windows and filters on ordered signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core.axis import Axis
from ..core.halo import halo_apply
from ..core.order import SlidingOrder
from ..core.scan import CORE, HALO, IDX, drop_halo, halo_rows, row_frame, scan
from ..core.stage import stage
from ..core.stats import median
from ..functions import dsp
from ..schema import seconds_between


def rolling_sums(df: DataFrame, axis: Axis, before: int, after: int, columns: list[str], squares: bool = False) -> DataFrame:
    """Per row: ``__cnt_c``, ``__sum_c`` (and ``__sq_c``) over rows ``[i-before, i+after]``; keeps ``IDX``.

    Wide frames would be re-read for every row, so each is a difference of two running sums inside a halo
    chunk: linear in the rows whatever the width.
    """
    return frame_sums(halo_rows(df, axis, before, after), axis, before, after, columns, squares).where(CORE).drop(HALO, CORE)


def frame_sums(h: DataFrame, axis: Axis, before: int, after: int, columns: list[str], squares: bool = False) -> DataFrame:
    """``rolling_sums`` on rows in halo chunks, which stay there; right where the chunk holds the whole frame."""
    w = W.partitionBy(*axis.keys, HALO).orderBy(IDX)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    parts = {}
    for c in columns:
        v = F.col(c).cast("double")
        parts[f"cnt_{c}"] = v.isNotNull().cast("bigint")
        parts[f"sum_{c}"] = F.coalesce(v, F.lit(0.0))
        if squares:
            parts[f"sq_{c}"] = F.coalesce(v * v, F.lit(0.0))
    h = h.withColumns({f"__r_{n}": F.sum(e).over(run) for n, e in parts.items()})
    whole = W.partitionBy(*axis.keys, HALO)
    top = lambda c: F.coalesce(F.lead(c, after).over(w), F.max_by(c, F.col(IDX)).over(whole)) if after else F.col(c)
    low = lambda c: F.coalesce(F.lag(c, before + 1).over(w), F.lit(0))
    return h.withColumns({f"__{n}": top(f"__r_{n}") - low(f"__r_{n}") for n in parts}).drop(*[f"__r_{n}" for n in parts])


def rolling_mean(df: DataFrame, axis: Axis, n: int, columns: list[str], min_periods: int = 1, suffix: str = "_mean") -> DataFrame:
    """Centred mean over n rows (odd), null below ``min_periods`` known values."""
    half = n // 2
    s = rolling_sums(df, axis, half, half, columns)
    return s.select(*df.columns, *[F.when(F.col(f"__cnt_{c}") >= min_periods, F.col(f"__sum_{c}") / F.col(f"__cnt_{c}")).alias(c + suffix)
                                   for c in columns])


def static_dynamic(df: DataFrame, axis: Axis, n: int, xyz: list[str], min_periods: int = 1) -> DataFrame:
    """Split each axis into its rolling mean (static) and the rest (dynamic)."""
    s = rolling_mean(df, axis, n, xyz, min_periods, "_static")
    return s.withColumns({f"{c}_dynamic": F.col(c) - F.col(f"{c}_static") for c in xyz})


def odba(df: DataFrame, axis: Axis, n: int, xyz: list[str], method: str = "vedba", out: str = "odba") -> DataFrame:
    """Dynamic body acceleration: norm of the signal minus its moving average, edges padded with the end values."""
    if method not in ("wilson", "vedba"):
        raise ValueError(f"unknown method {method}")
    half = n // 2
    n = 2 * half + 1
    keys = list(axis.keys)
    at = F.struct(*axis.order)
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__N"), *[F.min_by(c, at).alias(f"__first_{c}") for c in xyz],
                                 *[F.max_by(c, at).alias(f"__last_{c}") for c in xyz])
    s = rolling_sums(df, axis, half, half, xyz).join(ends, keys)
    pre = F.greatest(F.lit(half) - F.col(IDX), F.lit(0))
    post = F.greatest(F.col(IDX) + half - (F.col("__N") - 1), F.lit(0))
    rest = [F.col(c) - (F.col(f"__sum_{c}") + pre * F.col(f"__first_{c}") + post * F.col(f"__last_{c}")) / n for c in xyz]
    norm = F.sqrt(sum((r * r for r in rest), F.lit(0.0))) if method == "vedba" else sum((F.abs(r) for r in rest), F.lit(0.0))
    return s.select(*df.columns, norm.alias(out))


def odba_fir(df: DataFrame, axis: Axis, fs: float, fh: float, xyz: list[str], out: str = "odba") -> DataFrame:
    """Dynamic body acceleration by a zero-phase FIR high-pass: the taps are run forward and backward. Rows within the taps'
    reach of a null are null."""
    h = dsp.fir_highpass(4 * int(fs / fh), fh / (fs / 2))
    both = np.convolve(h, h[::-1])
    centre = len(h) - 1
    pad = 3 * len(h)

    def run(x, at_start, at_end):
        total = 0.0
        for c in xyz:
            v = x[c]
            p = min(pad, len(v) - 1)
            a = 2 * v[0] - v[p:0:-1] if at_start else v[:0]
            b = 2 * v[-1] - v[-2:-2 - p:-1] if at_end else v[:0]
            y = dsp.fir_centred(np.concatenate([a, v, b]), both, centre)[len(a): len(a) + len(v)]
            total = total + y ** 2
        return {out: np.sqrt(total)}

    return halo_apply(df, axis, pad + centre, pad + centre, run, xyz, {out: "double"})


def activity_index(df: DataFrame, axis: Axis, fs_hz: float, xyz: list[str], window_hours: float = 1.0, method: str = "vedba") -> DataFrame:
    """Norm of the dynamic part in hour-wide centred windows; rows with no known axis stay null."""
    n = int(round(window_hours * 3600 * fs_hz))
    if n < 3:
        raise ValueError(f"window of {window_hours} h holds only {n} samples at {fs_hz} Hz; need at least 3")
    n += 1 - n % 2
    s = static_dynamic(df, axis, n, xyz, max(3, n // 10))
    dyn = [F.col(f"{c}_dynamic") for c in xyz]
    z = [F.coalesce(v, F.lit(0.0)) for v in dyn]
    norm = F.sqrt(sum((v * v for v in z), F.lit(0.0))) if method == "vedba" else sum((F.abs(v) for v in z), F.lit(0.0))
    return s.withColumn("activity", F.when(F.coalesce(*dyn).isNotNull(), norm))


def running_median(df: DataFrame, axis: Axis, kernel: int, column: str, out: str) -> DataFrame:
    """Median over an odd number of rows; nulls and what lies beyond the ends of the recording count as zeros.

    A row costs the same whatever the kernel: chunks are indexed by rank (``core.order``).
    """
    half = kernel // 2

    def run(x, at_start, at_end):
        v = np.where(np.isnan(x[column]), 0.0, x[column])
        w = np.concatenate([np.zeros(half if at_start else 0), v, np.zeros(half if at_end else 0)])
        i = np.arange(len(v)) + (half if at_start else 0)
        lo, hi = np.maximum(i - half, 0), np.minimum(i + half + 1, len(w))
        return {out: SlidingOrder(w).kth(lo, hi, (hi - lo) // 2)}

    return halo_apply(df, axis, half, half, run, [column], {out: "double"})


def gradient(df: DataFrame, axis: Axis, columns: dict[str, str]) -> DataFrame:
    """Central differences per row, one-sided at the ends; output -> column."""
    s = scan(df, axis, prev={f"__p_{o}": c for o, c in columns.items()}, nxt={f"__n_{o}": c for o, c in columns.items()})
    ends = lambda o, c: F.coalesce(
        (F.col(f"__n_{o}") - F.col(f"__p_{o}")) / 2, F.col(f"__n_{o}") - F.col(c), F.col(c) - F.col(f"__p_{o}"))
    return s.withColumns({o: ends(o, c) for o, c in columns.items()}).select(*df.columns, *columns)


def frame_gradient(h: DataFrame, axis: Axis, column: str) -> Column:
    """``gradient`` of a column on rows in halo chunks; right where the chunk holds both neighbours."""
    w = W.partitionBy(*axis.keys, HALO).orderBy(IDX)
    p, n = F.lag(column).over(w), F.lead(column).over(w)
    return F.coalesce((n - p) / 2, n - F.col(column), F.col(column) - p)


def local_z(df: DataFrame, axis: Axis, window: int, column: str, out: str, noise: float = 1e-10) -> DataFrame:
    """Local z-score over rows ``[i-h, i+h)`` with a floor under the deviation.

    Floors up to 1e-6 are absolute, below 1 a fraction of the entity's deviation, from 1 absolute again.
    """
    half = max(1, window // 2)
    keys = list(axis.keys)
    g = df.groupBy(*keys).agg(F.stddev_pop(column).alias("__g"), F.avg(column).alias("__mu"))
    gs = F.when(F.col("__g") > 0, F.col("__g")).otherwise(F.lit(1.0))
    floor = F.greatest(F.lit(noise) * gs if 1e-6 < noise < 1 else F.lit(float(noise)), F.lit(1e-12))
    d = df.join(g, keys).withColumn("__x", F.col(column) - F.col("__mu"))  # centred, so squares do not cancel
    s = rolling_sums(d, axis, half, half - 1, ["__x"], squares=True)
    mu = F.col("__sum___x") / F.col("__cnt___x")
    var = F.greatest(F.col("__sq___x") / F.col("__cnt___x") - mu * mu, F.lit(0.0))
    return s.withColumn(out, (F.col("__x") - mu) / F.greatest(F.sqrt(var), floor)).select(*df.columns, out)


def remove_spikes(df: DataFrame, keys: list[str], column: str, out: str, threshold: float = 400.0) -> DataFrame:
    """Replace values further than ``threshold`` median absolute deviations from the median by the median.

    Medians and deviations, a row per entity, are written: in one plan, small tables are broadcast and one task holds the sorts and
    hash tables of both medians at once.
    """
    med = stage(median(df, keys, column, "__med"))
    d = df.join(med, keys)
    mad = stage(median(d.withColumn("__dev", F.abs(F.col(column) - F.col("__med"))), keys, "__dev", "__mad"))
    return d.join(mad, keys).withColumn(out, F.when(
        F.abs(F.col(column) - F.col("__med")) > F.lit(threshold) * F.col("__mad"), F.col("__med")).otherwise(F.col(column))).drop("__med", "__mad")


def bartlett_smooth(df: DataFrame, axis: Axis, n: int, column: str, out: str) -> DataFrame:
    """Triangular smoothing with normalised weights, zeros beyond the ends."""
    w = np.bartlett(n)
    w = w / w.sum()
    centre = (n - 1) // 2
    return halo_apply(df, axis, n, n, lambda x, a, b: {out: dsp.fir_centred(x[column], w, centre)}, [column], {out: "double"})


def butterworth(df: DataFrame, axis: Axis, fs: float, cut: tuple[float, ...], columns: dict[str, str], order: int = 2) -> DataFrame:
    """Zero-phase Butterworth filter (low-pass for one cutoff, band-pass for two); output -> column.

    The halo is as long as the impulse response down to 1e-10, so chunk edges leave no trace. A null splits the
    recording: each stretch between nulls is filtered by itself.
    """
    if max(cut) >= fs / 2:
        raise ValueError(f"cutoff {max(cut)} Hz is not below half the rate {fs} Hz")
    r = dsp.reach(order, cut, fs)

    def run(x, at_start, at_end):
        return {o: dsp.zero_phase_between_nulls(x[c], order, cut, fs, at_start, at_end) for o, c in columns.items()}

    return halo_apply(df, axis, 2 * r, 2 * r, run, list(columns.values()), {o: "double" for o in columns})


def decimate(df: DataFrame, axis: Axis, q: int, columns: dict[str, str]) -> DataFrame:
    """Anti-aliased decimation by an integer factor: FIR low-pass of 20q+1 taps, then every q-th row."""
    h = dsp.fir_lowpass(20 * q + 1, 1.0 / q)
    run = lambda x, a, b: {o: dsp.fir_centred(x[c], h, 10 * q) for o, c in columns.items()}
    d = halo_apply(scan(df, axis, index="__di"), axis, 10 * q, 10 * q, run, list(columns.values()), {o: "double" for o in columns})
    return d.where(F.col("__di") % q == 0).drop("__di")


def rolling_mean_std(df: DataFrame, axis: Axis, window: int, step: int, column: str) -> DataFrame:
    """Mean and population deviation over rows ``[i-w/2, i+w/2)`` at every ``step``-th row, full windows only."""
    half = window // 2
    keys = list(axis.keys)
    g = df.groupBy(*keys).agg(F.avg(column).alias("__mu"))
    d = df.join(g, keys).withColumn("__x", F.col(column) - F.col("__mu"))
    s = rolling_sums(d, axis, half, half - 1, ["__x"], squares=True).where(F.col(IDX) % step == 0)
    n = F.col("__cnt___x")
    mu = F.col("__sum___x") / n
    full = n == 2 * half
    return s.withColumns({"rolling_mean": F.when(full, mu + F.col("__mu")),
                          "rolling_std": F.when(full, F.sqrt(F.greatest(F.col("__sq___x") / n - mu * mu, F.lit(0.0))))
                          }).select(*df.columns, "rolling_mean", "rolling_std")


def norm_jerk(df: DataFrame, axis: Axis, xyz: list[str], fs: float, out: str = "jerk") -> DataFrame:
    """Norm of the sample-to-sample change times the rate; 0 on the first sample."""
    s = scan(df, axis, prev={f"__p_{c}": c for c in xyz})
    n = F.sqrt(sum(((F.col(c) - F.col(f"__p_{c}")) ** 2 for c in xyz), F.lit(0.0))) * fs
    return s.withColumn(out, F.coalesce(n, F.lit(0.0))).select(*df.columns, out)


def travelled(df: DataFrame, axis: Axis, speed: str, moving: Column, out: str = "distance") -> DataFrame:
    """Dead-reckoned distance: running sum of speed × elapsed seconds while moving."""
    s = scan(df, axis, prev={"__p": axis.ts})
    step = F.when(F.coalesce(moving, F.lit(False)), F.col(speed) * seconds_between("__p", axis.ts)).otherwise(0.0)
    s = s.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return scan(s, axis, run_sum={out: "__step"}).drop("__p", "__step")


def frames(df: DataFrame, axis: Axis, column: str, nper: int, hop: int) -> DataFrame:
    """Overlapping frames of ``nper`` rows every ``hop`` rows as arrays; incomplete frames are left out."""
    keys = list(axis.keys)
    s = scan(df.select(*keys, *axis.order, column), axis, index=IDX)
    lo = F.greatest(F.floor((F.col(IDX) - nper) / hop) + 1, F.lit(0))
    f = s.withColumn("frame", F.explode(F.sequence(lo, F.floor(F.col(IDX) / hop))))
    g = f.groupBy(*keys, "frame").agg(
        F.min(axis.ts).alias("frame_start"), F.count(F.lit(1)).alias("__n"),
        F.transform(F.array_sort(F.collect_list(F.struct(IDX, F.col(column).cast("double").alias("v")))), lambda x: x["v"]).alias("samples"))
    return g.where(F.col("__n") == nper).drop("__n")


def spectrogram(df: DataFrame, axis: Axis, column: str, fs: float, nper: int, overlap: float = 0.5,
                band: tuple[float, float] | None = None) -> DataFrame:
    """Short-time power in dB relative to the entity's maximum, one row per frame with frequency and dB arrays.

    Nulls become the entity mean; values below 1e-5 of the maximum are floored.
    """
    keys = list(axis.keys)
    mean = df.groupBy(*keys).agg(F.avg(column).alias("__m"))
    d = df.join(mean, keys).withColumn(column, F.coalesce(F.col(column), F.col("__m")))
    fr = frames(d, axis, column, nper, nper - int(nper * overlap))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)

    @F.pandas_udf("array<double>")
    def amplitude(s):
        x = np.abs(np.fft.rfft(np.stack(s.to_numpy()) * win, axis=1)) / win.sum()
        return pd.Series(list(x))

    a = fr.withColumn("__amp", amplitude("samples")).drop("samples")
    top = a.groupBy(*keys).agg(F.max(F.array_max("__amp")).alias("__ref"))
    freqs = np.fft.rfftfreq(nper, 1 / fs)
    lo, hi = band or (0.0, fs / 2)
    keep = [i for i, f in enumerate(freqs) if lo <= f <= hi]
    ref = F.col("__ref")
    db = F.transform(F.slice("__amp", keep[0] + 1, len(keep)), lambda v: 20 * F.log10(F.greatest(v, ref * 1e-5) / ref))
    return a.join(top, keys).select(*keys, "frame", "frame_start", F.array(*[F.lit(float(freqs[i])) for i in keep]).alias("freqs"), db.alias("db"))


def wavelet_power(df: DataFrame, axis: Axis, column: str, step_hours: float, periods_hours: list[float]) -> DataFrame:
    """Time-averaged complex Morlet power per period of a regular series: mean removed, linearly detrended.

    Trend sums, transforms and the average over time are all distributed: each chunk of the series is
    transformed with a halo of the longest wavelet and contributes sums per period.
    """
    keys = list(axis.keys)
    scales = [p * dsp.MORLET_CENTRE / step_hours for p in periods_hours]
    pairs = [(p, s) for p, s in zip(periods_hours, scales) if s >= 1]
    reach = max(dsp.morlet_reach(s) for _, s in pairs)
    i = scan(df.select(*keys, *axis.order, F.col(column).cast("double").alias("__v")), axis, index=IDX)
    fit = i.groupBy(*keys).agg(F.regr_slope("__v", IDX).alias("__k"), F.regr_intercept("__v", IDX).alias("__c"))
    d = i.join(fit, keys).withColumn("__d", F.col("__v") - (F.col("__k") * F.col(IDX) + F.col("__c")))
    h = halo_rows(d, axis, reach, reach).select(*keys, HALO, IDX, CORE, "__d")
    schema = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], "period_hours double", "s double", "n bigint"])

    def run(pdf):
        pdf = pdf.sort_values(IDX)
        x, core = pdf["__d"].to_numpy(float), pdf[CORE].to_numpy()
        rows = [[*[pdf[k].iloc[0] for k in keys], p, float(dsp.morlet_power(x, s)[core].sum()), int(core.sum())] for p, s in pairs]
        return pd.DataFrame(rows, columns=[*keys, "period_hours", "s", "n"])

    return h.groupBy(*keys, HALO).applyInPandas(run, schema).groupBy(*keys, "period_hours").agg(
        (F.sum("s") / F.sum("n")).alias("power"), F.sum("n").alias("n_samples")).withColumn(
        "coi_hours", F.col("n_samples") * step_hours / (2 * 2 ** 0.5))


# Named cycles in hours.
KNOWN_CYCLES_H = {
    "6 h": 6.0,
    "12 h (semi-diel / tidal)": 12.0,
    "24 h (diel)": 24.0,
    "7 d (weekly)": 168.0,
    "14.8 d (spring-neap)": 354.36,
    "29.5 d (lunar)": 708.72,
}


def dominant_periods(spectrum: DataFrame, keys: list[str], top_n: int = 5, cycles: dict[str, float] | None = None, tolerance: float = 0.25) -> DataFrame:
    """Strongest local maxima of a power spectrum (its top row when it has none), with the nearest named cycle.

    One row per period and entity comes in, so the windows are as long as the list of periods.
    """
    cycles = cycles or KNOWN_CYCLES_H
    w = W.partitionBy(*keys).orderBy("period_hours")
    p = F.col("power")
    s = spectrum.withColumn("__peak", F.coalesce((p > F.lag("power").over(w)) & (p >= F.lead("power").over(w)), F.lit(False)))
    s = s.withColumn("__any", F.max("__peak").over(W.partitionBy(*keys)))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__peak"), F.desc("power"), "period_hours")))
    s = s.where((F.col("__peak") & (F.col("rank") <= top_n)) | (~F.col("__any") & (F.col("rank") == 1)))
    ratios = F.array_min(F.array(*[F.struct((F.abs(F.col("period_hours") - h) / h).alias("r"), F.lit(n).alias("n")) for n, h in cycles.items()]))
    return s.withColumns({"within_coi": F.col("period_hours") <= F.col("coi_hours"), "period_days": F.col("period_hours") / 24,
                          "nearest_cycle": F.when(ratios["r"] <= tolerance, ratios["n"]).otherwise("—")}).drop("__peak", "__any")
