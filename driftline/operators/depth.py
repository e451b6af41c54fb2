"""Depth calibration: factors, sign, zero offset, surface enforcement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.halo import entity_apply, whole_entities
from ..core.stats import median
from .intervals import points_in
from .islands import dives, flat_chunks
from .rolling import gradient, running_median

# The default pressure-to-depth settings.
DEPTH_DEFAULTS = {"dive_threshold_m": 0.5, "min_dive_s": 10.0, "max_flat_slope": 0.1, "min_flat_samples": 60,
                  "flat_cap_m": 5.0, "min_flat_chunks": 10, "sign_flip_below_m": -10.0}


def clamp_factor(factor: Column) -> Column:
    """Unit conversion factor limited to [0.01, 100]; exactly -1 (sign only) is allowed."""
    return F.when((factor == -1) | factor.isNull(), factor).otherwise(F.least(F.greatest(factor, F.lit(0.01)), F.lit(100.0)))


def convert_depth(df: DataFrame, keys: list[str], column: str, factor: Column, out: str, auto_flip: bool = True,
                  flip_below: float = DEPTH_DEFAULTS["sign_flip_below_m"]) -> DataFrame:
    """Scale to metres, then turn the sign of an entity whose median depth is well below zero.

    The flip is skipped when disabled or when the factor already is -1.
    """
    f = clamp_factor(factor)
    d = df.withColumns({"__f": f, out: F.col(column) * f})
    if not auto_flip:
        return d.drop("__f")
    med = median(d, keys, out, "__med")
    flip = (F.col("__med") < flip_below) & (F.col("__f") != -1)
    return d.join(med, keys, "left").withColumn(out, F.when(flip, -F.col(out)).otherwise(F.col(out))).drop("__f", "__med")


def zero_offset(df: DataFrame, axis: Axis, column: str, chunks: DataFrame, out: str = "depth_zoc", min_chunks: int = 1,
                bin_s: float = 3600.0) -> DataFrame:
    """Subtract the surface offset: the median of each flat chunk, linear between chunks, 0 before the first
    and constant after the last. Entities with fewer than ``min_chunks`` chunks stay as they are.

    ``chunks``: keys, start_ts, end_ts, median_value (disjoint). Adds ``out`` and ``offset``.
    """
    keys = list(axis.keys)
    n = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nc"))
    c = chunks.select(*keys, F.col("start_ts").alias("__cs"), F.col("end_ts").alias("__ce"), F.col("median_value").alias("offset"))
    d = points_in(df, c, keys, axis.ts, ("__cs", "__ce"), bin_s, "left").drop("__cs", "__ce")
    d = row_linear(d, axis, "offset").join(n, keys, "left")
    enough = F.coalesce(F.col("__nc"), F.lit(0)) >= min_chunks
    d = d.withColumn("offset", F.when(enough, F.coalesce("offset", F.lit(0.0))).otherwise(0.0))
    return d.withColumn(out, F.col(column) - F.col("offset")).drop("__nc")


def _run_medians(value: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last row of each run of ``member``, and the median of its known values (not a number without any)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2] - 1
    row = np.flatnonzero(member & ~np.isnan(value))
    run = np.searchsorted(first, row, side="right") - 1
    v = value[row][np.lexsort((value[row], run))]
    n = np.bincount(run, minlength=len(first))
    at = np.cumsum(n) - n
    with np.errstate(invalid="ignore"):
        pick = lambda k: v[np.minimum(at + k, max(len(v) - 1, 0))] if len(v) else np.full(len(first), np.nan)
        x, y = pick(np.maximum(n - 1, 0) // 2), pick(n // 2)
    return first, last, np.where(n > 0, x + (y - x) * 0.5, np.nan)


def level_surface(df: DataFrame, axis: Axis, column: str, slope: str, max_slope: float, min_samples: int, cap: float, out: str = "depth_zoc",
                  min_chunks: int = 1, bin_s: float = 3600.0) -> DataFrame:
    """``zero_offset`` by the signal's own flat chunks (``islands.flat_chunks``), in one go.

    An entity that fits one chunk takes one task: runs, medians and the offset between them are found on its rows as they stand. Larger ones
    go through the two operators.
    """
    def whole(x):
        v, us = x[column], x["__us"]
        first, last, mid = _run_medians(v, np.abs(x[slope]) < max_slope)
        good = (last - first + 1 >= min_samples) & (np.abs(mid) < cap)
        offset = np.zeros(len(v))
        if good.sum() >= max(min_chunks, 1):
            a, b = np.searchsorted(us, us[first[good]]), np.searchsorted(us, us[last[good]], side="right") - 1
            level = np.repeat(mid[good], 2)
            offset = np.interp(np.arange(len(v)), np.stack([a, b], 1).ravel(), level, left=0.0)
        return {"offset": offset, out: v - offset}

    small, large = whole_entities(df, axis)
    parts = []
    if small is not None:
        d = small.withColumn("__us", axis.pos(small))
        parts.append(entity_apply(d, axis, whole, [column, slope, "__us"], {"offset": "double", out: "double"}).drop("__us"))
    if large is not None:
        parts.append(zero_offset(large, axis, column, flat_chunks(large, axis, column, slope, max_slope, min_samples, cap), out, min_chunks, bin_s))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def row_linear(df: DataFrame, axis: Axis, column: str) -> DataFrame:
    """Fill nulls linearly by row position; leading nulls stay, trailing ones take the last value."""
    from ..core.scan import scan
    i = scan(df, axis, index="__i")
    pack = F.when(F.col(column).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(column).alias("v")))
    s = scan(i, axis, ffill={"__b": pack}, bfill={"__f": pack})
    b, f = F.col("__b"), F.col("__f")
    w = F.coalesce((F.col("__i") - b["i"]) / F.nullif(f["i"] - b["i"], F.lit(0)), F.lit(0.0))
    lin = F.when(b.isNotNull() & f.isNotNull(), b["v"] + (f["v"] - b["v"]) * w).otherwise(b["v"])
    return s.withColumn(column, F.coalesce(F.col(column), lin)).select(*df.columns)


def chunk_regression(df: DataFrame, chunks: DataFrame, axis: Axis, column: str, temp: str, reference: float = 20.0,
                     bin_s: float = 3600.0) -> DataFrame:
    """Slope and intercept of depth on (temperature - reference) within each flat chunk of two or more samples; null where the temperature
    does not vary. That is asked of its ends: merged partial variances of equal values are often a little above 0.
    """
    keys = list(axis.keys)
    c = chunks.select(*keys, "start_ts", "end_ts")
    j = points_in(df.select(*keys, *axis.order, column, temp), c, keys, axis.ts, ("start_ts", "end_ts"), bin_s)
    t = F.col(temp) - reference
    x = F.when(F.col(column).isNotNull(), t)
    g = j.groupBy(*keys, "start_ts").agg(
        F.when(F.min(x) < F.max(x), F.covar_pop(column, t) / F.var_pop(x)).alias("slope"), F.regr_avgy(column, t).alias("__y"), F.regr_avgx(column, t).alias("__x"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.withColumn("intercept", F.col("__y") - F.col("slope") * F.col("__x")).select(*keys, "start_ts", "slope", "intercept", "n")


def surface_outside_dives(df: DataFrame, dive_table: DataFrame, axis: Axis, column: str) -> DataFrame:
    """Force 0 before the first dive starts and after the last one ends."""
    keys = list(axis.keys)
    b = dive_table.groupBy(*keys).agg(F.min("start_ts").alias("__a"), F.max("end_ts").alias("__b"))
    outside = (F.col(axis.ts) < F.col("__a")) | (F.col(axis.ts) > F.col("__b"))
    return df.join(b, keys, "left").withColumn(column, F.when(outside, F.lit(0.0)).otherwise(F.col(column))).drop("__a", "__b")


def pressure_to_depth(df: DataFrame, axis: Axis, column: str, factor: Column, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole chain: factor and sign, 5-row median, slope, flat surface chunks, offset, dives, surface outside dives.

    Returns the calibrated signal (``depth``) and the dive table.
    """
    cfg = {**DEPTH_DEFAULTS, **(settings or {})}
    keys = list(axis.keys)
    d = convert_depth(df, keys, column, factor, "depth_m", flip_below=cfg["sign_flip_below_m"])
    d = running_median(d, axis, 5, "depth_m", "__sm")
    d = gradient(d, axis, {"__d1": "__sm"})
    z = level_surface(d, axis, "__sm", "__d1", cfg["max_flat_slope"], cfg["min_flat_samples"], cfg["flat_cap_m"], "depth", cfg["min_flat_chunks"]).drop("__sm", "__d1", "offset")
    dv = dives(z, axis, "depth", cfg["dive_threshold_m"], cfg["min_dive_s"])
    return surface_outside_dives(z, dv, axis, "depth"), dv
