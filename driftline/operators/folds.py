"""Order-dependent selections, folded chunk by chunk (see ``core.fold``)."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..core.axis import Axis
from ..core.fold import chunked_fold


def thin_by_interval(df: DataFrame, axis: Axis, min_s: float) -> DataFrame:
    """Keep a row when at least ``min_s`` passed since the last kept one."""
    gap = int(round(min_s * 1e6))

    def fold(cols, state):
        us = np.asarray(cols["__us"])
        after = np.searchsorted(us, us + gap)  # the row that follows if this one is kept
        after = np.maximum(after, np.arange(len(us)) + 1)
        i = 0 if state is None else int(np.searchsorted(us, state[0] + gap))
        keep, last = np.zeros(len(us), bool), state
        while i < len(us):
            keep[i], last = True, [us[i]]
            i = int(after[i])
        return keep, last

    d = df.withColumn("__us", axis.pos(df))
    return chunked_fold(d, axis, ["__us"], fold, "__keep").where("__keep").drop("__keep", "__us")


def suppress_close(df: DataFrame, axis: Axis, min_s: float) -> DataFrame:
    """Of events closer than ``min_s`` the later replaces the earlier one.

    Whether an event survives depends only on its successor: it is replaced when the next one follows
    within the distance, so no fold is needed.
    """
    from ..core.scan import scan
    s = scan(df, axis, nxt={"__n": axis.pos(df)})
    return s.where(F.col("__n").isNull() | (F.col("__n") - axis.pos(df) >= int(round(min_s * 1e6)))).drop("__n")


EARTH_KM = 6371.0088


def speed_filter(df: DataFrame, axis: Axis, lat: str, lon: str, max_kmh: float, out: str = "outlier") -> DataFrame:
    """Flag fixes whose speed from the last accepted fix is too high, or whose time does not advance.

    A single outlier does not drag its neighbours along because it never becomes the reference.
    """
    def too_fast(a, b):
        """Of fixes (hours, latitude, longitude in radians) whether ``b`` can't be reached from ``a``."""
        dt = b[0] - a[0]
        h = np.sin((b[1] - a[1]) / 2) ** 2 + np.cos(a[1]) * np.cos(b[1]) * np.sin((b[2] - a[2]) / 2) ** 2
        return (dt <= 0) | (2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))) > max_kmh * dt)

    def fold(cols, state):
        x = np.array([np.asarray(cols["__us"]) / 3.6e9, np.radians(cols[lat]), np.radians(cols[lon])])
        at = np.flatnonzero(~np.isnan(x[1:]).any(0))  # a fix without position is neither flagged nor a reference
        p, bad = x[:, at], np.zeros(x.shape[1], bool)
        steps = np.flatnonzero(too_fast(p[:, :-1], p[:, 1:])) + 1  # where a fix doesn't follow from its neighbour
        k = 0
        while k < len(at):
            if state is not None and too_fast(state, p[:, k]):
                bad[at[k]] = True
                k += 1
                continue
            stop = np.searchsorted(steps, k, side="right")
            end = int(steps[stop]) if stop < len(steps) else len(at)
            state, k = p[:, end - 1].tolist(), end
        return bad, state

    d = df.withColumn("__us", axis.pos(df))
    return chunked_fold(d, axis, ["__us", lat, lon], fold, out).drop("__us")


def match_in_order(truth: DataFrame, found: DataFrame, axis: Axis, tol_s: float) -> DataFrame:
    """Greedy one-to-one matching in time order; rows carry ``side`` and ``matched`` (set on the later partner)."""
    tol = int(round(tol_s * 1e6))
    keys = list(axis.keys)
    both = truth.select(*keys, axis.ts, F.lit(0).alias("side")).unionByName(
        found.select(*keys, axis.ts, F.lit(1).alias("side"))).withColumn("__us", F.unix_micros(axis.ts))

    def fold(cols, state):
        side_waiting, queue = (None, deque()) if not state else (state[0], deque(state[1:]))
        hits = []
        for t, s in zip(cols["__us"], cols["side"]):
            while queue and t - queue[0] > tol:
                queue.popleft()
            if queue and side_waiting != s:
                queue.popleft()
                hits.append(True)
            else:
                side_waiting = s
                queue.append(t)
                hits.append(False)
        return hits, ([side_waiting, *queue] if queue else None)

    ax = axis.with_(order=(axis.ts, "side"))
    return chunked_fold(both, ax, ["__us", "side"], fold, "matched").drop("__us")


def match_scores(matched: DataFrame, keys: list[str]) -> DataFrame:
    """tp / fp / fn, precision, recall and F1 of ``match_in_order``."""
    c = matched.groupBy(*keys).agg(
        F.count_if("matched").alias("tp"), F.count_if(F.col("side") == 1).alias("nf"), F.count_if(F.col("side") == 0).alias("nt"))
    tp, nf, nt = F.col("tp"), F.col("nf"), F.col("nt")
    p, r = F.coalesce(F.try_divide(tp, nf), F.lit(0.0)), F.coalesce(F.try_divide(tp, nt), F.lit(0.0))
    return c.select(*keys, "tp", (nf - tp).alias("fp"), (nt - tp).alias("fn"), p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
