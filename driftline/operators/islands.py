"""Run detection on signals: segments, gaps, mask periods, label states, dives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.runs import find_runs, label_runs
from ..core.scan import scan
from ..core.stats import median, modes
from ..schema import add_seconds, seconds_between
from .intervals import merge_near, points_in


def find_segments(df: DataFrame, axis: Axis, predicate: Column, min_duration_s: float | None = None,
                  aggs: dict | None = None, with_index: bool = False) -> DataFrame:
    """Contiguous rows satisfying ``predicate`` (null counts as false), with a minimum duration.

    Duration is last minus first sample time.
    """
    runs = find_runs(df, axis, F.coalesce(predicate, F.lit(False)), aggs, F.col("value"), with_index)
    runs = runs.drop("value").withColumn("duration_s", seconds_between("start_ts", "end_ts"))
    return runs if min_duration_s is None else runs.where(F.col("duration_s") >= min_duration_s)


def membership(df: DataFrame, spans: DataFrame, axis: Axis, out: str, start: str = "start_ts", end: str = "end_ts",
               bin_s: float = 3600.0) -> DataFrame:
    """Flag samples inside any span of their entity (closed ends); spans are merged first, so rows never multiply."""
    merged = merge_near(spans.select(*axis.keys, start, end), axis.with_(order=(start, end)), end)
    merged = merged.select(*axis.keys, F.col("start_ts").alias("__ms"), F.col("end_ts").alias("__me"))
    j = points_in(df, merged, list(axis.keys), axis.ts, ("__ms", "__me"), bin_s, "left")
    return j.withColumn(out, F.col("__ms").isNotNull()).drop("__ms", "__me")


def find_adjusted_segments(df: DataFrame, axis: Axis, parents: DataFrame, children: DataFrame,
                           min_duration_s: float | None = None, bin_s: float = 3600.0) -> DataFrame:
    """Segments of samples lying in a parent and in a child interval at once."""
    d = membership(df, parents, axis, "__in_parent", bin_s=bin_s)
    d = membership(d, children, axis, "__in_child", bin_s=bin_s)
    return find_segments(d, axis, F.col("__in_parent") & F.col("__in_child"), min_duration_s)


def find_gaps(segments: DataFrame, samples: DataFrame, axis: Axis) -> DataFrame:
    """Gaps between consecutive segments: from the sample after an end to the sample before the next start."""
    keys = list(axis.keys)
    seg_axis = axis.with_(order=("start_ts", "start_index"))
    g = scan(segments.select(*keys, "start_ts", "start_index", "end_index"), seg_axis, nxt={"__next": "start_index"})
    g = g.where(F.col("__next").isNotNull()).select(
        *keys, (F.col("end_index") + 1).alias("start_index"), (F.col("__next") - 1).alias("end_index"))
    rows = scan(samples.select(*keys, *axis.order), axis, index="__i").select(*keys, "__i", axis.ts)
    a = rows.select(*keys, F.col("__i").alias("start_index"), F.col(axis.ts).alias("start_ts"))
    b = rows.select(*keys, F.col("__i").alias("end_index"), F.col(axis.ts).alias("end_ts"))
    return g.join(a, [*keys, "start_index"]).join(b, [*keys, "end_index"]).withColumn(
        "duration_s", seconds_between("start_ts", "end_ts"))


def run_steps(df: DataFrame, axis: Axis, value: Column) -> DataFrame:
    """Rows with their run bounds and ``__step``, the seconds since the previous row of the same run."""
    rows = scan(df, axis, prev={"__prev_ts": axis.ts})
    rows = label_runs(rows, axis, value)
    return rows.withColumn("__step", F.when(F.col("__prev_ts") >= F.col("run_start"), seconds_between("__prev_ts", axis.ts)))


def mask_periods(df: DataFrame, axis: Axis, mask: Column, aggs: dict | None = None) -> DataFrame:
    """Runs of a true mask as periods whose end is extended by the run's median step, in whole microseconds (a half rounds up).

    A single-sample run has no step and keeps its end.
    """
    keys = list(axis.keys)
    mask = F.coalesce(mask, F.lit(False))
    runs = find_segments(df, axis, mask, aggs=aggs)
    steps = run_steps(df, axis, mask).where(mask & F.col("__step").isNotNull()).withColumnRenamed("run_start", "start_ts")
    steps = steps.withColumn("__us", F.unix_micros(axis.ts) - F.unix_micros("__prev_ts"))
    med = median(steps, [*keys, "start_ts"], "__us", "__us")  # a double holds halves of such counts exactly
    out = runs.join(med, [*keys, "start_ts"], "left").withColumn("__us", F.coalesce(F.floor(F.col("__us") + 0.5), F.lit(0)))
    out = out.withColumn("end_ts", F.timestamp_micros(F.unix_micros("end_ts") + F.col("__us"))).withColumn("step_s", F.col("__us") / F.lit(1_000_000.0))
    return out.drop("__us").withColumn("duration_s", seconds_between("start_ts", "end_ts"))


def label_states(df: DataFrame, axis: Axis, code: str, text: str, step: DataFrame) -> DataFrame:
    """Label-code signal to state events: one per run of a non-null code, lasting one median sample more.

    ``step``: keys, ``step_s`` (see ``timebase.cadence``). The text of a run is its most frequent one.
    """
    keys = list(axis.keys)
    runs = find_runs(df, axis, code, {"__first": ("first", F.struct(*axis.order))}, F.col("value").isNotNull()).withColumnRenamed("value", code)
    rows = label_runs(df, axis, code, first="__first").where(F.col(code).isNotNull())
    texts = modes(rows, [*keys, "__first"], text, "label_text")
    out = runs.join(texts, [*keys, "__first"], "left").drop("__first").join(step, keys, "left")
    return out.withColumn("duration_s", seconds_between("start_ts", "end_ts") + F.coalesce("step_s", F.lit(0.0)))


def unscorable_states(df: DataFrame, axis: Axis, number: str, scored: str) -> DataFrame:
    """Runs of ``number`` (non-null) in which ``scored`` is null throughout become ``unscorable`` states."""
    runs = find_runs(df, axis, number, {"scored_n": ("count", scored)}, F.col("value").isNotNull())
    return runs.where(F.col("scored_n") == 0).drop("scored_n").withColumnsRenamed({"value": number}).withColumns({
        "key": F.lit("unscorable"), "duration_s": seconds_between("start_ts", "end_ts")})


def dives(df: DataFrame, axis: Axis, depth: str, threshold: float, min_duration_s: float) -> DataFrame:
    """Runs deeper than ``threshold`` lasting at least ``min_duration_s``, with their greatest depth."""
    return find_segments(df, axis, F.col(depth) > threshold, min_duration_s,
                         {"max_depth": ("max", depth), "n_null": ("sum", F.col(depth).isNull().cast("bigint"))}).withColumn(
        "has_null", F.col("n_null") > 0).drop("n_null")


def dives_with_edges(df: DataFrame, axis: Axis, depth: str, smooth: str, threshold: float, min_duration_s: float,
                     edge_s: float, bin_s: float = 3600.0) -> DataFrame:
    """Dives on a smoothed depth, each edge moved to the shallowest sample within ±``edge_s`` of it."""
    keys = list(axis.keys)
    seg = find_segments(df, axis, F.col(smooth) > threshold, min_duration_s).select(
        *keys, F.col("start_ts").alias("raw_start"), F.col("end_ts").alias("raw_end"))

    def edge(at: str, out: str) -> DataFrame:
        zone = seg.select(*keys, "raw_start", add_seconds(at, -edge_s).alias("__a"), add_seconds(at, edge_s).alias("__b"))
        near = points_in(df.select(*keys, *axis.order, depth), zone, keys, axis.ts, ("__a", "__b"), bin_s)
        return near.groupBy(*keys, "raw_start").agg(
            F.min_by(axis.ts, F.struct(F.abs(F.col(depth)), *axis.order)).alias(out))

    seg = seg.join(edge("raw_start", "start_ts"), [*keys, "raw_start"]).join(edge("raw_end", "end_ts"), [*keys, "raw_start"])
    deep = points_in(df.select(*keys, *axis.order, depth), seg.select(*keys, "raw_start", "raw_end"), keys, axis.ts,
                     ("raw_start", "raw_end"), bin_s).groupBy(*keys, "raw_start").agg(
        F.max(depth).alias("max_depth"), F.max_by(axis.ts, F.struct(F.col(depth), F.struct(*axis.order))).alias("deepest_ts"))
    return seg.join(deep, [*keys, "raw_start"]).withColumn("duration_s", seconds_between("start_ts", "end_ts"))


def flat_chunks(df: DataFrame, axis: Axis, value: str, slope: str, max_slope: float, min_samples: int, cap: float) -> DataFrame:
    """Runs with abs(slope) below a bound, long enough, whose median lies within ±``cap`` of zero."""
    flat = F.coalesce(F.abs(F.col(slope)) < max_slope, F.lit(False))
    keys = list(axis.keys)
    runs = find_segments(df, axis, flat, aggs={"__first": ("first", F.struct(*axis.order))}).where(F.col("n") >= min_samples)
    rows = label_runs(df, axis, flat, first="__first").where(flat)
    med = median(rows, [*keys, "__first"], value, "median_value")
    return runs.join(med, [*keys, "__first"]).drop("__first").where(F.abs("median_value") < cap)


def restart_states(df: DataFrame, axis: Axis, pressure: str, below: float = -500.0) -> DataFrame:
    """Logger restarts: runs of pressure below ``below`` as state events."""
    return find_segments(df, axis, F.col(pressure) < below).withColumns({
        "type": F.lit("state"), "key": F.lit("logger_restart")})


def reject_spans(beats: DataFrame, axis: Axis, kind: str) -> DataFrame:
    """Unusable spans around runs of rejected beats.

    ``kind`` is good / rejected / conflict. One rejection makes a span; a run of conflicts only needs two.
    A span reaches from the good beat before to the good beat after (or the run's own edge without one).
    """
    rej = F.col(kind) != "good"
    d = scan(beats, axis, ffill={"__good_before": F.when(~rej, F.col(axis.ts))},
             bfill={"__good_after": F.when(~rej, F.col(axis.ts))})
    runs = find_segments(d, axis, rej, aggs={
        "n_conflict": ("sum", (F.col(kind) == "conflict").cast("bigint")),
        "good_before": ("first", "__good_before"), "good_after": ("last", "__good_after")})
    need = F.when(F.col("n") == F.col("n_conflict"), 2).otherwise(1)
    return runs.where(F.col("n") >= need).select(
        *axis.keys, F.coalesce("good_before", "start_ts").alias("span_start"),
        F.coalesce("good_after", "end_ts").alias("span_end"), F.col("n").alias("n_rejected"), "n_conflict").where(
        F.col("span_end") > F.col("span_start"))
