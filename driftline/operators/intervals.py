"""Interval algebra: overlap and containment joins, clipping, merging, complement, proration, painting.

All theta joins are equi-joins on ``(keys, time bin)`` with the exact predicate on top, so Spark never
falls back to a nested loop and one busy entity is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.scan import scan
from ..schema import add_seconds, seconds_between

BIN = "__bin"
HOUR_S = 3600.0


def _us(c) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def _bins(start: Column, end: Column, bin_s: float) -> Column:
    w = F.lit(int(bin_s * 1_000_000))
    return F.sequence(F.floor(start / w), F.floor(end / w))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str],
    l: tuple[str, str], r: tuple[str, str], bin_s: float = HOUR_S, how: str = "strict",
) -> DataFrame:
    """Pairs whose intervals overlap. ``strict``: ends that only touch do not count; ``closed``: they do;
    ``contained``: the right interval lies inside the left one. Column names other than keys must differ.

    Each pair is emitted once, in the later of the two first bins.
    """
    w = F.lit(int(bin_s * 1_000_000))
    a = left.withColumn("__l0", F.floor(_us(l[0]) / w)).withColumn(BIN, F.explode(_bins(_us(l[0]), _us(l[1]), bin_s)))
    b = right.withColumn("__r0", F.floor(_us(r[0]) / w)).withColumn(BIN, F.explode(_bins(_us(r[0]), _us(r[1]), bin_s)))
    ls, le, rs, re = F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1])
    test = {
        "strict": (re > ls) & (rs < le),
        "closed": (re >= ls) & (rs <= le),
        "contained": (rs >= ls) & (re <= le),
    }[how]
    return (
        a.join(b, [*keys, BIN])
        .where(test & (F.col(BIN) == F.greatest("__l0", "__r0")))
        .drop(BIN, "__l0", "__r0")
    )


def points_in(
    points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, span: tuple[str, str],
    bin_s: float = HOUR_S, how: str = "inner", closed: bool = True,
) -> DataFrame:
    """Join samples to the intervals that hold them (both ends included unless ``closed`` is False).

    Interval columns other than keys must not clash with sample columns.
    ``how='left'`` may only be used where the intervals of an entity do not overlap, or when every
    (sample, interval) match is wanted; ``left_semi`` and ``left_anti`` are membership tests.
    """
    w = F.lit(int(bin_s * 1_000_000))
    iv = intervals.withColumnsRenamed({k: f"__k_{k}" for k in keys}).withColumn(
        f"__k{BIN}", F.explode(_bins(_us(span[0]), _us(span[1]), bin_s)))
    p = points.withColumn(BIN, F.floor(_us(ts) / w))
    t = F.col(ts)
    cond = [F.col(c) == F.col(k) for k, c in [*[(k, f"__k_{k}") for k in keys], (BIN, f"__k{BIN}")]]
    cond += [t >= F.col(span[0]), (t <= F.col(span[1])) if closed else (t < F.col(span[1]))]
    return p.join(iv, cond, how).drop(BIN, f"__k{BIN}", *[f"__k_{k}" for k in keys])


def overlap_seconds(s1, e1, s2, e2) -> Column:
    """Shared seconds of two intervals, never negative."""
    c = [F.col(x) if isinstance(x, str) else x for x in (s1, e1, s2, e2)]
    return F.greatest(seconds_between(F.greatest(c[0], c[2]), F.least(c[1], c[3])), F.lit(0.0))


def clip_children(parents: DataFrame, children: DataFrame, keys: list[str], bin_s: float = HOUR_S) -> DataFrame:
    """Children cut to the parents they overlap; one that sticks out on both sides of a parent is dropped.

    ``parents``: keys, parent_id, p_start, p_end; ``children``: keys, child_id, c_start, c_end, ….
    """
    j = overlap_join(parents, children, keys, ("p_start", "p_end"), ("c_start", "c_end"), bin_s)
    both_sides = (F.col("c_start") < F.col("p_start")) & (F.col("c_end") > F.col("p_end"))
    return j.where(~both_sides).withColumns({
        "start_ts": F.greatest("c_start", "p_start"),
        "end_ts": F.least("c_end", "p_end"),
    }).withColumn("duration_s", seconds_between("start_ts", "end_ts"))


def clip_children_counts(parents: DataFrame, children: DataFrame, keys: list[str], bin_s: float = HOUR_S) -> DataFrame:
    """How many overlapping pairs were kept, adjusted at either end, and dropped for spanning both sides."""
    j = overlap_join(parents, children, keys, ("p_start", "p_end"), ("c_start", "c_end"), bin_s)
    early = F.col("c_start") < F.col("p_start")
    late = F.col("c_end") > F.col("p_end")
    return j.agg(
        F.count_if(~(early & late)).alias("kept"),
        F.count_if(early & ~late).alias("start_adjusted"),
        F.count_if(late & ~early).alias("end_adjusted"),
        F.count_if(early & late).alias("dropped_both_sides"))


def children_per_parent(
    parents: DataFrame, children: DataFrame, keys: list[str], classes: list[str], bin_s: float = HOUR_S,
    value: str | None = None,
) -> DataFrame:
    """Per parent and child class: count, seconds, % of parent time and mean of ``value`` over contained children.

    ``children``: keys, child_class, c_start, c_end. Parents without children get zeros.
    """
    j = overlap_join(parents, children, keys, ("p_start", "p_end"), ("c_start", "c_end"), bin_s, "contained")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(seconds_between("c_start", "c_end")).alias("total_s")]
    if value:
        aggs.append(F.avg(value).alias("mean"))
    agg = j.groupBy("parent_id").pivot("child_class", classes).agg(*aggs)
    out = parents.join(agg, "parent_id", "left")
    for c in classes:
        out = out.withColumns({
            f"{c}_n": F.coalesce(F.col(f"{c}_n"), F.lit(0)).cast("bigint"),
            f"{c}_total_s": F.coalesce(F.col(f"{c}_total_s"), F.lit(0.0)),
        }).withColumn(f"{c}_pct", F.coalesce(
            100.0 * F.col(f"{c}_total_s") / F.nullif(seconds_between("p_start", "p_end"), F.lit(0.0)), F.lit(0.0)))
        if value:
            out = out.withColumn(f"{c}_mean", F.coalesce(F.col(f"{c}_mean"), F.lit(0.0)))
    return out


def merge_near(spans: DataFrame, axis: Axis, end: str = "end_ts", gap_s: float = 0.0) -> DataFrame:
    """Merge overlapping or near (gap ≤ ``gap_s``) spans per entity; ``axis.ts`` is the start column.

    Groups are numbered by a running count, scanned in chunks, so a busy entity is not one window.
    """
    s = scan(spans, axis, max_before={"__reach": end})
    fresh = F.col("__reach").isNull() | (_us(axis.ts) > _us("__reach") + int(gap_s * 1_000_000))
    s = scan(s.withColumn("__new", fresh.cast("bigint")), axis, run_sum={"__grp": "__new"})
    return s.groupBy(*axis.keys, "__grp").agg(
        F.min(axis.ts).alias("start_ts"), F.max(end).alias("end_ts"), F.count(F.lit(1)).alias("n_merged")
    ).drop("__grp")


def clip_to_window(spans: DataFrame, lo: Column, hi: Column, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Cut spans to ``[lo, hi]``; spans that vanish are dropped."""
    return (
        spans.where((F.col(end) > lo) & (F.col(start) < hi))
        .withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.col(end), hi))
    )


def resolve_end(ts: str, durations: list[str], ends: list[str], default_s: float | None = None,
                prefer_end: bool = False) -> Column:
    """End of a state event: first positive duration, then first end field, then a default length, else null."""
    by_dur = [F.when(F.col(d) > 0, add_seconds(ts, F.col(d))) for d in durations]
    by_end = [F.col(e) for e in ends]
    tail = [add_seconds(ts, default_s)] if default_s is not None else []
    return F.coalesce(*([*by_end, *by_dur] if prefer_end else [*by_dur, *by_end]), *tail, F.lit(None).cast("timestamp"))


def complement(spans: DataFrame, axis: Axis, bounds: DataFrame, end: str = "end_ts") -> DataFrame:
    """Stretches of each entity's ``[lo, hi]`` (table ``bounds``) not covered by merged, disjoint ``spans``."""
    s = scan(spans, axis, prev={"__prev_end": end}, nxt={"__more": F.lit(1)})
    keys = list(axis.keys)
    j = bounds.join(s, keys, "left")
    lead_in = j.where(F.col(axis.ts).isNotNull()).select(
        *keys, F.coalesce("__prev_end", "lo").alias("start_ts"), F.col(axis.ts).alias("end_ts"))
    tail = j.where(F.col("__more").isNull()).select(
        *keys, F.coalesce(end, "lo").alias("start_ts"), F.col("hi").alias("end_ts"))
    return lead_in.unionByName(tail).where(F.col("end_ts") > F.col("start_ts"))


def max_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, l: tuple[str, str],
                r: tuple[str, str], bin_s: float = HOUR_S) -> DataFrame:
    """Each left interval with the largest overlap (seconds) it has with any right one, 0 when none."""
    best = overlap_join(left.select(*keys, left_id, *l), right.select(*keys, *r), keys, l, r, bin_s).groupBy(left_id).agg(
        F.max(overlap_seconds(l[0], l[1], r[0], r[1])).alias("overlap_s"))
    return left.join(best, left_id, "left").withColumn("overlap_s", F.coalesce("overlap_s", F.lit(0.0)))


def prorate(spans: DataFrame, grain: str = "hour", tz: str | Column = "UTC", start: str = "start_ts",
            end: str = "end_ts") -> DataFrame:
    """Split each span at local hour or day borders: adds ``bucket`` (local wall time), ``seconds``.

    Borders are local; the seconds of each piece are differences of instants, so DST days are right.
    Zero-length spans give no piece.
    """
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}[grain]
    zone = F.lit(tz) if isinstance(tz, str) else tz
    ls, le = F.from_utc_timestamp(F.col(start), zone), F.from_utc_timestamp(F.col(end), zone)
    d = spans.where(F.col(end) > F.col(start)).withColumn(
        "bucket", F.explode(F.sequence(F.date_trunc(grain, ls), le, F.expr(step))))
    b0 = F.to_utc_timestamp("bucket", zone)
    b1 = F.to_utc_timestamp(F.col("bucket") + F.expr(step), zone)
    return d.withColumn("seconds", seconds_between(F.greatest(F.col(start), b0), F.least(F.col(end), b1))).where(
        F.col("seconds") > 0)


def prorate_scaled(spans: DataFrame, duration: str = "duration_s", **kw) -> DataFrame:
    """Day pieces scaled so that a span contributes its effective duration, not its wall span."""
    start, end = kw.get("start", "start_ts"), kw.get("end", "end_ts")
    return prorate(spans, "day", **kw).withColumn(
        "seconds", F.col("seconds") * F.col(duration) / F.nullif(seconds_between(start, end), F.lit(0.0)))


def flatten_labels(intervals: DataFrame, axis: Axis, end: str, label: str, rank: str, bin_s: float = HOUR_S) -> DataFrame:
    """Turn overlapping labelled closed intervals into disjoint half-open pieces; the latest start wins.

    Pieces: keys, piece_start, piece_end (exclusive, one microsecond past the closed end), label.
    """
    keys, start = list(axis.keys), axis.ts
    past = F.timestamp_micros(_us(end) + 1)
    iv = intervals.select(*keys, F.col(start).alias("__s"), past.alias("__e"), F.col(label).alias(label), F.col(rank).alias("__rank"))
    cuts = iv.select(*keys, F.col("__s").alias("piece_start")).union(iv.select(*keys, "__e")).distinct()
    cut_axis = axis.with_(order=("piece_start",))
    pieces = scan(cuts, cut_axis, nxt={"piece_end": "piece_start"}).where(F.col("piece_end").isNotNull())
    j = overlap_join(pieces, iv, keys, ("piece_start", "piece_end"), ("__s", "__e"), bin_s)
    return j.groupBy(*keys, "piece_start", "piece_end").agg(
        F.max_by(label, F.struct("__s", "__rank")).alias(label))


def paint(samples: DataFrame, intervals: DataFrame, sample_axis: Axis, start: str, end: str, label: str, rank: str,
          default: Column, out: str = "state_label", bin_s: float = HOUR_S) -> DataFrame:
    """Give every sample the label of the interval holding it (closed ends, last start wins) or ``default``.

    Overlaps are resolved among the intervals first, so each sample meets at most one piece and the
    samples are never aggregated.
    """
    keys = list(sample_axis.keys)
    pieces = flatten_labels(intervals, sample_axis.with_(order=(start, rank)), end, label, rank, bin_s)
    pieces = pieces.withColumnRenamed(label, "__painted")
    j = points_in(samples, pieces, keys, sample_axis.ts, ("piece_start", "piece_end"), bin_s, "left", closed=False)
    return j.withColumn(out, F.coalesce("__painted", default)).drop("__painted", "piece_start", "piece_end")


def centred_window(start: str, end: str, width_s: float) -> tuple[Column, Column]:
    """Bounds of a window of ``width_s`` seconds around the midpoint of a segment."""
    mid = midpoint(start, end)
    return add_seconds(mid, -width_s / 2), add_seconds(mid, width_s / 2)


def midpoint(start: str, end: str) -> Column:
    return F.timestamp_micros(F.floor((_us(start) + _us(end)) / 2).cast("bigint"))


def segment_signal_stats(samples: DataFrame, segments: DataFrame, keys: list[str], segment_id: str, ts: str,
                         span: tuple[str, str], value: str, bin_s: float = HOUR_S) -> DataFrame:
    """Mean, min, max and count of a signal over the samples inside each segment (closed both ends)."""
    agg = points_in(samples.select(*keys, ts, value), segments.select(*keys, segment_id, *span), keys, ts, span, bin_s).groupBy(
        segment_id).agg(F.avg(value).alias("seg_mean"), F.min(value).alias("seg_min"), F.max(value).alias("seg_max"),
                        F.count(value).alias("seg_n"))
    return segments.join(agg, segment_id, "left").withColumn("seg_n", F.coalesce("seg_n", F.lit(0)).cast("bigint"))
