"""Statistics of samples within segments and path tortuosity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.runs import label_runs
from ..core.scan import scan
from ..core.stats import modes

_OPS = {
    "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp,
    "abs_mean": lambda c: F.avg(F.abs(c)), "abs_max": lambda c: F.max(F.abs(c)),
    "abs_min": lambda c: F.min(F.abs(c)), "abs_sum": lambda c: F.sum(F.abs(c)),
}
KNOWN_OPS = (*_OPS, "mode")


def segment_stats(rows: DataFrame, segment_keys: list[str], stats: list[tuple[str, str]]) -> DataFrame:
    """One row per segment with ``{op}_{column}`` for each requested statistic; an unknown op is an error.

    ``rows`` carry their segment in ``segment_keys`` (run start, painted piece, …). Running sums stay with
    the rows, see ``segment_cumsum``.
    """
    bad = [op for op, _ in stats if op not in KNOWN_OPS]
    if bad:
        raise ValueError(f"unknown statistic {bad}; known: {KNOWN_OPS}")
    plain = [_OPS[op](F.col(c)).alias(f"{op}_{c}") for op, c in stats if op in _OPS]
    out = rows.groupBy(*segment_keys).agg(*(plain or [F.count(F.lit(1)).alias("n")]))
    for op, c in stats:
        if op == "mode":
            out = out.join(modes(rows, segment_keys, c, f"mode_{c}"), segment_keys, "left")
    return out


def run_stats(df: DataFrame, axis: Axis, predicate: Column, stats: list[tuple[str, str]]) -> DataFrame:
    """Segments of a predicate with their statistics."""
    p = F.coalesce(predicate, F.lit(False))
    rows = label_runs(df, axis, p).where(p)
    return segment_stats(rows, [*axis.keys, "run_start", "run_end"], stats)


def segment_cumsum(rows: DataFrame, axis: Axis, segment_keys: list[str], columns: list[str], absolute: bool = False) -> DataFrame:
    """Running sums within each segment as row columns ``cumsum_{c}`` / ``abs_cumsum_{c}``.

    A segment can be as long as a recording, so the sums are not packed into one array.
    """
    seg_axis = axis.with_(keys=tuple(segment_keys))
    name = "abs_cumsum" if absolute else "cumsum"
    return scan(rows, seg_axis, run_sum={f"{name}_{c}": F.abs(F.col(c)) if absolute else F.col(c) for c in columns})


def tortuosity(df: DataFrame, axis: Axis, segment: list[str], x: str, y: str, z: str | None = None) -> DataFrame:
    """Path length over straight-line distance per segment; null below two points or without displacement.

    ``axis`` keys include the segment columns, so steps never cross a segment.
    """
    dims = [x, y] + ([z] if z else [])
    d = scan(df, axis, prev={f"__p_{c}": c for c in dims})
    step = F.sqrt(sum(((F.col(c) - F.col(f"__p_{c}")) ** 2 for c in dims), F.lit(0.0)))
    at = F.struct(*axis.order)
    g = d.groupBy(*segment).agg(
        F.sum(step).alias("path_length"), F.count(F.lit(1)).alias("n_points"),
        *[F.min_by(c, at).alias(f"__a_{c}") for c in dims], *[F.max_by(c, at).alias(f"__b_{c}") for c in dims])
    straight = F.sqrt(sum(((F.col(f"__b_{c}") - F.col(f"__a_{c}")) ** 2 for c in dims), F.lit(0.0)))
    g = g.withColumn("straight_line", straight)
    return g.withColumn("tortuosity", F.when((F.col("n_points") >= 2) & (F.col("straight_line") > 0),
                                             F.col("path_length") / F.col("straight_line"))).drop(
        *[f"__{e}_{c}" for e in "ab" for c in dims])
