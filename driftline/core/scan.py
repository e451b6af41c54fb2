"""Ordered scans over an ``Axis``: neighbours, running aggregates, fills and row numbers.

Each scan shuffles the rows once by ``(entity, chunk)``. Values that must cross a chunk edge come from a
summary with one row per chunk: it is aggregated map-side, scanned per entity (its size is rows/chunk
rows) and joined back on ``(entity, chunk)``, the partitioning and order the rows already have, by a
merge: sizes are guessed before grids are filled, and a guess may broadcast the rows, which adaptive
execution does not take back when that needs one more shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .axis import CHUNK, Axis
from .stage import settle

Specs = dict[str, "Column | str"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scan(
    df: DataFrame,
    axis: Axis,
    *,
    prev: Specs | None = None,
    nxt: Specs | None = None,
    run_sum: Specs | None = None,
    run_max: Specs | None = None,
    ffill: Specs | None = None,
    bfill: Specs | None = None,
    max_before: Specs | None = None,
    index: str | None = None,
) -> DataFrame:
    """Add ordered columns to ``df`` (output name -> input expression).

    prev/nxt: value of the neighbouring row; run_sum/run_max: inclusive running aggregates;
    max_before: running max over strictly earlier rows; ffill/bfill: last/next non-null value, the row
    itself included; index: 0-based row number within the entity.
    """
    kinds = {"prev": prev, "nxt": nxt, "run_sum": run_sum, "run_max": run_max, "max_before": max_before,
             "ffill": ffill, "bfill": bfill}
    specs = [(kind, out, _c(e)) for kind, d in kinds.items() for out, e in (d or {}).items()]
    keys, order = list(axis.keys), list(axis.order)
    tmp = {out: f"__in_{out}" for _, out, _ in specs}
    df = settle(df)
    rows = df.select("*", axis.chunk(df).alias(CHUNK), *[e.alias(tmp[out]) for _, out, e in specs])

    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for kind, out, _ in specs:
        v = F.col(tmp[out])
        present = F.when(v.isNotNull(), at)
        aggs.append({
            "prev": lambda: F.max_by(v, at),
            "nxt": lambda: F.min_by(v, at),
            "run_sum": lambda: F.sum(v),
            "run_max": lambda: F.max(v),
            "max_before": lambda: F.max(v),
            "ffill": lambda: F.max_by(v, present),
            "bfill": lambda: F.min_by(v, present),
        }[kind]().alias(f"__s_{out}"))
    summary = rows.groupBy(*keys, CHUNK).agg(*aggs)
    fwd = W.partitionBy(*keys).orderBy(CHUNK)
    back = W.partitionBy(*keys).orderBy(F.desc(CHUNK))
    before = fwd.rowsBetween(W.unboundedPreceding, -1)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")]
    for kind, out, _ in specs:
        s = F.col(f"__s_{out}")
        carry.append({
            "prev": lambda: F.lag(s).over(fwd),
            "nxt": lambda: F.lead(s).over(fwd),
            "run_sum": lambda: F.sum(s).over(before),
            "run_max": lambda: F.max(s).over(before),
            "max_before": lambda: F.max(s).over(before),
            "ffill": lambda: F.last(s, ignorenulls=True).over(before),
            "bfill": lambda: F.last(s, ignorenulls=True).over(after),
        }[kind]().alias(f"__c_{out}"))
    carried = summary.select(*keys, CHUNK, *carry)

    here = W.partitionBy(*keys, CHUNK).orderBy(*order)
    rev = W.partitionBy(*keys, CHUNK).orderBy(*[F.desc(o) for o in order])
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    earlier = here.rowsBetween(W.unboundedPreceding, -1)
    local = [F.row_number().over(here).alias("__rn")]
    for kind, out, _ in specs:
        v = F.col(tmp[out])
        local.append({
            "prev": lambda: F.lag(v).over(here),
            "nxt": lambda: F.lead(F.struct(v.alias("v"))).over(here),
            "run_sum": lambda: F.sum(v).over(upto),
            "run_max": lambda: F.max(v).over(upto),
            "max_before": lambda: F.max(v).over(earlier),
            "ffill": lambda: F.last(v, ignorenulls=True).over(upto),
            "bfill": lambda: F.last(v, ignorenulls=True).over(rev.rowsBetween(W.unboundedPreceding, 0)),
        }[kind]().alias(f"__l_{out}"))
    joined = axis.dealt(rows, *keys, CHUNK).select("*", *local).join(carried.hint("merge"), [*keys, CHUNK])

    final = []
    for kind, out, _ in specs:
        l, c = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        final.append({
            "prev": lambda: F.when(F.col("__rn") == 1, c).otherwise(l),
            "nxt": lambda: F.when(l.isNull(), c).otherwise(l["v"]),
            "run_sum": lambda: F.when(l.isNull(), c).otherwise(l + F.coalesce(c, F.lit(0))),
            "run_max": lambda: F.greatest(l, c),
            "max_before": lambda: F.greatest(l, c),
            "ffill": lambda: F.coalesce(l, c),
            "bfill": lambda: F.coalesce(l, c),
        }[kind]().alias(out))
    if index:
        final.append((F.col("__rn") - 1 + F.col("__offset")).cast("bigint").alias(index))
    return joined.select(*df.columns, *final)


HALO = "__halo"
IDX = "__idx"
CORE = "__core"


def halo_rows(df: DataFrame, axis: Axis, before: int | Column, after: int | Column, index: str = IDX) -> DataFrame:
    """Re-cut the axis into chunks of ``axis.rows`` rows, each with the neighbours a row frame needs.

    A frame ``rowsBetween(-before, after)`` partitioned by ``(entity, HALO)`` is then exact on rows where
    ``CORE`` is true; only rows near a chunk edge are copied. Reaches given as columns are constant within an entity.
    """
    wide = 4 * (before + after + 1)
    size = F.greatest(F.lit(axis.rows), wide) if isinstance(wide, Column) else F.lit(max(axis.rows, wide))
    d = df if index in df.columns else scan(df, axis, index=index)
    i = F.col(index)
    lo = F.floor(F.greatest(i - after, F.lit(0)) / size)
    hi = F.floor((i + before) / size)
    return axis.dealt(
        d.withColumn(HALO, F.explode(F.sequence(lo, hi)))
        .withColumn(CORE, F.col(HALO) == F.floor(i / size)), *axis.keys, HALO)


def row_frame(axis: Axis, before: int, after: int, index: str = IDX):
    return W.partitionBy(*axis.keys, HALO).orderBy(index).rowsBetween(-before, after)


def halo_time(df: DataFrame, axis: Axis, before: int, after: int) -> DataFrame:
    """Time version of ``halo_rows``: frames ``rangeBetween(-before, after)`` on the axis position ``__pos``."""
    width = max(axis.width, before + after + 1)
    d = df.withColumn("__pos", axis.pos(df))
    p = F.col("__pos")
    lo, hi = F.floor((p - after) / F.lit(width)), F.floor((p + before) / F.lit(width))
    return (
        d.withColumn(HALO, F.explode(F.sequence(lo, hi)))
        .withColumn(CORE, F.col(HALO) == F.floor(p / F.lit(width)))
    )


def range_frame(axis: Axis, before: int, after: int):
    return W.partitionBy(*axis.keys, HALO).orderBy("__pos").rangeBetween(-before, after)


def drop_halo(df: DataFrame, *extra: str) -> DataFrame:
    return df.where(F.col(CORE)).drop(HALO, CORE, IDX, "__pos", *extra)
