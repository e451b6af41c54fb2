"""Runs of equal value on an ordered axis, found inside chunks and stitched across chunk edges.

Only the first and last run of each chunk can continue in a neighbour, so the table that is stitched per
entity has at most two rows per chunk, whatever the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .axis import CHUNK, Axis
from .stage import settle

# aggregate name -> (in-chunk aggregate, merge of partial results)
_PARTIAL = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "first": (lambda c: F.min_by(c, F.col("__at")), lambda c: F.min_by(c, F.col("__from"))),
    "last": (lambda c: F.max_by(c, F.col("__at")), lambda c: F.max_by(c, F.col("__to"))),
}


def _islands(df: DataFrame, axis: Axis, value: Column) -> DataFrame:
    d = df if CHUNK in df.columns else df.withColumn(CHUNK, axis.chunk(df))
    d = d.select("*", value.alias("__v"), F.struct(*axis.order).alias("__at"))
    w = W.partitionBy(*axis.keys, CHUNK).orderBy(*axis.order)
    changed = F.when(F.lag(F.struct("__v")).over(w).isNull(), 1).otherwise(
        F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)), 0).otherwise(1))
    d = d.select("*", changed.alias("__chg"), F.row_number().over(w).alias("__rn"),
                 F.lead(F.lit(1)).over(w).isNull().alias("__end"))
    return d.withColumn("__isl", F.sum("__chg").over(w.rowsBetween(W.unboundedPreceding, 0)))


def _edge_groups(edges: DataFrame, axis: Axis) -> DataFrame:
    w = W.partitionBy(*axis.keys).orderBy(CHUNK, "__isl")
    fresh = (
        F.lag(CHUNK).over(w).isNull()
        | (F.lag(CHUNK).over(w) == F.col(CHUNK))
        | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))
    )
    return edges.withColumn("__new", fresh.cast("int")).withColumn(
        "__grp", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))


def find_runs(
    df: DataFrame,
    axis: Axis,
    value: Column | str,
    aggs: dict[str, tuple[str, str | Column]] | None = None,
    where: Column | None = None,
    with_index: bool = False,
) -> DataFrame:
    """One row per maximal run of equal ``value``: keys, ``value``, ``start_ts``, ``end_ts``, ``n`` and aggregates.

    ``aggs``: output name -> (sum|count|min|max|first|last, column). ``where`` filters runs by the column
    ``value``. With ``with_index`` also the inclusive ``start_index``/``end_index`` row numbers. Rows that come with a ``CHUNK``, in the
    order of the axis, are taken in these chunks, so rows dealt by them are not shuffled again.
    """
    value = F.col(value) if isinstance(value, str) else value
    aggs = aggs or {}
    keys = list(axis.keys)
    df = settle(df)
    d = _islands(df, axis, value)
    parts = [_PARTIAL[op][0](F.col(c) if isinstance(c, str) else c).alias(f"__a_{out}") for out, (op, c) in aggs.items()]
    segs = d.groupBy(*keys, CHUNK, "__isl").agg(
        F.first("__v").alias("__v"), F.min("__at").alias("__from"), F.max("__at").alias("__to"),
        F.count(F.lit(1)).alias("__n"), F.min("__rn").alias("__r0"), F.max("__rn").alias("__r1"),
        F.max("__end").alias("__last"), *parts)
    if with_index:
        n = d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__rows"))
        off = n.select(*keys, CHUNK, F.coalesce(
            F.sum("__rows").over(W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)).alias("__off"))
        segs = segs.join(off, [*keys, CHUNK])
        segs = segs.withColumn("__r0", F.col("__r0") + F.col("__off")).withColumn(
            "__r1", F.col("__r1") + F.col("__off")).drop("__off")
    names = [f"__a_{o}" for o in aggs]
    cols = [*keys, "__v", "__from", "__to", "__n", "__r0", "__r1", *names]
    is_edge = (F.col("__isl") == 1) | F.col("__last")
    inner = segs.where(~is_edge).select(*cols)
    stitched = _edge_groups(segs.where(is_edge), axis).groupBy(*keys, "__grp").agg(
        F.first("__v").alias("__v"), F.min("__from").alias("__f"), F.max("__to").alias("__t"),
        F.sum("__n").alias("__n"), F.min("__r0").alias("__r0"), F.max("__r1").alias("__r1"),
        *[_PARTIAL[op][1](F.col(f"__a_{o}")).alias(f"__a_{o}") for o, (op, _) in aggs.items()],
    ).withColumnsRenamed({"__f": "__from", "__t": "__to"}).select(*cols)
    out = inner.unionByName(stitched).select(
        *keys, F.col("__v").alias("value"), F.col(f"__from.{axis.ts}").alias("start_ts"),
        F.col(f"__to.{axis.ts}").alias("end_ts"), F.col("__n").alias("n"),
        *([(F.col("__r0") - 1).cast("bigint").alias("start_index"), (F.col("__r1") - 1).cast("bigint").alias("end_index")]
          if with_index else []),
        *[F.col(f"__a_{o}").alias(o) for o in aggs])
    return out.where(where) if where is not None else out


def label_runs(df: DataFrame, axis: Axis, value: Column | str, start: str = "run_start", end: str = "run_end", first: str | None = None) -> DataFrame:
    """Row-level form: every row gets the first and last axis value of the run it belongs to, and with ``first`` the order columns of its
    first row as a struct, which tell runs apart that start at one instant."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(axis.keys)
    df = settle(df)
    d = _islands(df, axis, value)
    w = W.partitionBy(*keys, CHUNK, "__isl")
    edges = d.groupBy(*keys, CHUNK, "__isl").agg(
        F.first("__v").alias("__v"), F.min("__at").alias("__s"), F.max(axis.ts).alias("__e"),
        F.max("__end").alias("__last")).where((F.col("__isl") == 1) | F.col("__last"))
    g = W.partitionBy(*keys, "__grp")
    edges = _edge_groups(edges, axis).select(
        *keys, CHUNK, "__isl", F.min("__s").over(g).alias("__s"), F.max("__e").over(g).alias("__e"))
    rows = d.select(*df.columns, CHUNK, "__isl", F.min("__at").over(w).alias("__ls"), F.max(axis.ts).over(w).alias("__le"))
    return rows.join(edges, [*keys, CHUNK, "__isl"], "left").select(
        *df.columns, F.coalesce("__s", "__ls")[axis.ts].alias(start), F.coalesce("__e", "__le").alias(end),
        *([F.coalesce("__s", "__ls").alias(first)] if first else []))
