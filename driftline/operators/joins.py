"""As-of joins, lookup chains and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core.axis import Axis
from ..core.scan import scan
from ..schema import seconds_between


def asof(
    left: DataFrame, right: DataFrame, axis: Axis, right_ts: str, take: list[str], tolerance_s: float | None = None,
    direction: str = "nearest", prefix: str = "", tie: str | None = None,
) -> DataFrame:
    """Join each left row to the nearest (or last preceding) right row of its entity.

    Both sides are stacked and scanned once along the axis, so it costs one shuffle and no range join.
    Equal times match; a tie in distance goes to the earlier row; beyond ``tolerance_s`` all is null.
    ``axis.ts`` is the left time column. Adds ``prefix + column`` for ``take``, plus ``prefix + 'dt_s'``.
    """
    keys = list(axis.keys)
    extra = [tie] if tie else []
    payload = F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in extra if c not in take], *take)
    l = left.select(*keys, F.col(axis.ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"),
                    F.struct(*axis.order[1:]).alias("__u") if axis.order[1:] else F.xxhash64(*left.columns).alias("__u"))
    r = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), payload.alias("__r"),
                     F.col(tie).alias("__k") if tie else F.lit(0).alias("__k"))
    both = l.unionByName(r, allowMissingColumns=True)
    ax = axis.with_(order=("__t", "__side", "__k", "__u"))
    fills = {"ffill": {"__b": "__r"}}
    if direction == "nearest":
        fills["bfill"] = {"__f": "__r"}
    s = scan(both, ax, **fills).where(F.col("__side") == 1)
    back = F.abs(seconds_between(F.col("__b.__rts"), F.col("__t")))
    if direction == "nearest":
        ahead = F.abs(seconds_between(F.col("__t"), F.col("__f.__rts")))
        pick = F.when(F.col("__f").isNull() | (back <= ahead), F.col("__b")).otherwise(F.col("__f"))
    else:
        pick = F.col("__b")
    s = s.withColumn("__m", pick)
    dt = seconds_between(F.col("__t"), F.col("__m.__rts"))
    if tolerance_s is not None:
        s = s.withColumn("__m", F.when(F.abs(dt) <= tolerance_s, F.col("__m")))
    return s.select("__l.*", *[F.col(f"__m.{c}").alias(prefix + c) for c in take], dt.alias(f"{prefix}dt_s"))


def first_match(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``: a map-side-combined ``min_by`` rather than a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f")).select(key, "__f.*")


def lookup_chain(df: DataFrame, hops: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Resolve an id through successive tables; ``match_status`` names the first hop that missed.

    ``hops``: (table, id column looked up, key column in the table, reason). Tables hold one row per key
    (see ``first_match``). Broadcasts are left to Spark's own size check.
    """
    out = df
    status = F.lit("ok")
    reasons = []
    for i, (table, col, key, reason) in enumerate(hops):
        mark = f"__hit{i}"
        t = table.withColumnRenamed(key, f"__key{i}").withColumn(mark, F.lit(True))
        out = out.join(t, F.col(col) == F.col(f"__key{i}"), "left").drop(f"__key{i}")
        reasons.append((mark, reason))
    for mark, reason in reversed(reasons):
        status = F.when(F.col(mark).isNull(), F.lit(reason)).otherwise(status)
    return out.withColumn("match_status", status).drop(*[m for m, _ in reasons])


def resolve_relations(df: DataFrame, id_col: str, ids: str, names: DataFrame, name_key: str, name: str, out: str) -> DataFrame:
    """Replace an array of related ids by the array of their names, in array order, unknown ids dropped."""
    e = df.select(id_col, F.posexplode(ids).alias("__p", "__id"))
    named = e.join(names.select(F.col(name_key).alias("__id"), F.col(name).alias("__name")), "__id").groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", "__name"))), lambda x: x["__name"]).alias(out))
    return df.join(named, id_col, "left")


def overlay(base: DataFrame, updates: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Lay updated columns over a baseline by key; the last duplicate update wins, missing ones keep the base."""
    u = updates.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__u"))
    j = base.join(u, key, "left")
    return j.select(*[F.coalesce(F.col(f"__u.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def outer_merge(frames: list[DataFrame], on: list[str], order: str | None = None) -> DataFrame:
    """Full outer merge of sensor frames on entity and time, one row per instant and frame: the smallest by ``order``, then by
    all columns in order."""
    out = None
    for f in frames:
        rest = [c for c in f.columns if c not in on]
        first = [order] if order in rest else []
        one = f.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*first, *rest)).alias("__r")).select(*on, "__r.*")
        out = one if out is None else out.join(one, on, "full")
    return out


def binned_inner(left: DataFrame, right: DataFrame, keys: list[str], bin_s: float, means: dict[str, tuple[str, str]]) -> DataFrame:
    """Means of both signals in time bins that both have: output -> (side's time column, value column), sides in order.

    Each side is reduced to one row per bin (combined map-side) before they are joined.
    """
    from .timebase import bucket
    parts = [df.groupBy(*keys, bucket(ts, bin_s).alias("bin_ts")).agg(F.avg(v).alias(out)) for df, (out, (ts, v)) in zip((left, right), means.items())]
    return parts[0].join(parts[1], [*keys, "bin_ts"])


def greedy_match(truth: DataFrame, found: DataFrame, axis: Axis, tol_s: float) -> DataFrame:
    """One-to-one matching in time order within ±tol: two sorted lists consumed from the front.

    Both sides are stacked and folded along the axis; the state is the queue of times still waiting on one
    side, never longer than the events that fit into the tolerance. Returns the stacked rows with ``verdict``
    tp / fp / fn: a waiting row that gets a partner is reported on the partner's row as well.
    """
    from .folds import match_in_order
    return match_in_order(truth, found, axis, tol_s)
