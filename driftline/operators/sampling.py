"""Sorts, limits and subsamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core.facts import with_facts
from ..core.axis import Axis
from ..core.scan import scan
from ..core.stage import stage


def stable_sort(df: DataFrame, columns: list[str], tiebreak: str) -> DataFrame:
    """Ascending sort with nulls last and a unique tiebreak."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in columns], F.asc(tiebreak))


def sort_positions(df: DataFrame, columns: list[str], tiebreak: str, out: str = "position") -> DataFrame:
    """Each row's place (from 0) in ``stable_sort``'s order.

    Rows are range-partitioned by the order itself and numbered inside their part; the parts before it, one row each, give the rest.
    """
    order = [*[F.asc_nulls_last(c) for c in columns], F.asc(tiebreak)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    here = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return d.withColumn(out, here).join(base, "__part").withColumn(out, (F.col(out) + F.col("__base")).cast("bigint")).drop("__part", "__base")


def hash_share(seed: int, id_col: str) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def nth_candidate(df: DataFrame, axis: Axis, kept: Column, n: int) -> DataFrame:
    """The n-th kept row of each entity (1-based), or its last when there are fewer."""
    keys = list(axis.keys)
    k = df.where(F.coalesce(kept, F.lit(False)))
    s = scan(k, axis, index="__i", nxt={"__more": F.lit(1)})
    return s.where((F.col("__i") == n - 1) | (F.col("__more").isNull() & (F.col("__i") < n - 1))).drop("__i", "__more")


def even_subsample(df: DataFrame, axis: Axis, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows per entity at evenly spaced positions, first and last included."""
    keys = list(axis.keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    s = scan(df, axis, index="__i").join(n, keys)
    span, m = F.col("__n") - 1, max_rows - 1
    if m < 1:
        return s.where("__i = 0").drop("__i", "__n")
    j = F.ceil(F.col("__i") * m / span)  # the slot whose position floor(j*span/m) could be this row
    hit = (F.floor(j * span / m) == F.col("__i")) & (j <= m)
    return s.where((F.col("__n") <= max_rows) | hit).drop("__i", "__n")


def hash_downsample(df: DataFrame, label: str, majority, ratio: float, id_col: str, seed: int = 42) -> DataFrame:
    """Keep the minority whole and about ``ratio`` times as many majority rows, chosen by a seeded hash of the id.

    Fully distributed: the cut is a threshold on the hash, taken from the two class counts.
    """
    c = df.agg(F.count_if(F.col(label) == majority).alias("__maj"), F.count_if(F.col(label) != majority).alias("__min"))
    u = hash_share(seed, id_col)
    share = F.least(F.lit(1.0), F.try_divide(F.col("__min") * ratio, F.col("__maj")))
    return with_facts(df, c).where((F.col(label) != majority) | (u < share)).drop("__maj", "__min")


def top_reasons(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """Most frequent reasons of a pipe-separated column, by name on ties."""
    e = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"\|")).alias("reason"))
    return e.withColumn("reason", F.trim("reason")).where(F.col("reason") != "").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)
