"""Exact quantiles, modes and spread of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Share of a group's rows on either side of a wanted rank within which the exact value is looked for, and the sketch's
#: accuracy, which places the ends of that stretch within a tenth of it.
MARGIN, ACCURACY = 0.002, 5_000
#: Below this many rows the margin holds no whole rank on either side, so the stretch is the whole group.
FEW = 4_000


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` of doubles that are not null, rounded once; Spark has no function for it, the JVM does."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (linear rule) of ``value`` per group; nulls are ignored. Both neighbours are weighed, so the median of
    19.99 and 20.01 is 20, where their difference, rounded, would end below; and their sum is rounded once, as DuckDB does, so the 80 %
    quantile between two equal values is that value (low quantiles of groups up to ten rows may end a last bit above, there as here).

    One plan and no group gathered: a mergeable sketch gives values that surely lie below and above each wanted rank; rows
    are then counted by value, all lower ones as one, higher ones not at all (combined map-side), and the running count over
    the few values between picks the two neighbours of the rank. A sketch that missed its bound is an error, never a
    wrong value.
    """
    if not keys:
        return quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, qs).drop("__all")
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    names, ps = list(qs), [float(q) for q in qs.values()]
    ends = [F.lit(min(max(p + s, 0.0), 1.0)) for p in ps for s in (-MARGIN, MARGIN)]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                             F.percentile_approx("__v", F.array(*ends), ACCURACY).alias("__a"))
    few = F.col("__n") < FEW
    wanted = F.array(*[F.struct(F.lit(i).alias("__q"), F.lit(p).alias("__p"), F.when(few, F.col("__min")).otherwise(F.col("__a")[2 * i]).alias("__lo"),
                                F.when(few, F.col("__max")).otherwise(F.col("__a")[2 * i + 1]).alias("__hi")) for i, p in enumerate(ps)])
    g = g.select(*keys, "__n", F.inline(wanted))
    near = (d.join(g, keys).where(F.col("__v") <= F.col("__hi"))
            .groupBy(*keys, "__q", "__p", "__n", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__x")).agg(F.count(F.lit(1)).alias("__c")))
    upto = F.sum("__c").over(W.partitionBy(*keys, "__q").orderBy(F.col("__x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    rank = F.col("__p") * (F.col("__n") - 1)
    at = lambda k: F.max(F.when((F.col("__to") > k) & (F.col("__to") - F.col("__c") <= k), F.col("__x")))
    got = (near.withColumn("__to", upto).groupBy(*keys, "__q").agg(at(F.floor(rank)).alias("__x0"), at(F.ceil(rank)).alias("__x1"), F.max(rank - F.floor(rank)).alias("__w")))
    mixed = F.when(F.col("__x0").isNull() | F.col("__x1").isNull(), F.raise_error(F.lit("quantile sketch missed its bound")).cast("double")).otherwise(fused(F.col("__x0"), 1 - F.col("__w"), F.col("__x1") * F.col("__w")))
    return got.withColumn("__y", mixed).groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == i, F.col("__y"))).alias(n) for i, n in enumerate(names)])


def median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})


def modes(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties; counted before it is compared."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    best = c.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__c")).alias("c"), F.col(value).alias("v"))).alias(out))
    return best


def steady_mean(value: Column | str) -> Column:
    """Mean that does not depend on the order of the rows: exact where all values have at most 20 decimals and lie below 1e12, so that groups
    of equal means are equal to the last bit and rank alike, and a value repeated is its own mean; else the mean of the doubles."""
    v = F.col(value) if isinstance(value, str) else value
    exact = v.try_cast("decimal(32,20)")
    return F.coalesce(F.when(F.bool_and(exact.cast("double").eqNullSafe(v)), F.try_avg(exact).cast("double")), F.avg(v))


def ordered_means(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Means per group, named by ``values`` (name to column), whose rows are added one by one in ``order``: the same to the last bit however rows are
    dealt, and as a sum over rows stored in that order. A group is sorted and run through, not gathered. Nulls are ignored."""
    run = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.select(*keys, *[c for c in order if c not in keys], *[F.col(c).cast("double").alias(f"__v_{n}") for n, c in values.items()])
    d = d.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(run) for n in values})
    last = F.struct(*order)
    return d.groupBy(*keys).agg(*[F.try_divide(F.max_by(f"__s_{n}", last), F.count(f"__v_{n}")).alias(n) for n in values])
