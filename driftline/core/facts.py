"""Attaching a one-row table of facts (a global maximum, a count, a threshold) to every row."""

from pyspark.sql import DataFrame, functions as F


def with_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the columns of ``facts``, the result of an aggregate without keys, so exactly one row; it is broadcast."""
    one = facts.withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")
