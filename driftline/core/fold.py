"""Order-dependent folds on an axis, exact and without a whole entity in one task.

Each chunk is folded as a grouped map from an entry state. Entry states start empty and are replaced by
the exit state of the preceding chunk until no entry changes: then every chunk was folded from the very
state a single left-to-right pass would have handed to it. Folds that forget quickly settle in two rounds;
entities of one chunk need none. The state table (one row per chunk) is checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .axis import CHUNK, Axis
from .halo import doubles
from .stage import ensure_checkpoint_dir, settle

# (columns of one chunk in order as lists, entry state or None) -> (one output per row, exit state)
FoldFn = Callable[[dict[str, list], "list[float] | None"], "tuple[list, list[float] | None]"]


def chunked_fold(df: DataFrame, axis: Axis, inputs: list[str], fn: FoldFn, out: str) -> DataFrame:
    """Add the boolean or null ``out``, the per-row result of folding ``fn`` along the axis over the ``inputs`` columns."""
    ensure_checkpoint_dir(df.sparkSession)
    df = settle(df, 2)  # read once per round
    keys, order = list(axis.keys), list(axis.order)
    rows = df.withColumn(CHUNK, axis.chunk(df))
    group = [*keys, CHUNK]
    need = list(dict.fromkeys([*group, *order, *inputs]))
    state_t = T.ArrayType(T.DoubleType())
    result_columns = list(df.columns)

    def ordered(t: pa.Table):
        t = t.sort_by([(o, "ascending") for o in order])
        return t, {c: doubles(t, c).tolist() for c in inputs}, t["__entry"][0].as_py()

    def exits(t: pa.Table) -> pa.Table:
        t, x, entry = ordered(t)
        one = t.slice(0, 1).select(group)
        return one.append_column("__exit", pa.array([fn(x, entry)[1]], type=pa.list_(pa.float64())))

    def results(t: pa.Table) -> pa.Table:
        t, x, entry = ordered(t)
        return t.select(result_columns).append_column(out, pa.array(fn(x, entry)[0], type=pa.bool_()))

    chunks = W.partitionBy(*keys).orderBy(CHUNK)
    exit_schema = T.StructType([*[rows.schema[c] for c in group], T.StructField("__exit", state_t)])
    src = rows.select(*need)
    many = src.select(*group).distinct().withColumn("__c", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("__c > 1").select(*group)
    many = many.checkpoint()
    states = many.withColumn("__entry", F.lit(None).cast(state_t))
    if not many.isEmpty():
        todo, done = states, None
        while True:  # each round settles at least one more chunk of every entity
            got = src.join(todo, group).groupBy(*group).applyInArrow(exits, exit_schema)
            if done is not None:
                got = got.unionByName(done.join(todo.select(*group), group, "left_anti"))
            done = got.checkpoint()
            nxt = done.select(*group, F.lag("__exit").over(chunks).alias("__next"))
            todo = states.join(nxt, group).where(~F.col("__next").eqNullSafe(F.col("__entry"))).select(
                *group, F.col("__next").alias("__entry"))
            states = nxt.withColumnRenamed("__next", "__entry")
            if todo.isEmpty():
                break
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])
    return rows.join(states, group, "left").groupBy(*group).applyInArrow(results, schema)
