"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum over m slices of the vector, each slice a list of local scores. Phase 1 takes the head of every local
list and the exact totals of what it finds; the k-th best of these is a safe cutoff t. Whoever reaches t has t / m or more in
at least one slice, so phase 2 collects the entries above that uniform threshold, bounds their totals from what the
slices gave, and phase 3 resolves exactly those whose bound still reaches the cutoff.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.stage import stage
from .common import pieces

#: Scores from here on, and below its negative, do not fit; they rank as this number.
LARGEST = (1 << 63) - 1
SLICES, HEAD = 2, 24


def scaled(embedding: str, factor: int = 256) -> tuple[Column, Column]:
    """(vector as floor(factor * x), whole numbers in doubles, whether it takes part: without nulls, all finite)."""
    v = F.col(embedding)
    ok = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))

    def whole(x: Column) -> Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)  # doubles from there on are whole

    return F.transform(v, whole), ok


def drop_dominated(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """Rows ``vec_id, v`` without those that cannot be among anyone's k nearest: of equal vectors, which score alike and
    lose ties to smaller ids, the k + 1 smallest ids remain, one more than k because a query passes over itself.

    Wholly equal rows count once. A frequent vector is reduced within salted groups first.
    """
    r = rows.distinct().withColumn("_h", F.xxhash64("v")).withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    for by in (["_h", "v", "_s"], ["_h", "v"]):
        r = r.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    return r.select("vec_id", "v")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    m = np.zeros((len(column), width), np.asarray(column.iloc[0]).dtype if len(column) else np.int64)
    for i, v in enumerate(column):
        m[i, :len(v)] = v
    return m


def _width(*columns: pd.Series) -> int:
    return max((len(v) for c in columns for v in c), default=0)


def _partials(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Exact partial scores of each slice, in doubles while whole numbers stay exact there; else the first has the whole
    score and the others nothing."""
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2.0 ** 53
    if not safe:
        total = _large(q, c)
        return [total] + [np.zeros_like(total)] * (slices - 1)
    cut = np.array_split(np.arange(q.shape[1]), slices)
    q, c = q.astype(float), c.astype(float)
    return [(q[:, x] @ c[:, x].T).astype(np.int64) for x in cut]


def _wrapped(m: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as longs."""
    if m.dtype.kind == "i":
        return m.astype(np.int64)
    r = np.fmod(m, 2.0 ** 64)
    return np.where(r >= 2.0 ** 63, r - 2.0 ** 64, np.where(r < -2.0 ** 63, r + 2.0 ** 64, r)).astype(np.int64)


def _large(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact scores, those beyond ``LARGEST`` as plus or minus this number.

    Sums of longs wrap, so they are right wherever the score fits. Doubles tell where it does; what their error leaves open
    is summed in Python's integers.
    """
    with np.errstate(all="ignore"):
        out = _wrapped(q) @ _wrapped(c).T
        x, y = q.astype(float), c.astype(float)
        near, error = x @ y.T, (np.abs(x) @ np.abs(y).T) * ((q.shape[1] + 8) * 2.0 ** -52)
        over, under, fits = near - error > 2.0 ** 63, near + error < -2.0 ** 63, np.abs(near) + error < 2.0 ** 63 * (1 - 2.0 ** -40)
    out[over], out[under] = LARGEST, -LARGEST
    for i, j in zip(*np.nonzero(~(over | under | fits))):
        out[i, j] = min(max(sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist())), -LARGEST), LARGEST)
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int = SLICES, per_block: int = 4_096, per_query_block: int = 1_024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of ``vectors`` for each of ``queries``, both ``vec_id, v`` of whole numbers
    (longs or doubles).

    Rows meet in blocks of bounded size; a query's own id is no candidate. Rows without an id take no part. Fewer than k
    candidates give fewer rows, and vectors of unequal length are compared as if the shorter ended in zeros. A score among the k
    best that does not fit a long (``LARGEST`` counts as beyond) is an error.
    """
    vectors = stage(drop_dominated(vectors.where("vec_id IS NOT NULL"), k))
    queries = stage(queries.where("vec_id IS NOT NULL").distinct())
    blocks, qblocks = pieces(vectors.count(), per_block), pieces(queries.count(), per_query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("cb"), every(qblocks).alias("qb"))

    def asked(q: DataFrame) -> DataFrame:
        return q.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(qblocks)).cast("int").alias("qb"), every(blocks).alias("cb"))

    def meet(q: DataFrame, fn, schema: str) -> DataFrame:
        return c.groupBy("cb", "qb").cogroup(asked(q).groupBy("cb", "qb")).applyInPandas(fn, schema)

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        width = _width(a["v"], b["v"])
        ids, own = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        return ids, own, _partials(matrix(b["v"], width), matrix(a["v"], width), slices), own[:, None] != ids[None, :]

    def heads(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Phase 1: exact totals of the entries that head a local list, the k best of each query."""
        out = []
        if len(a) and len(b):
            ids, own, parts, may = scored(a, b)
            total = sum(parts)
            for i in range(len(own)):
                at = np.flatnonzero(may[i])
                top = np.unique(np.concatenate([at[np.argpartition(-p[i][at], HEAD)[:HEAD]] if len(at) > HEAD else at for p in parts]))
                t = np.sort(total[i][top])[::-1][:k]
                out.append(pd.DataFrame({"vec_id": own[i], "total": t}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "total": []}).astype("int64")

    def resolve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Phases 2 and 3: entries above the uniform threshold, bounded, then resolved."""
        out = []
        if len(a) and len(b):
            ids, own, parts, may = scored(a, b)
            for i, cut in enumerate(b["cutoff"].to_numpy()):
                at = np.flatnonzero(may[i])
                if not np.isnan(cut):
                    local = np.stack([p[i] for p in parts])
                    known = local >= cut / slices
                    at = at[known[:, at].any(0)]
                    bound = np.where(known[:, at], local[:, at], cut / slices).sum(0)
                    at = at[bound >= cut]
                s = sum(p[i][at] for p in parts)
                top = best(ids[at], s, k)
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at][top], "score": s[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    order = Window.partitionBy("vec_id").orderBy(F.col("total").desc())
    cutoff = (meet(queries, heads, "vec_id long, total long").withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k)
              .select("vec_id", (F.col("total") - F.abs("total") * F.lit(1e-12)).cast("double").alias("cutoff")))  # safe in doubles
    found = meet(queries.join(stage(cutoff), "vec_id", "left"), resolve, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    fitting = F.when(F.abs("score") < LARGEST, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("score does not fit a long: vectors "), "query_id", F.lit(", "), "vec_id")).cast("long"))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fitting.alias("score"))
