"""Approximate nearest neighbours with learned partitions.

A bounded sample's neighbour graph is partitioned into equal parts with few cut edges; a small classifier learns the part
from the vector. All rows are indexed by their likeliest part, queries go to the few likeliest ones, and what they find
there is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.stage import stage
from .common import pieces
from .topk import drop_dominated, matrix

#: Documented bounds of the fit: sampled vectors, of which every eighth only validates; graph degree.
SAMPLE, DEGREE = 8_192, 10
HIDDEN = 128


def usable(embedding: str) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Nearest ``degree`` of each unit vector, in blocks."""
    out = []
    for a in range(0, len(x), 1_024):
        s = x[a:a + 1_024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out.append(np.argpartition(-s, min(degree, len(x) - 1), axis=1)[:, :degree])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Equal parts of the graph: halves along principal directions, then rounds in which nodes move, best gain first, to the
    part that most of their neighbours are in, as far as sizes stay within a twentieth of the mean."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        sub = x[rows] - x[rows].mean(0)
        order = rows[np.argsort(sub @ np.linalg.svd(sub.T @ sub)[0][:, 0], kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    edge_from, edge_to = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    most, least = int(np.ceil(1.05 * len(x) / parts)), int(0.95 * len(x) / parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (edge_from, part[edge_to]), 1)
        np.add.at(votes, (edge_to, part[edge_from]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Classifier with one hidden layer; fixed size whatever the corpus."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x[:, :self.w1.shape[0]]
        if x.shape[1] < self.w1.shape[0]:
            x = np.pad(x, ((0, 0), (0, self.w1.shape[0] - x.shape[1])))
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def train_router(x: np.ndarray, y: np.ndarray, parts: int, rounds: int = 40, seed: int = 3) -> Router:
    """Cross-entropy with Adam on small batches."""
    g = np.random.default_rng(seed)
    p = [g.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    scale = x.shape[1] ** 0.5
    for _ in range(rounds):
        order = g.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a:a + 256]
            xi = x[i] * scale
            h = np.maximum(xi @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(i)), y[i]] -= 1
            e /= len(i)
            back = (e @ p[2].T) * (h > 0)
            t += 1
            for k, d in enumerate((xi.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= 2e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return Router(p[0] * scale, p[1], p[2], p[3], parts)


def fit(sample: np.ndarray, parts: int, k: int, recall: float = 0.93) -> Router:
    """Graph, parts and classifier from the sample; the number of parts that a query visits is the least with which held-out
    rows find the wanted share of their true neighbours, and more by what the share may be off on so few rows."""
    x = unit(sample)
    held = np.arange(len(x)) % 8 == 7
    base = x[~held]
    parts = max(1, min(parts, len(base) // 32))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbour_graph(base, DEGREE)
    router = train_router(base, balanced_parts(base, near, parts), parts)
    q = x[held]
    home = router.route(base, 1)[:, 0]
    true = np.argsort(-(q @ base.T), axis=1)[:, :k]
    route = router.route(q, parts)
    place = np.argsort(route, axis=1)  # place of each part in a query's order
    need = np.take_along_axis(place, home[true], axis=1)
    found = [(need < p).mean() for p in range(1, parts + 1)]
    wanted = min(1.0, recall + need.size ** -0.5)
    router.probes = 1 + int(np.argmax(np.array(found) >= wanted))
    return router


def evened(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: squares neither overflow nor vanish, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of rows in doubles; the same two vectors give the same value wherever they stand."""
    q, c = evened(q), evened(c)
    return (q * c).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((c * c).sum(-1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, parts_per_root: float = 0.36, most_parts: int = 256, per_block: int = 4_096, most_queries: int = 4_096) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for each query; both tables are ``vec_id, v`` of doubles.

    Parts grow with the root of the number of rows up to ``most_parts``, a bound of the classifier. A part's rows are dealt to blocks of about
    ``per_block``, the queries that go there to blocks of about ``most_queries``, and each two of these meet in a group of bounded size.
    Rows without an id take no part, wholly equal rows count once, vectors of unequal length are compared as if the
    shorter ended in zeros.
    """
    vectors = stage(drop_dominated(vectors.where("vec_id IS NOT NULL"), k))
    queries = queries.where("vec_id IS NOT NULL").distinct()
    n = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if drawn.empty:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(matrix(drawn["v"], max(map(len, drawn["v"]))), max(1, min(most_parts, int(parts_per_root * n ** 0.5))), k)

    def routed(count: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                to = router.route(unit(matrix(f["v"], max(map(len, f["v"])))), count) if len(f) else np.zeros((0, count), int)
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "parts": list(to.astype(np.int32))})
        return run

    kinds = "vec_id long, v array<double>, parts array<int>"
    indexed = stage(vectors.mapInPandas(routed(1), kinds).select("vec_id", "v", F.col("parts")[0].alias("part")))
    blocks = indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))  # a row per part
    routed_to = stage(queries.mapInPandas(routed(router.probes), kinds).select("vec_id", "v", F.explode("parts").alias("part")))
    crowds = routed_to.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most_queries).cast("int").alias("crowds"))  # a row per part
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = F.broadcast(blocks.join(crowds, "part"))
    c = indexed.join(sized, "part").select("vec_id", "v", "part", dealt("blocks").alias("cb"), every("crowds").alias("qb"))
    asked = routed_to.join(sized, "part").select("vec_id", "v", "part", dealt("crowds").alias("qb"), every("blocks").alias("cb"))

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            width = max(len(v) for f in (a, b) for v in f["v"])
            x, ids = matrix(a["v"], width).astype(float), a["vec_id"].to_numpy()
            near = unit(x)
            for s in range(0, len(b), 512):
                q, own = matrix(b["v"].iloc[s:s + 512], width).astype(float), b["vec_id"].to_numpy()[s:s + 512]
                rough = unit(q) @ near.T
                rough[own[:, None] == ids[None, :]] = -9
                floor = -np.partition(-rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] - 1e-9
                row, at = np.nonzero((rough >= floor[:, None]) & (rough > -5))
                cut = np.array_split(np.arange(len(row)), len(row) // 100_000 + 1)
                score = np.concatenate([cosine(q[row[p]], x[at[p]]) for p in cut])
                order = np.lexsort((ids[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query_id": own[row[top]], "vec_id": ids[at[top]], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, int), "vec_id": np.empty(0, int), "score": np.empty(0)})

    found = c.groupBy("part", "cb", "qb").cogroup(asked.groupBy("part", "cb", "qb")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
