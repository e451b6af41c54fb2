"""Sharding by sampled splitters.

Records are ordered by a key, the hash of the text, then the id, then a number that the staged row carries. Splitters are
quantiles of a sample drawn with a probability that follows the size, so ranges hold about equally many bytes. A record larger than a
range may be is one by itself. A range that came out overfull is cut again by splitters sampled inside it, by rows as well as by size. Ranges then fill the shards in order; the few that a shard's
end falls into are divided record by record, largest first, each to the shard that has most room left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..core.stage import stage
from .common import utf8

#: Rows a range holds about, sample rows per range, and how far over the mean a range may be.
ROWS_PER_RANGE, LEAST_RANGES, OVERSAMPLE, OVERFULL = 100_000, 1_536, 12, 3.0
KEY = ["hash", "doc_id", "row"]


def locate(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted composite splitters are at or below each composite key: binary search on all keys at once."""
    lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(cuts[0]), np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(cuts[0]) - 1)
        below = np.zeros(len(mid), bool)
        for k, c in zip(reversed(keys), reversed(cuts)):
            below = (c[mid] < k) | (c[mid] == k) & (below if k is not keys[-1] else np.ones(len(mid), bool))
        below &= lo < hi
        lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
    return lo


def _ranged(rows: DataFrame, cuts: pd.DataFrame) -> DataFrame:
    values = [cuts[c].to_numpy(np.int64) for c in KEY]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = [f["hash"].to_numpy(np.int64), f["key_id"].to_numpy(np.int64), f["row"].to_numpy(np.int64)]
            yield f.assign(range=locate(keys, values))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, `range` long")


def _quantiles(sample: pd.DataFrame, n: int) -> pd.DataFrame:
    """n - 1 splitters at equal steps of a sample in which every row counts for the same number of bytes, fewer if it is small."""
    s = sample.sort_values(KEY, ignore_index=True)
    if s.empty:
        return s
    at = np.unique((np.arange(1, n) * len(s) / n).astype(int))
    return s.iloc[at[at < len(s)]].drop_duplicates(ignore_index=True)


def _draw(rows: DataFrame, share: float, seed: int, each: float = 0.0) -> pd.DataFrame:
    """Keys drawn with probability ``share * size + each``; a row that deserves several draws gets as many."""
    hits = F.floor(F.col("size") * share + each + F.rand(seed)).cast("int")
    return rows.withColumn("_hits", hits).where("_hits > 0").select("hash", F.col("key_id").alias("doc_id"), "row", "_hits").toPandas().pipe(
        lambda f: f.loc[f.index.repeat(f.pop("_hits"))].reset_index(drop=True))


def _alone(rows: DataFrame, limit: float) -> pd.DataFrame:
    """Splitters right at and right after each row above ``limit`` bytes; these are fewer than the ranges or than four a shard."""
    at = rows.where(F.col("size") > limit).select("hash", F.col("key_id").alias("doc_id"), "row").toPandas()
    return pd.concat([at, at.assign(row=at["row"] + 1)])


def _counts(ranged: DataFrame) -> pd.DataFrame:
    """One row per range: their number is set by this module, not by the records."""
    f = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toPandas()
    return f.sort_values("range", ignore_index=True)


def fill(ranges: pd.DataFrame, shards: int) -> dict[int, list[tuple[int, float]]]:
    """For each range the shards that it reaches into and the bytes that fall to each, in order.

    A row that is more than a shard's share of all that is left has a shard of its own, from the last one on.
    """
    left, own = float(ranges["bytes"].sum()), {}
    for r, b in ranges[ranges["rows"] == 1].sort_values(["bytes", "range"], ascending=[False, True])[["range", "bytes"]].itertuples(index=False):
        if shards == 1 or b * shards <= left:
            break
        shards -= 1
        own[int(r)] = [(shards, float(b))]
        left -= b
    ranges = ranges[~ranges["range"].isin(own)]
    end = ranges["bytes"].cumsum().to_numpy(float)
    edge = left * np.arange(1, shards + 1) / shards
    out = {}
    for r, e, b in zip(ranges["range"], end, ranges["bytes"].to_numpy(float)):
        first = min(int(np.searchsorted(edge, e - b, side="right")), shards - 1)
        last = min(int(np.searchsorted(edge, e, side="left")), shards - 1)
        out[int(r)] = [(k, min(e, edge[k]) - max(e - b, edge[k - 1] if k else 0.0)) for k in range(first, last + 1)]
    return out | own


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``.

    Size is the text's UTF-8 bytes plus 8; a null text has none and the crc32 of no bytes. Equal texts are neighbours in
    the order, so they share a shard unless a shard ends among them. Null ids come first among equal texts; rows that repeat
    are told apart by their staged number. A text larger than a shard's share has one to itself. Fewer rows than shards leave some
    shards empty.
    """
    data = utf8(text)
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                             F.xxhash64(data).alias("hash"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("key_id"),
                             F.monotonically_increasing_id().alias("row")))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = max(1, min(max(LEAST_RANGES, math.ceil(n / ROWS_PER_RANGE)), n // 40))
    limit = OVERFULL * max(total / wanted, 1)
    large = min(limit, total / (4 * shards))
    short = rows.where(F.col("size") <= large)
    joined = lambda *c: pd.concat(c).drop_duplicates().sort_values(KEY, ignore_index=True)
    first = _quantiles(_draw(short, OVERSAMPLE * wanted / max(total, 1), seed), wanted).assign(doc_id=-(1 << 63), row=0)  # equal texts are not parted
    cuts = joined(_alone(rows, large), first)
    while True:
        ranged = stage(_ranged(rows, cuts))
        ranges = _counts(ranged)
        over = ranges[(ranges["bytes"] > limit) & (ranges["rows"] > 40) | (ranges["rows"] > OVERFULL * max(ROWS_PER_RANGE, n / wanted))]
        if over.empty:
            break
        seed += 1
        inside = ranged.where(F.col("range").isin([int(r) for r in over["range"]]))
        parts = int(np.ceil(2 * over["bytes"].sum() / limit)) + len(over) + 1
        more = _draw(inside, OVERSAMPLE / 2 * parts / float(over["bytes"].sum()), seed, OVERSAMPLE / 2 * parts / float(over["rows"].sum()))
        known, cuts = len(cuts), joined(cuts, _quantiles(more, parts))
        if len(cuts) == known:
            break
    parts = fill(ranges, shards)
    split = {r: p for r, p in parts.items() if len(p) > 1}
    whole = docs.sparkSession.createDataFrame([(r, p[0][0]) for r, p in parts.items() if len(p) == 1], "range long, shard int")

    def divide(f: pd.DataFrame) -> pd.DataFrame:
        mine = split[int(f["range"].iloc[0])]
        room, number = np.array([b for _, b in mine]), [k for k, _ in mine]
        f = f.sort_values(["size", "hash", "key_id", "row"], ascending=[False, True, True, True], ignore_index=True)
        at, size = np.empty(len(f), np.int64), f["size"].to_numpy()
        equal = sorted(f.groupby("hash").indices.items(), key=lambda x: (-size[x[1]].sum(), x[0]))
        ends = {f["hash"].max(): len(room) - 1, f["hash"].min(): 0}  # may go on in the ranges beside this one
        for h, rows_ in sorted(equal, key=lambda x: x[0] not in ends):
            k = ends.get(h, int(room.argmax()))
            k = k if size[rows_].sum() <= room[k] else int(room.argmax())
            if size[rows_].sum() <= room[k]:
                at[rows_] = k
                room[k] -= size[rows_].sum()
            else:  # no shard has room for all of them
                for i in rows_:
                    at[i] = k = int(room.argmax())
                    room[k] -= size[i]
        return f.assign(shard=np.array(number, np.int32)[at])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)
    parted = ranged.where(F.col("range").isin(list(split))).groupBy("range").applyInPandas(divide, f"{kinds}, shard int")
    placed = stage(ranged.join(whole, "range").select(*ranged.columns, "shard").unionByName(parted))
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("shard", "range").orderBy("hash", "key_id", "row")
    return (placed.withColumn("_k", F.row_number().over(order) - 1).join(base, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_k")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
