"""Near-duplicate detection with fast similarity sketches, banding and exact verification.

Sketch: in round i every shingle falls into one bin and brings the value (i, hash); a bin keeps its least value, so what
came in an earlier round wins. After as many rounds as bins, an empty bin takes its least value over all shingles, so
every coordinate is filled. Equal sets meet first, as one class; classes that share a band are compared with the band's
smallest member; those it left in different components then meet in blocks. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..core.stage import stage
from .common import bounded_batches, utf8

WORDS = 5
SIZE = 160
OF = 100
PER_GROUP = 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; overflow wraps."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def _seeds(n: int, start: int) -> np.ndarray:
    return _mix(np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_PLACE = _seeds(WORDS, 1_000) | np.uint64(1)
_ROUND = _seeds(2 * SIZE, 2_000)
_ROW = _seeds(SIZE, 3_000) | np.uint64(1)
_BAND = _seeds(SIZE, 4_000)


@dataclass(frozen=True)
class Law:
    """What a link of ``link`` hundredths of similarity or more asks for: rows of a band, and coordinates (of SIZE, compared
    by 8 bits) that must agree before sets are fetched."""

    link: int
    rows: int
    agree: int


def law(link: int) -> Law:
    """At a similarity of ``link / OF`` a pair shares no band with a probability of at most 1e-8, the longest bands that
    do so, and too few of its coordinates agree with a probability of at most 1e-10."""
    t = link / OF
    rows = max((r for r in range(1, SIZE + 1) if SIZE % r == 0 and (1 - t ** r) ** (SIZE // r) <= 1e-8), default=1)
    below = np.cumsum([comb(SIZE, k) * t ** k * (1 - t) ** (SIZE - k) for k in range(SIZE)])
    return Law(link, rows, int((below <= 1e-10).sum()))


def shingles(data: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; one for a shorter text, none without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix((h * _PLACE[:len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[:len(h) - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        total = total + h[k:len(h) - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(total))


def sketch(items: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set: the round in the upper, the hash in the lower 32 bits."""
    out = np.zeros(SIZE, np.uint64)
    filled = np.zeros(SIZE, bool)
    at, step = 0, max(1, min(SIZE, 1200 // len(items)))
    while at < SIZE and not filled.all():
        step = min(step, SIZE - at)
        h = _mix(items[None, :] ^ _ROUND[at:at + step, None])
        place = ((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        rounds = np.arange(at, at + step, dtype=np.uint64)[:, None]
        key = np.sort((place << np.uint64(44) | rounds << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).ravel())
        bins = (key >> np.uint64(44)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        bins, value = bins[first], key[first] & np.uint64((1 << 44) - 1)
        fresh = ~filled[bins]
        out[bins[fresh]], filled[bins[fresh]] = value[fresh], True
        at += step
    for j in np.flatnonzero(~filled):
        out[j] = np.uint64(SIZE + j) << np.uint64(32) | (_mix(items ^ _ROUND[SIZE + j]) & np.uint64(0xFFFFFFFF)).min()
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, the band's number mixed in."""
    return _mix((_mix(coordinates).reshape(-1, rows) * _ROW[:rows]).sum(1) ^ _BAND[:SIZE // rows])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def describe(docs: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, hash of the text, set size, 128-bit set fingerprint, band keys, and the sketch cut to 8 bits a coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo, keys, short = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t)
                n.append(len(s))
                fp = xxhash.xxh3_128_intdigest(s.tobytes())
                hi.append(fp >> 64), lo.append(fp & (1 << 64) - 1)
                if len(s):
                    c = sketch(s)
                    keys.append(bands(c, rows)), short.append(_mix(c).astype(np.uint8).tobytes())
                else:
                    keys.append(np.empty(0, np.uint64)), short.append(b"")
            flat = _signed(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(_signed(np.array(hi, np.uint64))), pa.array(_signed(np.array(lo, np.uint64))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(short, pa.binary())],
                names=["doc_id", "text_hash", "n", "hi", "lo", "keys", "sketch"])

    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), utf8(text).alias("_b")).mapInArrow(
        run, "doc_id long, text_hash long, n long, hi long, lo long, keys array<long>, sketch binary")


def _agree(pairs: DataFrame, nodes: DataFrame, law: Law) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    a = nodes.select(F.col("rep").alias("center"), F.col("n").alias("_n1"), F.col("sketch").alias("_s1"))
    b = nodes.select(F.col("rep").alias("member"), F.col("n").alias("_n2"), F.col("sketch").alias("_s2"))
    near = (pairs.join(b, "member").join(a, "center")
            .where((OF * F.least("_n1", "_n2") >= law.link * F.greatest("_n1", "_n2"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s, t = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
            yield x.select([0, 1]).filter(pa.array((s == t).sum(1) >= law.agree))

    return near.select("center", "member", "_s1", "_s2").mapInArrow(run, "center long, member long")


def fetch(docs: DataFrame, wanted: DataFrame, node: str, doc_id: str, text: str) -> DataFrame:
    """``wanted`` (a row per ``node``) with ``_b``, the node's text, packed: all texts meet the ids in a shuffle, in which
    zstandard takes about two thirds of the bytes that Spark's own block compression does."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(t) for t in b.column(1).to_pylist()], pa.binary())], names=[node, "_b"])

    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias(node), utf8(text).alias("_b"))
    return texts.mapInArrow(pack, f"{node} long, _b binary").join(wanted, node)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    d = zstandard.ZstdDecompressor()
    return (d.decompress(t) for t in column.to_pylist())


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, law: Law, doc_id: str, text: str) -> DataFrame:
    """Those of the pairs ``center, member`` that the full sets link.

    Sets are made from the whole texts of the documents concerned. A center's members are dealt to groups of about
    PER_GROUP, each of which gets a copy of the center's set, so no center is too popular for a task.
    """
    pairs = stage(_agree(pairs, nodes, law))
    size = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).alias("_groups"))
    member = pairs.join(size, "center").select("member", F.struct("center", F.pmod(F.xxhash64("member"), F.col("_groups")).alias("group")).alias("_to"))
    own = (size.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)))
           .select(F.col("center").alias("member"), F.struct("center", "group").alias("_to")))
    wanted = member.unionAll(own).groupBy("member").agg(F.collect_list("_to").alias("_to"))
    texts = fetch(docs, wanted, "member", doc_id, text)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for who, data, to in zip(b.column(0).to_pylist(), unpacked(b.column(1)), b.column(2).to_pylist()):
                s = shingles(data).tobytes()
                step = max(1, (1 << 22) // (len(s) + 1))
                for i in range(0, len(to), step):
                    part = to[i:i + step]
                    yield pa.RecordBatch.from_arrays([pa.array([x["center"] for x in part], pa.int64()), pa.array([x["group"] for x in part], pa.int64()),
                                                      pa.array([who] * len(part), pa.int64()), pa.array([s] * len(part), pa.binary())], names=["center", "group", "member", "items"])

    def links(f: pd.DataFrame) -> pd.DataFrame:
        own = f["member"] == f["center"]
        hub = [np.frombuffer(x, np.uint64) for x in f["items"][own]]
        hit = []
        for c, m, x in zip(f["center"][~own], f["member"][~own], f["items"][~own]):
            x = np.frombuffer(x, np.uint64)
            for h in hub:
                both = int((h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x).sum()) if len(h) else 0
                if OF * both >= law.link * (len(h) + len(x) - both) and both:
                    hit.append((c, m))
                    break
        return pd.DataFrame(hit, columns=["center", "member"], dtype="int64")

    return (texts.select("member", "_b", "_to").mapInArrow(sets, "center long, group long, member long, items binary")
            .groupBy("center", "group").applyInPandas(links, "center long, member long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root``, the smallest node reachable, for all nodes on ``u, v`` edges: alternating large and small stars until
    nothing changes. Both only join minima to edges; a hub's edges can be split among tasks."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    edges = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(down, "u")
        edges = stage(small.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionAll(small.select("u", F.col("_m").alias("v"))).where("u != v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))


def in_block_pairs(nodes: DataFrame, per_block: int) -> DataFrame:
    """Deals the rows of each ``cluster`` to blocks ``own`` of about ``per_block`` and copies them to every pair of blocks
    ``b1 <= b2`` that holds their block, so that each two rows meet in a group of bounded size."""
    size = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_b"))
    n = nodes.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_b")).cast("int"))
    return (n.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
            .withColumn("b1", F.least("own", "_o")).withColumn("b2", F.greatest("own", "_o")).drop("_o", "_b"))


def _forest(pairs: np.ndarray, group: np.ndarray) -> list[int]:
    """Places of those pairs of row numbers that join groups not joined yet."""
    root = {g: g for g in group.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (i, j) in enumerate(pairs.tolist()):
        x, y = find(int(group[i])), find(int(group[j]))
        if x != y:
            root[x] = y
            out.append(k)
    return out


def _pairs_to_try(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of the first block, of the second): within one block, or of two different ones."""
    own, b1, b2 = f["own"].to_numpy(), f["b1"].iloc[0], f["b2"].iloc[0]
    return np.flatnonzero(own == b1), np.flatnonzero(own == b2)


def _alike(f: pd.DataFrame, law: Law) -> pd.DataFrame:
    """A spanning forest of the pairs in different components that sizes and sketches allow."""
    n, s, comp, rep = f["n"].to_numpy(), np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, SIZE), f["comp"].to_numpy(), f["rep"].to_numpy()
    left, right = _pairs_to_try(f)
    out = []
    for i in left:
        at = right[(comp[right] != comp[i]) & (OF * np.minimum(n[right], n[i]) >= law.link * np.maximum(n[right], n[i]))]
        at = at[(s[at] == s[i]).sum(1) >= law.agree]
        out.append(np.c_[np.full(len(at), i), at])
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    pairs = pairs[_forest(pairs, np.arange(len(f)))]
    return pd.DataFrame({"u": rep[pairs[:, 0]], "v": rep[pairs[:, 1]]})


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of slices of their incidence matrix; values that one set alone
    holds are left out, as they are in no intersection."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    row, col = row[keep], column[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    step = 4_096
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _linked(f: pd.DataFrame, law: Law) -> pd.DataFrame:
    """Links of full sets between different components, as many as join these."""
    sets = [np.frombuffer(x, np.uint64) for x in f["items"]]
    comp, rep, n = f["comp"].to_numpy(), f["rep"].to_numpy(), np.array([len(x) for x in sets])
    left, right = _pairs_to_try(f)
    both = shared_counts(sets)[np.ix_(left, right)]
    ok = (OF * both >= law.link * (n[left][:, None] + n[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
    i, j = np.nonzero(ok)
    pairs = np.c_[left[i], right[j]]
    pairs = pairs[_forest(pairs, comp)]
    return pd.DataFrame({"u": rep[pairs[:, 0]], "v": rep[pairs[:, 1]]})


def across_components(members: DataFrame, named: DataFrame, docs: DataFrame, roots: DataFrame, law: Law, doc_id: str, text: str) -> DataFrame:
    """The links ``u, v`` that join components whose documents share a band, however many they are.

    Components that share bands make clusters; within a cluster all documents meet in pairs of blocks. Sketches are compared
    first, what they leave is clustered again, and there the full sets are compared. Neither step emits more pairs than join
    its documents, so a large group of documents that are alike but not linked costs time in many tasks and no rows.
    """
    comp = members.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = comp.groupBy("key").agg(F.min("comp").alias("u"), F.max("comp").alias("_b")).where("u < _b").drop("_b")
    comp = stage(comp.join(mixed, "key").select("u", "rep", "comp").distinct())
    cluster = components(comp.select("u", F.col("comp").alias("v")).where("u != v")).select(F.col("node").alias("comp"), F.col("root").alias("cluster"))
    nodes = comp.select("rep", "comp").distinct().join(cluster, "comp").join(named.select("rep", "n", "sketch"), "rep")
    alike = (in_block_pairs(nodes.select("rep", "comp", "cluster", "n", "sketch"), 512).groupBy("cluster", "b1", "b2").applyInPandas(lambda f: _alike(f, law), "u long, v long"))
    again = stage(components(stage(alike.distinct())).withColumnRenamed("root", "cluster"))
    left = again.join(comp.select(F.col("rep").alias("node"), "comp").distinct(), "node").select(F.col("node").alias("rep"), "comp", "cluster")
    texts = fetch(docs, left, "rep", doc_id, text).select("rep", "comp", "cluster", "_b")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [shingles(t).tobytes() for t in unpacked(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(items, pa.binary())], names=["rep", "comp", "cluster", "items"])

    full = texts.mapInArrow(sets, "rep long, comp long, cluster long, items binary")
    return in_block_pairs(stage(full), 192).groupBy("cluster", "b1", "b2").applyInPandas(lambda f: _linked(f, law), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: int = 85) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row; a similarity of ``link`` hundredths or more links.

    Null, empty and wordless texts have no shingles and stay alone. Rows with the same id count as one document, whose
    texts belong together. Rows without an id join the component of rows with the same set; where no such row has an
    id, their component is null and they count as kept.
    """
    held = law(link)
    rows = stage(describe(docs, held.rows, doc_id, text))
    some = rows.where("n > 0")
    nodes = stage(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n", "keys", "sketch")).alias("_x"))
                  .select("hi", "lo", "rep", "_x.n", "_x.keys", "_x.sketch"))
    named = nodes.where("rep IS NOT NULL")
    keyed = named.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    members = stage(keyed.join(shared, "key"))
    stars = members.where("rep != center").select("center", F.col("rep").alias("member")).distinct()
    links = stage(confirm(stars, docs, named, held, doc_id, text))
    same_id = some.where("doc_id IS NOT NULL").select("hi", "lo", F.col("doc_id").alias("u")).join(named.select("hi", "lo", F.col("rep").alias("v")), ["hi", "lo"]).where("u != v")
    repeated = same_id.join(named.select(F.col("rep").alias("u")).distinct(), "u").select("u", "v")  # an id whose other text leads elsewhere
    edges = links.select(F.col("center").alias("u"), F.col("member").alias("v")).unionAll(repeated)
    roots = stage(components(edges))
    more = stage(across_components(members, named, docs, roots, held, doc_id, text))
    roots = stage(components(edges.unionAll(more)))
    of_set = named.select("hi", "lo", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("component_id"))
    placed = rows.join(of_set, ["hi", "lo"], "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return placed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each, with all their columns."""
    kept = near_duplicates(docs, doc_id, text, link).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    h = docs.withColumn("__own", F.xxhash64(F.col(text)))
    left = h.join(kept, h[doc_id].cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_semi")
    same = Window.partitionBy(doc_id, F.when(F.col(doc_id).isNull(), F.col("__own"))).orderBy("__own")
    return left.withColumn("__k", F.row_number().over(same)).where("__k = 1").select(*docs.columns)
