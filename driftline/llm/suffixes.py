"""Exact removal of repeated byte strings with a sparse suffix array.

Every string of REACH bytes is filed under an anchor: the place of its least-hashed GRAM bytes, the leftmost of equal ones. Equal strings hold equal
anchors at equal places, so only suffixes that begin at anchors are sorted, and of these only those whose gram comes more than once
(a count by hash, which can but keep too many). An anchor takes along the REACH bytes from it on, what stands before it, and which
strings it stands for.

Suffixes are range-partitioned by their leading bytes at sampled splitters, the text before them last, so that a range can end among equal suffixes.
A range is sorted locally by multikey quicksort, as is the text before the anchors; common prefixes of neighbours tell which strings are equal,
and of equal ones the earliest stays. A string that a splitter's prefix ends or begins can go on in the next range: the
earliest of each range are compared across boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..core.stage import stage
from .common import pieces, utf8

#: Bytes of a string, bytes of an anchor's gram, and how far before its anchor a string can start.
REACH, GRAM = 100, 32
BEFORE = REACH - GRAM
#: Bytes of text packed and scanned together; hashes of a group that counts them; suffixes of a range, and sample keys of one.
BLOCK, HASHES, SUFFIXES, SAMPLES = 1 << 20, 2_000_000, 150_000, 100
#: Groups there are at least, and ranges that are sorted at once: their splitters are broadcast, under 1 MB. More data is sorted in
#: bands of gram hashes, one after the other.
LEAST, RANGES = 24, 4_096
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64(0xFFFFFFFF)
_NO_ID = -(1 << 63)


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts in blocks of about BLOCK bytes, a longer text alone: ``block, ids, keys, sizes, data`` (compressed), staged so that a
    row keeps its place."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)), T.StructField("keys", T.ArrayType(T.LongType())),
                           T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        ids, keys, texts = [], [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
                                               pa.array([c.compress(b"".join(texts))], pa.binary())], names=schema.names)

        size = 0
        for b in batches:
            kind = b.schema[0].type
            for k in range(b.num_rows):
                data = b.column(2)[k].as_py()
                if texts and size + len(data) > BLOCK:
                    yield block()
                    ids, keys, texts, size = [], [], [], 0
                ids.append(b.column(0)[k].as_py()), keys.append(b.column(1)[k].as_py()), texts.append(data)
                size += len(data)
        if texts:
            yield block()

    packed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("_key"), utf8(text).alias("_b")).mapInArrow(run, schema)
    return stage(packed.withColumn("block", F.monotonically_increasing_id()))


def anchors(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a block: its number, and of its anchors the place, the gram's hash, and the first and last start of the strings
    they stand for. Strings do not cross ``bounds``. An anchor whose strings start in two slices comes twice."""
    ends = bounds[1:] - REACH  # last start in each document
    for number, s in enumerate(range(0, len(data), BLOCK)):
        e = min(len(data), s + BLOCK)
        x = np.zeros(min(len(data), e + REACH) - s + 8, np.uint64)
        x[:-8] = data[s:s + len(x) - 8]
        n = len(x) - 7
        for shift in (1, 2, 4):  # words of 2, 4, 8 bytes
            x = x[:len(x) - shift] | x[shift:] << np.uint64(8 * shift)
        h = np.zeros(max(n - GRAM + 8, 1), np.uint64)
        for k, odd in enumerate(_ODD):
            part = x[8 * k:8 * k + len(h)]
            h[:len(part)] += part * odd
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= BEFORE + 1 and len(low) > width:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        rest = BEFORE + 1 - width
        if len(low) <= rest:
            continue
        low = np.minimum(low[:len(low) - rest], low[rest:]) & _PLACE
        start = np.arange(s, min(e, s + len(low)))
        inside = np.repeat(ends, np.diff(np.clip(bounds, s, start[-1] + 1 if len(start) else s)))
        start = start[start <= inside]
        if not len(start):
            continue
        at = low[start - s].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        tail = np.concatenate([head[1:], [len(at)]]) - 1
        yield number, at[head] + s, h[at[head]], start[head], start[tail]


def _groups(h: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """The anchors of each group of hashes, in order."""
    g = ((h >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
        if len(part):
            yield int(g[part[0]]), part


def _opened(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(data), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _hashes(blocks: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, data in zip(*(b.column(k) for k in range(3))):
                out = []
                for number, _, h, _, _ in anchors(*_opened(data.as_py(), sizes.as_py())):
                    out += [(g, block.as_py(), number, h[part].tobytes()) for g, part in _groups(h, groups)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["group", "block", "slice", "hashes"])

    return blocks.select("block", "sizes", "data").mapInArrow(run, "group int, block long, slice int, hashes binary")


def _repeated(t: pa.Table) -> pa.Table:
    """Which of each slice's hashes come more than once, a bit each."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]]
    h = np.concatenate(parts)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    bits = np.split(hit, np.cumsum([len(p) for p in parts])[:-1])
    keep = pa.array([k for k, x in enumerate(bits) if x.any()], pa.int64())
    return pa.table({"block": t["block"].take(keep), "slice": t["slice"].take(keep), "group": t["group"].take(keep),
                     "bits": pa.array([np.packbits(bits[k]).tobytes() for k in keep.to_pylist()], pa.binary()), "n": pa.array([int(bits[k].sum()) for k in keep.to_pylist()], pa.int64())})


#: What an anchor takes along: its suffix, the text before it backwards, nearest and farthest start, and its place.
RECORD = np.dtype([("right", np.uint8, REACH), ("left", np.uint8, BEFORE), ("near", np.uint8), ("far", np.uint8), ("key", np.int64), ("doc", np.int32), ("pos", np.int64)])
SPAN = np.dtype([("doc", np.int32), ("start", np.int64), ("end", np.int64)])


def _keys(records: np.ndarray) -> np.ndarray:
    """The bytes by which suffixes are ordered; missing ones are zeros and never compared where it matters."""
    return np.ascontiguousarray(np.concatenate([records["right"], records["left"]], axis=1)).view(f"S{REACH + BEFORE}").ravel()


def _spans(records: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    out["doc"], out["start"], out["end"] = records["doc"], records["pos"] - far, records["pos"] - near + REACH
    return out


def _records(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records that differ, the earliest of equal ones; spans of the others, which are repetitions)."""
    doc = np.searchsorted(bounds, at, side="right") - 1
    kept, spans = [], []
    for k in range(0, len(at), 1 << 15):
        a, d = at[k:k + (1 << 15)], doc[k:k + (1 << 15)]
        r = np.zeros(len(a), RECORD)
        i = a[:, None] + np.arange(REACH)
        r["right"] = np.where(i < bounds[d + 1][:, None], data[np.minimum(i, len(data) - 1)], 0)
        i = a[:, None] - 1 - np.arange(BEFORE)
        r["left"] = np.where(i >= bounds[d][:, None], data[np.maximum(i, 0)], 0)
        r["near"], r["far"] = a - last[k:k + (1 << 15)], a - first[k:k + (1 << 15)]
        r["key"], r["doc"], r["pos"] = keys[d], d, a - bounds[d]
        kept.append(r)
    while True:  # slices first, then what they leave together
        for k, r in enumerate(kept):
            r = r[np.lexsort((r["pos"], r["doc"], r["key"]))]
            what = np.ascontiguousarray(np.concatenate([r["right"], r["left"], r["near"][:, None], r["far"][:, None]], axis=1)).view(f"V{REACH + BEFORE + 2}").ravel()
            seen: dict[bytes, int] = {}
            fresh = np.fromiter((seen.setdefault(x, j) == j for j, x in enumerate(what.tolist())), bool, len(r))
            spans.append(_spans(r[~fresh], r["far"][~fresh].astype(np.int64), r["near"][~fresh].astype(np.int64)))
            kept[k] = r[fresh]
        if len(kept) == 1:
            return kept[0], np.concatenate(spans)
        kept = [np.concatenate(kept)]


def _suffixes(blocks: DataFrame, bits: DataFrame, groups: int, band: int, bands: int) -> tuple[DataFrame, Callable]:
    """(blocks with the marks of their anchors, a function from their Arrow batches to (block, records, spans) of each slice)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in batches:
            for block, keys, sizes, data, marks in zip(*(b.column(k) for k in range(5))):
                of = {(m["slice"], m["group"]): m["bits"] for m in marks.as_py()}
                x, bounds = _opened(data.as_py(), sizes.as_py())
                ids = np.array(keys.as_py(), np.int64)
                for number, at, h, first, last in anchors(x, bounds):
                    hit = np.zeros(len(h), bool)
                    for g, part in _groups(h, groups):
                        if (number, g) in of:
                            hit[part] = np.unpackbits(np.frombuffer(of[number, g], np.uint8), count=len(part)).astype(bool)
                    if bands > 1:
                        hit &= h % np.uint64(bands) == np.uint64(band)
                    if hit.any():
                        yield block.as_py(), *_records(x, bounds, ids, at[hit], first[hit], last[hit])

    marked = bits.groupBy("block").agg(F.collect_list(F.struct("slice", "group", "bits")).alias("marks"))
    return blocks.join(marked, "block").select("block", "keys", "sizes", "data", "marks"), slices


def splitters(source: DataFrame, slices: Callable, share: float, ranges: int) -> np.ndarray:
    """Quantiles of a sample of the suffixes' keys, each drawn with the probability ``share``; their number is bounded by that of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, records, _ in slices(batches):
            drawn = np.random.default_rng([block & 0xFFFFFFFF, 7]).random(len(records)) < share
            yield pa.RecordBatch.from_arrays([pa.array(_keys(records[drawn]).tolist(), pa.binary())], names=["k"])

    sample = np.array([r[0].ljust(REACH + BEFORE, b"\0") for r in source.mapInArrow(run, "k binary").toLocalIterator()], f"S{REACH + BEFORE}")
    sample.sort()
    at = np.unique((np.arange(1, ranges) * len(sample) / ranges).astype(int))
    return np.unique(sample[at[at < len(sample)]])


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes that each row in that order shares with the one before): words of eight bytes from the left, each among those rows
    only that are equal so far."""
    n, m = rows.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = rows
    words = wide.view(">u8")
    order, shared, group = np.arange(n), np.full(n, m, np.int64), np.zeros(n, np.int64)
    shared[:1] = 0
    for k in range(words.shape[1]):
        tied = np.flatnonzero((np.diff(group, prepend=-1) == 0) | (np.diff(group, append=-1) == 0))
        if not len(tied):
            break
        w = words[order[tied], k].astype(np.uint64)
        by = np.lexsort((w, group[tied]))
        order[tied], w = order[tied][by], w[by]
        parts = np.flatnonzero((w[1:] != w[:-1]) & (np.diff(group[tied]) == 0)) + 1
        differ = w[parts] ^ w[parts - 1]
        shared[tied[parts]] = np.minimum(8 * k + sum((differ < np.uint64(1 << 64 - 8 * b)).astype(np.int64) for b in range(1, 8)), m)
        fresh = np.concatenate([[False], np.diff(group) != 0])
        fresh[tied[parts]] = True
        group = np.cumsum(fresh)
    return order, shared


def _agree(rows: np.ndarray, with_: bytes | None) -> np.ndarray:
    """How many leading bytes of each row are those of a splitter."""
    if with_ is None:
        return np.full(len(rows), -1)
    same = rows == np.frombuffer(with_.ljust(REACH + BEFORE, b"\0")[:REACH], np.uint8)
    return np.where(same.all(1), REACH, same.argmin(1))


FOUND = "block long, spans binary, string binary, key long, doc int, pos long"


def _by_block(block: np.ndarray, spans: np.ndarray) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    c = zstandard.ZstdCompressor(level=1)
    parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []
    return [(int(block[p[0]]), c.compress(spans[p].tobytes()), None, None, None, None) for p in parts]


def _found(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def _sorted_range(t: pa.Table, cuts: np.ndarray) -> pa.Table:
    """Spans of the strings that come earlier in the same range, and the earliest of those that a boundary may part from others."""
    number = t["range"][0].as_py()
    parts = [np.frombuffer(zstandard.decompress(x.as_py()), RECORD) for x in t["records"]]
    blocks = np.repeat(t["block"].to_numpy(), [len(p) for p in parts])
    r = np.concatenate(parts)
    del parts
    order = np.lexsort((r["pos"], r["doc"], blocks, r["key"]))  # from here on a lower row is an earlier place
    r, blocks = r[order], blocks[order]
    n = len(r)
    by_right, shared_right = multikey_sort(r["right"])
    by_left, shared_left = multikey_sort(r["left"])
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    at_right[by_right] = at_left[by_left] = np.arange(n)
    near, far = r["near"].astype(np.int64), r["far"].astype(np.int64)
    whole = np.cumsum(shared_right < REACH)[at_right] * n + np.cumsum(shared_left < BEFORE)[at_left]
    _, only = np.unique((whole * 128 + near) * 128 + far, return_index=True)
    twice = np.ones(n, bool)
    twice[only] = False
    only.sort()
    gone, of_block = [_spans(r[twice], far[twice], near[twice])], [blocks[twice]]
    below = _agree(r["right"], cuts[number - 1] if number else None)
    above = _agree(r["right"], cuts[number] if number < len(cuts) else None)
    rows, offsets, open_rows = [], [], []
    for o in range(BEFORE + 1):
        here = only[(near[only] <= o) & (o <= far[only])]
        if not len(here):
            continue
        length = REACH - o
        k = np.cumsum(shared_right < length)[at_right[here]] * n + np.cumsum(shared_left < o)[at_left[here]]
        by = np.argsort(k, kind="stable")
        again = np.concatenate([[False], np.diff(k[by]) == 0])
        rows.append(here[by[again]])
        offsets.append(np.full(len(rows[-1]), o))
        first = here[by[~again]]
        for j in first[(below[first] >= length) | (above[first] >= length)]:
            string = r["left"][j, :o][::-1].tobytes() + r["right"][j, :length].tobytes()
            open_rows.append((int(blocks[j]), None, string, int(r["key"][j]), int(r["doc"][j]), int(r["pos"][j]) - o))
    if rows:
        row, o = np.concatenate(rows), np.concatenate(offsets)
        by = np.lexsort((o, row))
        row, o = row[by], o[by]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(o) != 1)])) if len(row) else np.empty(0, np.int64)
        tail = np.concatenate([head[1:], [len(row)]])[:len(head)] - 1
        gone.append(_spans(r[row[head]], o[tail], o[head]))
        of_block.append(blocks[row[head]])
    local = [(b, s, None, None, None, None) for b, s in zip(t["block"].to_pylist(), t["spans"].to_pylist()) if s]
    return _found(_by_block(np.concatenate(of_block), np.concatenate(gone)) + local + open_rows)


def _ranged(source: DataFrame, slices: Callable, cuts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for block, records, spans in slices(batches):
            at = np.searchsorted(cuts, _keys(records), side="right")
            by = np.argsort(at, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(at[by])) + 1)
            told = [c.compress(spans.tobytes()) if len(spans) else None, *[None] * (len(parts) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[p[0]]) for p in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
                                              pa.array([c.compress(records[p].tobytes()) for p in parts], pa.binary()), pa.array(told, pa.binary())], names=["range", "block", "records", "spans"])

    moved = source.mapInArrow(run, "range int, block long, records binary, spans binary")
    return moved.groupBy("range").applyInArrow(lambda t: _sorted_range(t, cuts), FOUND)


def repeated_spans(blocks: DataFrame) -> DataFrame:
    """``block, spans``: packed spans of the blocks' documents that an earlier string covers, in any order and overlapping."""
    size = blocks.select(F.count(F.lit(1)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    groups = pieces((size[1] or 0) // 32, HASHES, LEAST)
    bits = stage(_hashes(blocks, groups).groupBy("group").applyInArrow(_repeated, "block long, slice int, group int, bits binary, n long"))
    total = bits.agg(F.sum("n")).first()[0] or 0
    ranges = pieces(total, SUFFIXES, LEAST)
    bands = pieces(ranges, RANGES)
    ranges = pieces(ranges, bands)
    every = max(1, size[0] // max(256, 4 * ranges))
    found = None
    for band in range(bands):
        source, slices = _suffixes(blocks, bits, groups, band, bands)
        share = min(1.0, SAMPLES * ranges * every * bands / max(1, total))
        cuts = splitters(source.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0), slices, share, ranges)
        part = stage(_ranged(source, slices, cuts))
        found = part if found is None else found.unionAll(part)
    same = W.partitionBy("string").orderBy("key", "block", "doc", "pos")
    later = found.where("string IS NOT NULL").withColumn("_k", F.row_number().over(same)).where("_k > 1")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.empty(b.num_rows, SPAN)
            s["doc"], s["start"] = b.column(1).to_numpy(), b.column(2).to_numpy()
            s["end"] = s["start"] + REACH
            rows = _by_block(b.column(0).to_numpy(), s)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "spans"])

    return found.where("spans IS NOT NULL").select("block", "spans").unionAll(later.select("block", "doc", "pos").mapInArrow(spans, "block long, spans binary"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: what is left without the bytes that a string of REACH bytes covers which
    also starts earlier, in a smaller doc_id or further left.

    A null text is empty; texts below REACH bytes lose nothing. Rows without an id come first; rows that share an id, repeated
    rows among them, count as different documents in an order that the packed copy fixes. Other columns are not read. A text travels whole, but is
    scanned in slices; strings do not cross texts.
    """
    blocks = pack(docs, doc_id, text)
    per = repeated_spans(blocks).groupBy("block").agg(F.collect_list("spans").alias("spans"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, data, spans in zip(*(b.column(k) for k in range(4))):
                x, bounds = _opened(data.as_py(), sizes.as_py())
                edge = np.zeros(len(x) + len(bounds), np.int32)  # each document has a place more, so spans of two do not touch
                for s in spans.as_py() or []:
                    s = np.frombuffer(zstandard.decompress(s), SPAN)
                    base = bounds[s["doc"]] + s["doc"]
                    np.add.at(edge, base + s["start"], 1)
                    np.add.at(edge, base + s["end"], -1)
                gone = np.cumsum(edge, out=edge) > 0
                out = []
                for d, (a, e) in enumerate(zip(bounds, bounds[1:])):
                    g = gone[a + d:e + d]
                    out.append((int(e - a), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0, hashlib.sha256(x[a:e][~g].tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([ids.values, *[pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out))]], names=schema.names)

    return blocks.join(per, "block", "left").select("ids", "sizes", "data", "spans").mapInArrow(run, schema)
