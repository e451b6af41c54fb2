"""Best-fit packing with matching of large items.

At most two pieces longer than a third of the capacity share a sequence, so these are paired greedily, each with the
longest partner that still fits; then the smaller pieces, longest first, go where the gap that remains is smallest.
Lengths are whole numbers up to the capacity. So the plan is made on the histogram of lengths, whose size the capacity
bounds, and pieces find their place by length and rank: nothing that grows with the corpus passes one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from ..core.stage import stage
from .common import bounded_batches, pieces

#: White space that splitting at single blanks and line ends does not treat as the tokenizer does.
_ODD = regex.compile(r"\s\s|^\s|\s$|[^\S \n]|\x00")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids (little-endian 32-bit) of a word with the blank before it, each word encoded once per worker.

    A byte-level BPE never merges across such a word's ends, so words may be encoded apart. The store is emptied when it
    is large; that costs time only.
    """

    MOST = 400_000

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]) -> None:
        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = tuple(special)
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.MOST:
            self.clear()
        ids = self[word] = np.array(self.bpe.encode_ordinary(word), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        if _ODD.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


_held: dict[tuple, WordIds] = {}


def tokenizer(ranks: str, pattern: str, special: dict[str, int] | None = None) -> WordIds:
    """``special``: strings that are one id each wherever they stand in a text; without it they are ordinary text."""
    key = ranks, *sorted((special or {}).items())
    if key not in _held:
        _held[key] = WordIds(ranks, pattern, special or {})
    return _held[key]


def special_ids(tokenizer_json: str) -> dict[str, int]:
    """The strings that a tokenizer's file declares as ids of their own."""
    with open(tokenizer_json, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind one that may be shorter."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of every document's whole id sequence, its end mark included; a null text is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks, pattern, special)
        for b in batches:
            at, part, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = memoryview(tok.encode(t.as_py() or "") + end)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i), part.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(ids[4 * s:4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where pieces go: rows ``length, rank, bin, offset`` say that pieces of that length from that rank on lie at that
    offset of the sequences from that number on, one in each.

    Work and result depend on the number of different lengths alone, at most ``capacity``.
    """
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of equal sequences (first, how many)
    bins = 0

    def place(length: int, first: int, n: int, filled: int) -> None:
        rows.append((length, used[length], first, filled))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, a in enumerate(large):
        while left[a]:
            b = next((x for x in large[i:] if a + x <= capacity and left[x] >= 1 + (x == a)), 0)
            n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, bins, n, 0)
            if b:
                place(b, bins, n, a)
            gaps.setdefault(capacity - a - b, []).append((bins, n))
            bins += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            gap = min((g for g in gaps if g >= a), default=0)
            if gap:
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                k = min(n, left[a])
                if k < n:
                    gaps.setdefault(gap, []).append((first + k, n - k))
                place(a, first, k, capacity - gap)
                gaps.setdefault(gap - a, []).append((first, k))
            else:  # new sequences, filled with this length
                each = min(capacity // a, left[a])
                k = left[a] // each
                for j in range(each):
                    place(a, bins, k, j * a)
                gaps.setdefault(capacity - each * a, []).append((bins, k))
                bins += k
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "offset"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def pack(cuts: DataFrame, capacity: int = 1024, rows_per_group: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces that ``tokenize`` gives.

    Pieces of one length are ranked by id group and, within it, by id and piece; equal rows are told apart by position
    alone. Null ids form a group of their own kind. Empty input gives an empty result.
    """
    cuts = stage(cuts)
    total = cuts.count()
    groups = max(256, pieces(total, rows_per_group))
    keyed = cuts.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = keyed.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = plan(histogram, capacity)
    key = table["length"].to_numpy() << 44 | table["rank"].to_numpy()
    first, rank0, offset = (table[c].to_numpy() for c in ("bin", "rank", "offset"))

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.searchsorted(key, f["length"].to_numpy() << 44 | f["_rank"].to_numpy(), side="right") - 1
            yield f.drop(columns="_rank").assign(sequence_id=first[at] + f["_rank"].to_numpy() - rank0[at], offset=offset[at])

    inside = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (keyed.withColumn("_k", F.row_number().over(inside) - 1).join(base, ["length", "_g"])
              .select(*cuts.columns, (F.col("_base") + F.col("_k")).cast("long").alias("_rank")))
    return ranked.mapInPandas(locate, f"{PIECES}, sequence_id long, offset long")
