"""Runs of words that repeat with a period, within each document.

A run of period q and at least 4q words (and at least 6) repeats every k-gram inside it q words later, and some k-gram does so
that is as long as its smallest overlap with itself allows: 5 words for q = 1, three times the power of two m <= q < 2m else. Such a gram
is at least as long as the period, so within the run it does not come again any sooner: neighbouring occurrences of a gram, at most
one pair for each position, are all the seeds there can be. A seed is extended along its diagonal (lag) both ways, unless the
lag's furthest covered position lies beyond it already.

Grams are named exactly, without hashing: those of 2m words by the pair of names of their halves. Only grams that occur again
in their document are carried to the next length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import utf8

#: A run has at least this many words, and at least this many times its period.
LEAST, TIMES = 6, 4
#: Short documents are analysed together, up to so many bytes of text.
TOGETHER = 4 << 20


def rewritten(n: int, key: str | None) -> np.ndarray:
    """Which original word stands at each of ``n`` places: for an id whose crc32 ends in 0, a stretch repeats up to the end."""
    at = np.arange(n)
    if key is None or not n:
        return at
    h = zlib.crc32(key.encode())
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _names(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different pair, and how often each pair comes."""
    _, name, times = np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True, return_counts=True)
    return name, times[name]


def _seeds(code: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of neighbouring occurrences of grams, for one class of lags m <= q < 2m after the other.

    ``code`` names words, differently in each document; ``end`` is where the document of a position ends.
    """
    n = len(code)

    def joined(a: np.ndarray, la: int, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of grams of ``length`` words that repeat, their names, and the names by position."""
        at = np.flatnonzero(a >= 0)
        at = at[at + length <= end[at]]
        at = at[b[at + la] >= 0] if len(at) else at
        name, times = _names(a[at], b[at + la]) if len(at) else (at, at)
        at, name = at[times > 1], name[times > 1]
        by = np.full(n, -1, np.int64)
        by[at] = name
        return at, name, by

    _, times = np.unique(code, return_counts=True)
    r1 = np.where(times[code] > 1, code, -1)
    r2 = joined(r1, 1, r1, 2)[2]
    r4 = joined(r2, 2, r2, 4)[2]
    longest = int((end - np.arange(n)).max(initial=0))
    m, half, whole = 1, r2, r4  # names of 2m and, from m = 2 on, of m words
    at, name, _ = joined(r4, 4, r1, 5)
    while True:
        order = np.argsort(name, kind="stable")
        place, same = at[order], name[order]
        lag = np.diff(place)
        hit = (same[1:] == same[:-1]) & (m <= lag) & (lag < 2 * m)
        yield place[:-1][hit], lag[hit]
        m *= 2
        if TIMES * m > longest or not (whole >= 0).any():
            return
        at, name, _ = joined(whole, 2 * m, half, 3 * m)
        half, whole = whole, joined(whole, 2 * m, whole, 4 * m)[2]


def _reach(code: np.ndarray, i: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The longest [start, end) around word ``i`` of which every word equals the one ``lag`` later."""
    start, step = i, 16
    while start > low:
        a = max(low, start - step)
        differ = np.flatnonzero(code[a:start] != code[a + lag:start + lag])
        if len(differ):
            start = a + int(differ[-1]) + 1
            break
        start, step = a, step * 2
    stop, step = i + 1, 16
    while stop + lag < high:
        b = min(high - lag, stop + step)
        differ = np.flatnonzero(code[stop:b] != code[stop + lag:b + lag])
        if len(differ):
            stop += int(differ[0])
            break
        stop, step = b, step * 2
    return start, stop


def runs(code: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; ``bounds`` are the documents' places in ``code``, whose names differ among documents."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for place, lag in _seeds(code, end):
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        fresh = np.ones(len(place), bool)  # a seed right after another of its lag lies in what that one reaches
        fresh[1:] = (np.diff(lag) != 0) | (np.diff(place) != 1)
        covered: dict[int, int] = {}
        for i, q in zip(place[fresh].tolist(), lag[fresh].tolist()):
            if i < covered.get(q, 0):
                continue
            a, b = _reach(code, i, q, int(begin[i]), int(end[i]))
            covered[q] = b
            if b - a + q >= max(LEAST, TIMES * q):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digest(found: list[tuple[int, int, int]], words: np.ndarray) -> tuple:
    keep = np.ones(len(words), bool)
    best = None
    for s, n, q in found:
        keep[s + q:s + n] = False
        if best is None or n * best[2] > best[1] * q:  # ties: found comes by start, then period
            best = s, n, q
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    text = b" ".join(words[keep].tolist())
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())


def _analysed(texts: list[tuple[bytes, str | None]]) -> list[tuple]:
    split = [t.split() for t, _ in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    flat = np.empty(int(bounds[-1]), object)
    for w, a, b in zip(split, bounds, bounds[1:]):
        flat[a:b] = w
    at = np.concatenate([np.empty(0, np.int64), *[a + rewritten(len(w), key) for w, (_, key), a in zip(split, texts, bounds)]])
    name = pd.factorize(flat)[0].astype(np.int64)[at]
    doc = np.repeat(np.arange(len(split)), np.diff(bounds))
    code = np.unique(doc * (name.max(initial=0) + 1) + name, return_inverse=True)[1].astype(np.int64)
    of: list[list] = [[] for _ in split]
    for s, n, q in runs(code, bounds):
        d = int(doc[s])
        of[d].append((s - int(bounds[d]), n, q))
    return [_digest(found, flat[at[a:b]]) for found, a, b in zip(of, bounds, bounds[1:])]


FIELDS = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, the number of runs, the run of the greatest length by period, and digests of all runs and of the text
    without repetitions. Rows are independent, so nothing is shuffled.

    A null, empty or blank text has no words: no runs, nulls, and the digests of nothing. A null id, like an id whose crc32 does not
    end in 0, leaves the words as they are. Equal rows give equal results. A text of one row is analysed as a whole, with about 100 bytes
    of memory a word; long texts and batches are taken one after the other. Other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if t == "long" else pa.string() for _, t in FIELDS]
        for b in batches:
            start = 0
            while start < b.num_rows:
                stop, size, group = start, 0, []
                while stop < b.num_rows and (stop == start or size + len(b.column(1)[stop].as_buffer()) <= TOGETHER):
                    group.append((b.column(1)[stop].as_py(), b.column(2)[stop].as_py()))
                    size += len(group[-1][0])
                    stop += 1
                got = list(zip(*_analysed(group)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), *[pa.array(x, k) for x, k in zip(got, kinds)]], names=["doc_id", *[n for n, _ in FIELDS]])
                start = stop

    return docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("_b"), F.col(doc_id).cast("string").alias("_key")).mapInArrow(run, schema)
