"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into blocks, each block
is compressed with either dictionary, and the normalised difference of the two total sizes says which class it resembles.
A logistic calibration on labelled texts that no dictionary has seen turns difference and compressibility into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, utf8

BLOCK = 2048
DICT_BYTES = 256 * 1024
LEVEL = 3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; too little text for training is taken as it is."""
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


@dataclass
class CompressionModel:
    """Fitted state: at most two dictionaries of ``DICT_BYTES`` and four weights, so it may travel with each task."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "weights": self.weights}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_made" not in self.__dict__:
            self.__dict__["_made"] = []
            for d in (self.good, self.bad):
                opts = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": LEVEL}
                if d:
                    held = zstandard.ZstdCompressionDict(d)
                    held.precompute_compress(level=LEVEL)
                    opts["dict_data"] = held
                self.__dict__["_made"].append(zstandard.ZstdCompressor(**opts))
        return self.__dict__["_made"]

    def features(self, data: bytes, length: int | None = None) -> tuple[float, float, float]:
        """Normalised size difference, compressed share of the text, log length; zeros for an empty text. ``data`` may be
        blocks of a text of ``length`` bytes."""
        if not data:
            return 0.0, 0.0, 0.0
        by_good, by_bad = self._compressors()
        g = b = 0
        for block in _blocks(data):
            g += len(by_good.compress(block))
            b += len(by_bad.compress(block))
        return (b - g) / (b + g), (b + g) / (2.0 * len(data)), float(np.log1p(length or len(data)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, 3)
        z = x @ np.asarray(self.weights[1:]) + self.weights[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3, rounds: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is moved from the sample's class share to ``prior``."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.zeros(a.shape[1])
    penalty = np.diag([0.0] + [ridge * len(x)] * x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return [float(w[0] - (w[1:] * mean / std).sum()), *(float(v) for v in w[1:] / std)]


def _sampled(share: int) -> Column:
    """The text ``_b`` as an array of bytes; of one longer than ``share`` as many blocks as fit, chosen by hash, in order."""
    starts = F.transform(F.sequence(F.lit(1), F.length("_b"), F.lit(BLOCK)), lambda x: F.struct(F.xxhash64("_id", x).alias("h"), x.alias("at")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(starts), 1, share // BLOCK), lambda x: x["at"]))
    return F.when(F.length("_b") <= share, F.array("_b")).otherwise(F.transform(chosen, lambda x: F.col("_b").substr(x, F.lit(BLOCK))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        per_class: int = 3000, bytes_per_class: int = 24 << 20) -> CompressionModel:
    """Fit on a bounded sample: of each class the first ``per_class`` labelled documents by hash of the id, while their
    texts stay within ``bytes_per_class``; even ranks build the dictionary, odd ranks calibrate. A text longer than a 64th of
    these bytes brings so many of its blocks, chosen by hash, so that it leaves room for the others.

    ``usable`` is a condition on ``labels``. Labels other than 0 and 1 are ignored, a document labelled twice counts with the
    higher label. Without rows of both classes the score is the share of label 1, 0.5 without any label. One task trains on the
    sample, which its bounds keep small; the driver gets the model alone.
    """
    known = (labels.where(usable & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y")))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = (docs.select(F.col(doc_id).alias("_id"), utf8(text).alias("_b"))
             .join(F.broadcast(chosen), "_id")  # at most 2 * per_class ids
             .where(F.length("_b") > 0))
    share = max(BLOCK, bytes_per_class // 64 // BLOCK * BLOCK)
    texts = texts.select("_id", "_y", F.xxhash64("_b").alias("_h"), F.length("_b").alias("_n"), _sampled(share).alias("_b"))
    by = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id", "_h")
    rows = (texts.withColumn("_sum", F.sum(F.least("_n", F.lit(share))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_rank", F.row_number().over(by))
            .where((F.col("_sum") <= bytes_per_class) & (F.col("_rank") <= per_class)).select("_y", "_rank", "_b", "_n"))
    total = sum(count.values())
    prior = min(max(count.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(y, rank, b"".join(b), n) for batch in batches for y, rank, b, n in zip(*(c.to_pylist() for c in batch.columns))]
        m = train(sorted(sample, key=lambda r: r[:2]), prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.good], pa.binary()), pa.array([m.bad], pa.binary()), pa.array([m.weights], pa.list_(pa.float64()))], names=["good", "bad", "weights"])

    made = rows.repartition(1).mapInArrow(run, "good binary, bad binary, weights array<double>").first()  # the sample is bounded
    return train([], prior) if made is None else CompressionModel(bytes(made["good"]), bytes(made["bad"]), list(made["weights"]))


def train(sample: list[tuple[int, int, bytes, int]], prior: float) -> CompressionModel:
    """The model of a sample (label, rank, text or blocks of it, length of the text) in order of label and rank."""
    model = CompressionModel(weights=[float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0])
    parts = {(y, odd): [(b, n) for label, rank, b, n in sample if label == y and rank % 2 == odd] for y in (0, 1) for odd in (0, 1)}
    if any(not p for p in parts.values()):
        return model
    model.good, model.bad = (build_dictionary([t for t, _ in parts[y, 0]]) for y in (1, 0))
    x = np.array([model.features(*t) for y in (0, 1) for t in parts[y, 1]])
    model.weights = calibrate(x, np.repeat([0.0, 1.0], [len(parts[0, 1]), len(parts[1, 1])]), prior)
    return model


def _scored(model: CompressionModel, at: int, batch: pa.RecordBatch) -> np.ndarray:
    return model.scores([v or b"" for v in batch.column(at).cast(pa.binary()).to_pylist()])


def score(docs: DataFrame, model: CompressionModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row over its whole text. A null text counts as empty; rows keep their null ids."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scored(model, 1, b))], names=[doc_id, "score"])

    return bounded_batches(docs).select(F.col(doc_id), utf8(text).alias("_b")).mapInArrow(run, f"`{doc_id}` {kind}, score double")


def keep_good(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns, whatever their names."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scored(model, at, b) >= threshold))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
