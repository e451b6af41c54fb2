"""The batch window aggregates and runs on a stream, with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor


def live_aggregates(stream: DataFrame, keys: list[str], ts: str, bin_s: float, xyz: tuple[str, str, str], late: str = "10 minutes") -> DataFrame:
    """Mean and peak-to-peak of the vector magnitude per left-closed bin; samples later than ``late`` are dropped."""
    mag = F.sqrt(sum((F.col(c) * F.col(c) for c in xyz), F.lit(0.0)))
    w = F.window(ts, f"{bin_s:g} seconds")
    return stream.withWatermark(ts, late).withColumn("__m", mag).groupBy(*keys, w.alias("w")).agg(
        F.avg("__m").alias("activity"), (F.max("__m") - F.min("__m")).alias("activity_range"), F.count("__m").alias("n_samples")
    ).select(*keys, F.col("w.start").alias("bin_ts"), "activity", "activity_range", "n_samples")


def live_merged_spans(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events merged while they follow each other within ``gap``: the interval merge as a session window."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_merged"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")).drop("w")


class _OpenRun(StatefulProcessor):
    """One entity's runs: rows that wait for the watermark, and the run that is still open."""

    def __init__(self, idle_us: int | None) -> None:
        self.idle_us = idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, value string")
        self.open = handle.getValueState("open", "value string, start_us bigint, end_us bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(u), int(t), None if pd.isna(v) else str(v)) for f in rows for u, t, v in zip(f["us"], f["tie"], f["value"])]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(u for u, *_ in new) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The watermark has passed: what lies before it is complete, so it is taken in order of time, whenever it came."""
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        ripe, later = sorted((r for r in rows if r[0] <= limit), key=lambda r: r[:2]), [r for r in rows if r[0] > limit]
        run = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for us, _, value in ripe:
            if run is not None and run[0] == value and (self.idle_us is None or us - run[2] <= self.idle_us):
                run = (value, run[1], us, run[3] + 1)
            else:
                closed += [run] if run is not None else []
                run = (value, us, us, 1)
        if run is not None and self.idle_us is not None and run[2] + self.idle_us < limit:
            closed, run = [*closed, run], None
        if ripe:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if run is None:
            self.open.clear()
        else:
            self.open.update(run)
            if self.idle_us is not None:
                self.handle.registerTimer((run[2] + self.idle_us) // 1000 + 1)
        if later:
            self.handle.registerTimer(min(r[0] for r in later) // 1000)
        if closed:
            yield pd.DataFrame([(*key, *r) for r in closed], columns=self.names(len(key)))

    @staticmethod
    def names(keys: int) -> list[str]:
        return [*[f"k{i}" for i in range(keys)], "value", "start_us", "end_us", "n"]

    def close(self) -> None:
        pass


def live_runs(stream: DataFrame, keys: list[str], ts: str, value: Column | str, tie: str, late: str = "10 minutes", idle_s: float | None = None) -> DataFrame:
    """Maximal runs of equal ``value`` (as text; null is a value of its own) on a stream: the batch operator's runs, whatever the order of arrival
    within ``late``. Rows that come later than that are dropped.

    An entity keeps the rows that wait for the watermark and its open run. A run is emitted when the watermark has passed the first row of
    the next one, so an entity's last run stays open, or, with ``idle_s``, ends when no row follows for so long; a longer pause then also
    parts two runs. ``tie`` (a number) orders rows of one instant. Needs the RocksDB state store; output mode append.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = stream.withWatermark(ts, late).select(*keys, ts, F.unix_micros(ts).alias("us"), F.col(tie).cast("bigint").alias("tie"), v.cast("string").alias("value"))
    kinds = [stream.schema[k].dataType.simpleString() for k in keys]
    shown = _OpenRun.names(len(keys))
    schema = ", ".join(f"{n} {t}" for n, t in zip(shown, [*kinds, "string", "bigint", "bigint", "bigint"]))
    got = rows.groupBy(*keys).transformWithStateInPandas(_OpenRun(None if idle_s is None else int(idle_s * 1e6)), schema, "append", "eventTime")
    return got.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "value", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "n")
