"""Crops, masks, trims and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..schema import add_seconds
from .intervals import points_in
from .islands import membership
from .timebase import linear_fill
from ..core.scan import scan


def crop(df: DataFrame, ts: str, start: Column, end: Column, half_open: bool = False) -> DataFrame:
    """Rows in ``[start, end]`` (or ``[start, end)``); a plain range predicate, so it reaches the scan."""
    c = F.col(ts)
    return df.where((c >= start) & ((c < end) if half_open else (c <= end)))


def extent(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def trim_to_anchor(df: DataFrame, anchor: DataFrame, keys: list[str], ts: str, end: Column | None = None,
                   require: bool = False) -> DataFrame:
    """Keep samples within the anchor signal's extent, or events that overlap it when ``end`` is given.

    ``require``: an entity without any overlapping row raises when the job runs.
    """
    b = extent(anchor, keys, ts)
    j = df.join(b, keys)
    stop = end if end is not None else F.col(ts)
    inside = (stop >= F.col("lo")) & (F.col(ts) <= F.col("hi"))
    out = j.where(inside).drop("lo", "hi")
    if require:
        n = j.groupBy(*keys).agg(F.count_if(inside).alias("__n")).withColumn(
            "__ok", F.assert_true(F.col("__n") > 0, F.lit("no sample overlaps the anchor signal"))).where(F.col("__ok").isNull())
        out = out.join(n.select(*keys), keys, "left_semi")
    return out


def event_end(ts: str = "ts", end: str = "end_ts", duration: str = "duration_s") -> Column:
    """Explicit end, else start plus duration, else start."""
    return F.coalesce(F.col(end), add_seconds(ts, F.col(duration)), F.col(ts))


def attached(df: DataFrame, periods: DataFrame, keys: list[str], ts: str, span: tuple[str, str], bin_s: float = 86400.0) -> DataFrame:
    """Rows inside any attachment period (closed)."""
    return points_in(df, periods, keys, ts, span, bin_s, "left_semi")


def null_bad_spans(df: DataFrame, bad: DataFrame, axis: Axis, columns: list[str], bin_s: float = 3600.0) -> DataFrame:
    """Null samples inside bad spans and one sample either side, then interpolate across them."""
    d = membership(df, bad, axis, "__bad", bin_s=bin_s)
    d = scan(d, axis, prev={"__pb": "__bad"}, nxt={"__nb": "__bad"})
    hit = F.col("__bad") | F.coalesce("__pb", F.lit(False)) | F.coalesce("__nb", F.lit(False))
    d = d.withColumns({c: F.when(~hit, F.col(c)) for c in columns}).drop("__bad", "__pb", "__nb")
    return linear_fill(d, axis, columns)


def threshold_window(df: DataFrame, keys: list[str], ts: str, value: str, threshold: float) -> DataFrame:
    """First to last sample at or above the threshold; status ``ok`` or ``no_in_water_interval``."""
    hit = F.when(F.col(value) >= threshold, F.col(ts))
    return df.groupBy(*keys).agg(F.min(hit).alias("trim_start"), F.max(hit).alias("trim_end")).withColumn(
        "trim_status", F.when(F.col("trim_start").isNull(), "no_in_water_interval").otherwise("ok"))


def windows_within(windows: DataFrame, trims: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Windows lying fully inside their entity's trim window."""
    return windows.join(trims, keys).where(
        (F.col("trim_status") == "ok") & (F.col(start) >= F.col("trim_start")) & (F.col(end) <= F.col("trim_end")))


# State names that do not count as positive.
NEGATIVE_STATES = ["", "not_sleep", "find_rest.not_sleep"]


def state_selector(selector: str, state: str = "state_name") -> Column:
    """``__all_positive__``, ``prefix.*`` or an exact state name as a predicate."""
    s = F.trim(F.coalesce(F.col(state), F.lit("")))
    if selector == "__all_positive__":
        return ~s.isin(NEGATIVE_STATES)
    if selector.endswith(".*"):
        return s.startswith(selector[:-1])
    return s == selector


def label_set(df: DataFrame, column: str, labels: list[str], keep: bool = True) -> DataFrame:
    """Rows whose trimmed label is in the set, or those whose label is not; a missing label is in no set."""
    hit = F.coalesce(F.trim(F.col(column)).isin(labels), F.lit(False))
    return df.where(hit if keep else ~hit)


def events_in_window(df: DataFrame, ts: str, duration: str, key: str, span_keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Events meeting ``[lo, hi]``; only span-type keys reach back by their duration."""
    end = F.when(F.col(key).isin(span_keys), add_seconds(ts, F.coalesce(F.col(duration), F.lit(0.0)))).otherwise(F.col(ts))
    return df.where((end >= lo) & (F.col(ts) <= hi))


def nyquist_ok(rates: DataFrame, fs: str, cutoffs_hz: list[float]) -> DataFrame:
    """Entities whose rate supports every cutoff."""
    return rates.withColumn("filterable", F.lit(max(cutoffs_hz)) < F.col(fs) / 2)


def complete_days(df: DataFrame, keys: list[str], ts: str, tz: str = "UTC") -> DataFrame:
    """Only rows of local days on which all 24 hours were observed."""
    local = F.from_utc_timestamp(ts, tz)
    d = df.withColumn("local_date", F.to_date(local)).withColumn("__h", F.hour(local))
    full = d.groupBy(*keys, "local_date").agg(F.count_distinct("__h").alias("__n")).where("__n = 24")
    return d.drop("__h").join(full.drop("__n"), [*keys, "local_date"], "left_semi")


def within_labels(df: DataFrame, labels: DataFrame, keys: list[str], ts: str, label_ts: str) -> DataFrame:
    """Rows between the first and the last manual label of their entity."""
    b = labels.groupBy(*keys).agg(F.min(label_ts).alias("lo"), F.max(label_ts).alias("hi"))
    return df.join(b, keys).where(F.col(ts).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
