"""Event tables: building, replacing, editing, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import add_seconds, seconds_between
from .intervals import points_in


def state_events(segments: DataFrame, keys: list[str], key: str, short: str = "", long: str = "") -> DataFrame:
    """Segments (start_ts, end_ts) as state events."""
    return segments.select(*keys, F.col("start_ts").alias("ts"), F.col("end_ts"), F.lit("state").alias("type"), F.lit(key).alias("key"),
                           F.lit(None).cast("double").alias("value"), seconds_between("start_ts", "end_ts").alias("duration_s"),
                           F.lit(short).alias("short_description"), F.lit(long).alias("long_description"))


def replace_keys(events: DataFrame, new: DataFrame, by: list[str], names: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Put ``new`` in place of the events it supersedes: those sharing ``by`` (entity and key), a key set or a key prefix."""
    if prefix is not None:
        kept = events.where(~F.col("key").startswith(prefix))
    elif names is not None:
        kept = events.where(~F.col("key").isin(names))
    else:
        kept = events.join(new.select(*by).distinct(), by, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def logger_status(df: DataFrame, keys: list[str], logger: str, ts: str) -> DataFrame:
    """Start and stop point events per logger."""
    b = df.groupBy(*keys, logger).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return b.select(*keys, logger, F.expr("stack(2, 'logger_start', a, 'logger_stop', b) AS (key, ts)"), F.lit("point").alias("type"))


def apply_edits(events: DataFrame, added: DataFrame, deleted: DataFrame, keys: list[str], tolerance_s: float = 0.001) -> DataFrame:
    """Remove events of the same key within a tolerance of a deletion, then add the new ones."""
    us = int(tolerance_s * 1_000_000)
    zone = deleted.select(*keys, F.timestamp_micros(F.unix_micros("ts") - us).alias("__a"), F.timestamp_micros(F.unix_micros("ts") + us).alias("__b"))
    return points_in(events, zone, keys, "ts", ("__a", "__b"), max(1.0, 2 * tolerance_s), "left_anti").unionByName(added, allowMissingColumns=True)


def merge_auto_manual(events: DataFrame, auto: DataFrame, keys: list[str], auto_keys: list[str], manual_keys: list[str]) -> DataFrame:
    """New automatic events replace old automatic ones; manual ones stay and override automatic ones of the same instant."""
    manual = events.where(F.col("key").isin(manual_keys))
    rest = events.where(~F.col("key").isin(auto_keys + manual_keys))
    fresh = auto.join(manual.select(*keys, "ts").distinct(), [*keys, "ts"], "left_anti")
    return rest.unionByName(manual).unionByName(fresh, allowMissingColumns=True)


def complete_schema(df: DataFrame, tz: str = "UTC", naive: bool = False) -> DataFrame:
    """Missing standard columns, instants from local times, and a type where none is given."""
    from ..schema import EVENTS
    have = set(df.columns)
    out = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in EVENTS.fields if f.name not in have})
    if naive:
        out = out.withColumn("ts", F.to_utc_timestamp("ts", tz))
    text = F.lower(F.concat_ws(" ", "key", "short_description"))
    kind = F.when(F.col("duration_s") > 0, "state").when(text.contains("dive"), "dive").when(text.contains("note"), "note").otherwise("event")
    return out.withColumn("type", F.coalesce(F.nullif(F.trim("type"), F.lit("")), kind))


def overlay_rows(segments: DataFrame, focus: Column) -> DataFrame:
    """Review rows: every segment before context, then the kept, the rejected and the one in focus, tagged."""
    base, keep = F.coalesce("base_keep", F.lit(False)), F.coalesce("keep", F.lit(False))
    tags = F.array_compact(F.array(F.when(base, F.lit("pre_context")), F.when(keep, F.lit("kept")), F.when(base & ~keep, F.lit("rejected")),
                                   F.when(F.coalesce(focus, F.lit(False)), F.lit("focus"))))
    return segments.withColumn("overlay", F.explode(tags))


SEGMENT_ALIASES = {"start_ts": ["start_datetime", "start_ts", "window_start", "start", "datetime"],
                   "end_ts": ["end_datetime", "end_ts", "window_end", "end"],
                   "label": ["state_name", "label_name", "predicted_label", "nominal_class", "key"]}


def segment_rows(df: DataFrame) -> DataFrame:
    """Segments from tables with other column names; only rows that end after they start."""
    from ..schema import canonical
    return canonical(df, SEGMENT_ALIASES).where(F.col("end_ts") > F.col("start_ts"))


def event_keys(df: DataFrame) -> DataFrame:
    return df.select("key").where(F.trim("key") != "").distinct()


def prefix_selectors(df: DataFrame) -> DataFrame:
    """Prefixes shared by more than one key, as ``prefix.*`` selectors."""
    k = event_keys(df).where(F.col("key").contains(".")).withColumn("prefix", F.substring_index("key", ".", 1))
    return k.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat("prefix", F.lit(".*")).alias("selector"), "n")


def expand_wildcards(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Distinct keys matching any pattern with ``*``."""
    import re
    rx = "^(?:" + "|".join(re.escape(p).replace(r"\*", ".*") for p in patterns) + ")$"
    return event_keys(df).where(F.col("key").rlike(rx))


def publish(events: DataFrame, new: DataFrame, run_keys: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replace a run's own keys and report, per entity, how many rows went and came."""
    old = events.where(F.col("key").isin(run_keys))
    out = events.where(~F.col("key").isin(run_keys)).unionByName(new, allowMissingColumns=True)
    report = old.groupBy(*by).agg(F.count(F.lit(1)).alias("removed")).join(
        new.groupBy(*by).agg(F.count(F.lit(1)).alias("added")), by, "full").fillna(0, ["removed", "added"])
    return out, report


def sparse_signal(segments: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Segment metrics as a signal with one sample per segment midpoint."""
    from .intervals import midpoint
    return segments.select(*keys, midpoint("start_ts", "end_ts").alias("ts"), *metrics).dropna(how="all", subset=metrics)


def model_verdict_events(candidates: DataFrame, keys: list[str], probability: str, threshold: float, suggested: float) -> DataFrame:
    """Candidates as accepted / suggested / rejected beat events."""
    p = F.col(probability)
    k = F.when(p >= threshold, "beat_ml_accepted").when(p >= suggested, "beat_ml_suggested").otherwise("beat_ml_rejected")
    return candidates.select(*keys, "ts", k.alias("key"), F.lit("point").alias("type"), p.alias("value"))


MODEL_PREFIX = "beat_ml_"


def replace_verdicts(events: DataFrame, candidates: DataFrame, keys: list[str], probability: str, threshold: float, suggested: float) -> DataFrame:
    """Events with a model's verdicts on ``candidates`` in the place of all earlier ones of these entities; other events and other
    entities stay. Columns that verdicts lack are null."""
    new = model_verdict_events(candidates, keys, probability, threshold, suggested)
    redone = candidates.select(*keys).distinct().withColumn("__redone", F.lit(True))
    kept = events.join(redone, keys, "left").where(~(F.coalesce(F.col("key").startswith(MODEL_PREFIX), F.lit(False)) & F.coalesce("__redone", F.lit(False)))).select(*events.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def verdict_beats(events: DataFrame) -> DataFrame:
    """A model's verdict events as beats again: ``verdict`` is accepted, suggested or rejected."""
    return events.where(F.col("key").startswith(MODEL_PREFIX)).withColumn("verdict", F.expr(f"substring(key, {len(MODEL_PREFIX) + 1})"))


def event_end_column(ts: str = "ts", duration: str = "duration_s") -> Column:
    return add_seconds(ts, F.coalesce(F.col(duration), F.lit(0.0)))


def edit_counts(events: DataFrame, keys: list[str], auto_keys: list[str], manual_keys: list[str]) -> DataFrame:
    """Manual and automatic events per entity."""
    return events.groupBy(*keys).agg(F.count_if(F.col("key").isin(manual_keys)).alias("n_manual"), F.count_if(F.col("key").isin(auto_keys)).alias("n_auto"))
