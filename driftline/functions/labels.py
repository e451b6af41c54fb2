"""Label vocabularies: token maps, alias groups, key parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Behaviour tokens in matching order (first token contained in the text wins) and their class.
CANONICAL_BEHAVIOR = {
    "surface_sleep": "Resting",
    "benthic_sleep": "Resting",
    "drift_sleep": "Resting",
    "putative_rest": "Resting",
    "sleep": "Resting",
    "motionless_resting": "Resting",
    "calm_resting": "Resting",
    "resting": "Resting",
    "surfacing": "Vigilant",
    "diving": "Active",
    "active": "Active",
    "wake": "Active",
    "walking": "Active",
    "running": "Active",
    "trotting": "Active",
    "swimming": "Active",
    "feeding": "Feeding",
    "drinking": "Drinking",
    "calm": "Calm",
    "vigilant": "Vigilant",
    "scanning": "Vigilant",
}

# Rest tokens in matching order and the subtype they stand for.
REST_SUBTYPE = {
    "surface_sleep": "surface_sleep",
    "benthic_sleep": "benthic_sleep",
    "long_flat": "benthic_sleep",
    "drift_sleep": "drift_sleep",
    "long_drift": "drift_sleep",
}

NOT_REST = ["", "not_sleep", "find_rest.not_sleep"]


def token_map(text: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Value of the first token, in map order, that the text contains (case-insensitive)."""
    low = F.lower(F.trim(text))
    out = None
    for token, value in mapping.items():
        out = F.when(low.contains(token.lower()), F.lit(value)) if out is None else out.when(low.contains(token.lower()), F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def canonical_behavior(text: Column, mapping: dict[str, str] = CANONICAL_BEHAVIOR) -> Column:
    """Behaviour class of a raw label; ``Unknown`` when blank, ``Unmapped: x`` when no token fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "Unknown").otherwise(token_map(t, mapping, F.concat(F.lit("Unmapped: "), t)))


def rest_subtype(text: Column, mapping: dict[str, str] = REST_SUBTYPE) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(~t.isin(NOT_REST), token_map(t, mapping))


def resolve_alias(df: DataFrame, label: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Canonical key of a label through a vocabulary table (alias, key); unknown labels stay themselves.

    The vocabulary is read once per alias, the first key by name; Spark broadcasts it if it is small.
    """
    v = vocabulary.groupBy(F.lower(F.trim("alias")).alias("__alias")).agg(F.min("key").alias("__key"))
    return df.withColumn("__alias", F.lower(F.trim(label))).join(v, "__alias", "left").withColumn(
        out, F.coalesce("__key", label)).drop("__alias", "__key")


def slug(text: Column) -> Column:
    """Lower case, trimmed, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# Key prefixes and the group they belong to, in matching order.
KEY_GROUPS = [
    ("behavior_", "behavior"), ("rf_behavior_", "behavior"), ("rf_active_", "behavior"), ("rf_calm_", "behavior"),
    ("rf_motionless_", "behavior"), ("active_", "behavior"), ("calm_", "behavior"), ("motionless_", "behavior"),
    ("dive-type_", "dive-type"), ("dive_type_", "dive-type"), ("sleep-state_", "sleep-state"), ("sleep_state.", "sleep-state"),
    ("find_rest", "find_rest"),
]


def key_parent(key: Column) -> Column:
    """Group of an event key: numbered clusters under ``k<M>``, known prefixes, else the part before the first dot."""
    k, low = F.regexp_extract(key, r"(?i)^\d+_k(\d+)_", 1), F.lower(key)
    out = F.when(k != "", F.concat(F.lit("k"), k))
    for prefix, group in KEY_GROUPS:
        out = out.when(low.startswith(prefix), group)
    return out.otherwise(F.substring_index(key, ".", 1))


def cluster_rank(key: Column) -> tuple[Column, Column]:
    """Rank N and cluster count M of a palette key ``N_kM_…``."""
    p = r"^(\d+)_k(\d+)_"
    n, m = F.regexp_extract(key, p, 1), F.regexp_extract(key, p, 2)
    return F.when(n != "", n.cast("int")), F.when(m != "", m.cast("int"))


def split_pipe(text: Column) -> Column:
    """Non-blank parts of a pipe-separated value."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def filename_date(name: Column) -> Column:
    """First ISO or compact date found in a file name."""
    iso = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_extract(name, r"(?:^|\D)(\d{8})(?:\D|$)", 1)
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(compact, "yyyyMMdd"))


def hh_mm(hours: Column) -> Column:
    """Decimal hours as HH:MM, rounded to the minute and wrapped at 24 h."""
    m = F.round(hours * 60).cast("bigint") % 1440
    return F.format_string("%02d:%02d", F.floor(m / 60), m % 60)
