"""Unit tokens and conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

G = 9.80665
PI = 3.141592653589793

# Fixed values: (from, to, factor).
CONVERSIONS = [
    ("g", "m/s^2", G),
    ("m/s^2", "g", 1 / G),
    ("gauss", "ut", 100.0),
    ("ut", "ut", 1.0),
    ("rps", "mrad/s", 2000 * PI),
    ("rad/s", "mrad/s", 1000.0),
    ("rad", "deg", 180 / PI),
    ("bar", "m", 10.0),
    ("cm", "m", 0.01),
    ("m", "m", 1.0),
    ("count/5s", "spm", 12.0),
    ("hz", "spm", 60.0),
    ("hz", "bpm", 60.0),
]

# Spellings of one unit, and what counts as no unit.
ALIASES = {
    "meter": "m", "meters": "m", "metre": "m", "metres": "m", "sec": "s", "second": "s", "seconds": "s",
    "m/s2": "m/s^2", "m/s²": "m/s^2", "gs": "g", "µt": "ut", "μt": "ut", "degrees": "deg", "degree": "deg", "radians": "rad",
}
NO_UNIT = ["", "nan", "none", "null", "unknown", "n/a", "na"]


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def unit_token(unit: Column) -> Column:
    """Normalised unit: lower case, without blanks, one spelling; empty for no unit."""
    t = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"\s+", "")
    return F.coalesce(_literal_map({**ALIASES, **{n: "" for n in NO_UNIT}})[t], t)


def convert(value: Column, unit: Column, target: Column | str, strict: bool = True) -> Column:
    """Value in the target unit. An unknown pair raises when the job runs, or leaves the value (``strict=False``).

    A value already in the target unit is untouched, so converting twice is converting once. The factors are
    one literal map, looked up by the pair of units.
    """
    u, t = unit_token(unit), unit_token(F.lit(target) if isinstance(target, str) else target)
    factor = _literal_map({f"{a}>{b}": f for a, b, f in CONVERSIONS})[F.concat(u, F.lit(">"), t)]
    fail = F.raise_error(F.concat(F.lit("no conversion from '"), u, F.lit("' to '"), t, F.lit("'"))).cast("double") if strict else value
    return F.when(u == t, value).when(factor.isNotNull(), value * factor).otherwise(fail)


def name_unit(raw: Column) -> tuple[Column, Column]:
    """Split ``name [unit]`` or ``name (unit)`` into channel name and unit (null without one)."""
    p = r"^\s*(.*?)\s*[\[\(]\s*([^\]\)]*?)\s*[\]\)]\s*$"
    n, u = F.regexp_extract(raw, p, 1), F.regexp_extract(raw, p, 2)
    return F.when(n != "", n).otherwise(F.trim(raw)), F.when(u != "", u)
