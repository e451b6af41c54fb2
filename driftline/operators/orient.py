"""Vector calibration and orientation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.stats import steady_mean


def norm(xyz: list[Column | str]) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in xyz]
    return F.sqrt(sum((c * c for c in cols), F.lit(0.0)))


def field_intensity(df: DataFrame, acc: list[str], mag: list[str]) -> DataFrame:
    """Norms of two triaxial fields and the inclination -asin(a·m / (|a||m|)) in degrees."""
    dot = sum((F.col(a) * F.col(m) for a, m in zip(acc, mag)), F.lit(0.0))
    return df.withColumns({"acc_intensity": norm(acc), "mag_intensity": norm(mag)}).withColumn(
        "inclination_deg", -F.degrees(F.asin(F.try_divide(dot, F.col("acc_intensity") * F.col("mag_intensity")))))


def estimate_offsets(df: DataFrame, keys: list[str], xyz: list[str], max_condition: float = 1e3) -> DataFrame:
    """Per-entity offsets that make the field norm most constant: least squares by its normal equations.

    The 4×4 sums are one map-side-combined aggregate over rows without nulls; only they reach Python.
    A badly conditioned system gives null offsets and status ``poor_condition``.
    """
    x = [F.col(c).cast("double") for c in xyz]
    ok = df.where(x[0].isNotNull() & x[1].isNotNull() & x[2].isNotNull())
    b = sum((c * c for c in x), F.lit(0.0))
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(b).alias("b")]
    for i in range(3):
        aggs += [F.sum(x[i]).alias(f"s{i}"), F.sum(b * x[i]).alias(f"bs{i}")]
        aggs += [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for j in range(i, 3)]
    sums = ok.groupBy(*keys).agg(*aggs)
    names = ["n", "b", *[f"s{i}" for i in range(3)], *[f"bs{i}" for i in range(3)], "s00", "s01", "s02", "s11", "s12", "s22"]

    @F.pandas_udf("ox double, oy double, oz double, status string")
    def solve(t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in t.itertuples(index=False):
            mb = np.sqrt(r.b / r.n)
            q = np.array([[r.s00, r.s01, r.s02], [r.s01, r.s11, r.s12], [r.s02, r.s12, r.s22]])
            s = np.array([r.s0, r.s1, r.s2])
            R = np.zeros((4, 4))
            R[:3, :3], R[:3, 3], R[3, :3], R[3, 3] = 4 * q, 2 * mb * s, 2 * mb * s, r.n * mb * mb
            rhs = np.array([2 * r.bs0, 2 * r.bs1, 2 * r.bs2, mb * r.b])
            if not np.isfinite(R).all() or np.linalg.cond(R) > max_condition:
                rows.append((None, None, None, "poor_condition"))
            else:
                h = -np.linalg.solve(R, rhs)
                rows.append((h[0], h[1], h[2], "ok"))
        return pd.DataFrame(rows, columns=["ox", "oy", "oz", "status"])

    return sums.withColumn("__o", solve(F.struct(*names))).select(*keys, "__o.*")


def apply_offsets(df: DataFrame, offsets: DataFrame, keys: list[str], xyz: list[str]) -> DataFrame:
    """Add the estimated offsets; entities without a solution are unchanged."""
    j = df.join(offsets, keys, "left")
    return j.withColumns({c: F.col(c) + F.coalesce(F.col(o), F.lit(0.0)) for c, o in zip(xyz, ("ox", "oy", "oz"))}).drop("ox", "oy", "oz", "status")


def mean_posture(df: DataFrame, keys: list[str], xyz: list[str], calm: Column, prior: DataFrame | None = None) -> DataFrame:
    """Belly-down posture per entity: prior configuration, else mean of calm rows, else overall mean, else [1, 0, -1].

    The means do not depend on the order of rows: a vector along its own mean has a roll of 180 or -180 degrees by their last bit."""
    m = df.groupBy(*keys).agg(*[steady_mean(F.when(calm, F.col(c))).alias(f"calm{i}") for i, c in enumerate(xyz)],
                              *[steady_mean(c).alias(f"all{i}") for i, c in enumerate(xyz)])
    if prior is not None:
        m = m.join(prior, keys, "left")
    last = [1.0, 0.0, -1.0]
    pick = lambda i: F.coalesce(*([F.col(f"prior{i}")] if prior is not None else []), F.col(f"calm{i}"), F.col(f"all{i}"), F.lit(last[i]))
    return m.select(*keys, *[pick(i).alias(f"abar{i}") for i in range(3)])


def posture_angles(p: DataFrame, keys: list[str]) -> DataFrame:
    """Mounting pitch p0 and roll r0 (radians) of a mean posture abar0..abar2."""
    n = norm(["abar0", "abar1", "abar2"])
    p0 = -F.asin(F.col("abar0") / n)
    r0 = F.atan2(F.col("abar1"), F.col("abar2"))
    return p.select(*keys, p0.alias("p0"), r0.alias("r0"))


def _rotate(v: list[Column], p: Column, r: Column) -> list[Column]:
    """Row vector times (P(p) R(r)) transposed: the vector seen after undoing the mounting angles."""
    x, y, z = v
    yy = y * F.cos(r) - z * F.sin(r)
    zz = y * F.sin(r) + z * F.cos(r)
    return [x * F.cos(p) + zz * F.sin(p), yy, zz * F.cos(p) - x * F.sin(p)]


def animal_frame(df: DataFrame, angles: DataFrame, keys: list[str], acc: list[str], others: dict[str, list[str]] | None = None,
                 mag: list[str] | None = None, declination: str | None = None) -> DataFrame:
    """Rotate tag vectors into the animal frame; pitch, roll and tilt-compensated heading in degrees.

    Rotated channels are named ``<channel>_animal``. A side component within rounding of zero is zero, so upside down is a roll of 180 and never
    -180 degrees by a last bit. Heading needs ``mag``; the declination (degrees) is a column.
    """
    j = df.join(angles, keys)
    p, r = F.col("p0"), F.col("r0")
    for name, chans in {"acc": acc, **({"mag": mag} if mag else {}), **(others or {})}.items():
        # first the roll, then the pitch of the transposed product
        rot = _rotate([F.col(c).cast("double") for c in chans], p, r)
        j = j.withColumns({f"{c}_animal": e for c, e in zip(chans, rot)})
    a = [F.col(f"{c}_animal") for c in acc]
    level = (F.abs(a[1]) <= 1e-15 * F.abs(a[2])) & (F.abs(a[2]) < 1e300)
    side = F.when(level, F.lit(0.0)).otherwise(a[1])
    j = j.withColumns({"pitch_deg": -F.degrees(F.asin(F.try_divide(a[0], norm(a)))), "roll_deg": F.degrees(F.atan2(side, a[2]))})
    if mag:
        rr, pp = F.radians("roll_deg"), F.radians("pitch_deg")
        h = _rotate([F.col(f"{c}_animal") for c in mag], pp, rr)
        j = j.withColumn("heading_deg", F.degrees(F.atan2(h[1], h[0])) + (F.coalesce(F.col(declination), F.lit(0.0)) if declination else 0.0))
    return j.drop("p0", "r0")


def unit_norm(df: DataFrame, xyz: list[str]) -> DataFrame:
    """Scale each row to length one; a zero row becomes null."""
    n = norm(xyz)
    return df.withColumns({c: F.try_divide(F.col(c), n) for c in xyz})


# Column names an orientation frame may use.
ORIENTATION_ALIASES = {"pitch": ["pitch", "pitch_deg"], "roll": ["roll", "roll_deg"], "heading": ["heading", "heading_deg", "yaw", "head"]}


def orientation_frame(frames: list[DataFrame], keys: list[str], ts: str, axis: Axis | None = None, max_rows: int | None = None) -> DataFrame:
    """One pitch/roll/heading frame from a grouped signal or from split signals; a missing heading is 0.

    ``max_rows`` thins the track evenly and keeps both ends (needs ``axis``).
    """
    from ..schema import canonical
    from .sampling import even_subsample
    out = None
    for f in frames:
        c = canonical(f, ORIENTATION_ALIASES)
        have = [k for k in ORIENTATION_ALIASES if c.schema[k].dataType.typeName() != "void"]
        c = c.select(*keys, ts, *have)
        out = c if out is None else out.join(c.drop(*[h for h in have if h in out.columns]), [*keys, ts])
    if "heading" not in out.columns:
        out = out.withColumn("heading", F.lit(None).cast("double"))
    out = out.withColumn("heading", F.coalesce("heading", F.lit(0.0)))
    return even_subsample(out, axis, max_rows) if max_rows else out


def accel_orientation(df: DataFrame, axis: Axis, xyz: list[str], fs: float, static_s: float = 2.0, min_samples: int = 3) -> DataFrame:
    """Accelerometer-only posture: static window (widened for slow tags), pitch, roll, dynamic part, ODBA and jerk."""
    from .rolling import norm_jerk, static_dynamic
    n = max(int(round(static_s * fs)), min_samples)
    n += 1 - n % 2
    s = norm_jerk(static_dynamic(df, axis, n, xyz), axis, xyz, fs)
    st = [F.col(f"{c}_static") for c in xyz]
    return s.withColumns({
        "pitch_deg": -F.degrees(F.asin(F.try_divide(st[0], norm(st)))), "roll_deg": F.degrees(F.atan2(st[1], st[2])),
        "odba": norm([f"{c}_dynamic" for c in xyz])})
