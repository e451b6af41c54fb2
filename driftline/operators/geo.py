"""Geospatial tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..core.axis import Axis
from ..core.halo import halo_time_apply
from ..functions import dsp
from .timebase import grid, grid_axis, interpolate_onto


def regularize_track(df: DataFrame, axis: Axis, step_s: float, columns: list[str]) -> DataFrame:
    """Track on a fixed step from the first whole step after its start to the last before its end, linear in time."""
    keys = list(axis.keys)
    w = int(step_s * 1_000_000)
    b = df.groupBy(*keys).agg(
        F.timestamp_micros((F.ceil(F.unix_micros(F.min(axis.ts)) / w) * w).cast("bigint")).alias("lo"),
        F.timestamp_micros((F.floor(F.unix_micros(F.max(axis.ts)) / w) * w).cast("bigint")).alias("hi"))
    axis = grid_axis(axis, b, "lo", "hi", w)
    return interpolate_onto(grid(b, keys, "lo", "hi", w, axis.ts, axis.tasks), df, axis, columns)


EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6371000.0
M_PER_DEGREE = 111_320.0


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    a, b, c, d = (F.radians(F.col(x) if isinstance(x, str) else x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def two_pass_speed_filter(df: DataFrame, axis: Axis, lat: str, lon: str, max_kmh: float, filtered_type: Column) -> DataFrame:
    """Speed filter over one fix type forward and then backward; other types are kept. One row per instant.

    The backward pass runs over the survivors of the forward pass.
    """
    from .folds import speed_filter
    keys = list(axis.keys)
    fwd = speed_filter(df.where(filtered_type), axis, lat, lon, max_kmh, "__bad").where("NOT __bad").drop("__bad")
    rev = fwd.withColumn("__rt", -F.unix_micros(axis.ts)).withColumn("__rk", -F.col(axis.order[1])) if len(axis.order) > 1 else \
        fwd.withColumn("__rt", -F.unix_micros(axis.ts)).withColumn("__rk", F.lit(0))
    good = speed_filter(rev, axis.with_(order=("__rt", "__rk")), lat, lon, max_kmh, "__bad").where("NOT __bad").drop("__bad", "__rt", "__rk")
    both = df.where(~filtered_type).withColumn("__p", F.lit(0)).unionByName(good.withColumn("__p", F.lit(1)))
    rest = [c for c in df.columns if c not in (*keys, axis.ts)]
    return both.groupBy(*keys, axis.ts).agg(F.min_by(F.struct(*rest), F.struct("__p", *axis.order[1:])).alias("__r")).select(*keys, axis.ts, "__r.*")


# Equinox days (month, day), the window around them and the widening of latitude errors.
EQUINOXES = [(3, 20), (9, 22)]
EQUINOX_WINDOW_DAYS = 21
EQUINOX_LAT_INFLATION = 2.5
LAT_SIGMA_DEG = 2.0
LON_SIGMA_DEG = 0.7


def days_from_equinox(ts: Column | str) -> Column:
    """Whole days (floored towards the past, as differences of instants) to the nearest equinox, years ±1 included."""
    t = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(t)
    day = 86_400_000_000
    best = []
    for dy in (-1, 0, 1):
        for m, d in EQUINOXES:
            e = F.unix_micros(F.make_timestamp(F.year(t) + dy, F.lit(m), F.lit(d), F.lit(0), F.lit(0), F.lit(0)))
            best.append(F.abs(F.floor((us - e) / day)))
    return F.least(*best).cast("double")


def latitude_sigma(ts: Column | str, base: float = LAT_SIGMA_DEG) -> Column:
    """Latitude error, wider near the equinoxes where day length says little about latitude."""
    return F.lit(base) * F.when(days_from_equinox(ts) <= EQUINOX_WINDOW_DAYS, EQUINOX_LAT_INFLATION).otherwise(1.0)


def kernel_smooth(df: DataFrame, axis: Axis, columns: dict[str, Column], tau_s: float, reach: float = 8.0) -> DataFrame:
    """Gaussian-in-time, weighted mean over neighbouring rows; ``columns``: name -> weight. Adds ``<name>_smoothed``.

    Neighbours beyond ``reach`` time constants (weight below 1e-13) may be left out, so chunks with a time halo suffice. Inside a
    chunk a fast Gauss transform adds up all pairs at a cost linear in the rows, however dense the track is (``dsp.gauss_sums``).
    """
    names = list(columns)
    far = int(reach * tau_s * 1e6)
    d = df.withColumns({f"__w_{c}": w.cast("double") for c, w in columns.items()})

    def run(x, pos):
        t = (pos - pos[0]) / 1e6 / tau_s
        out = {}
        for c in names:
            v = x[c]
            w = np.where(np.isnan(v), 0.0, x[f"__w_{c}"])
            num, den = dsp.gauss_sums(t, np.stack([w * np.where(np.isnan(v), 0.0, v), w]), reach)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"{c}_smoothed"] = num / den
        return out

    got = halo_time_apply(d, axis.with_(width=max(axis.width, 4 * far)), far, far, run, [*names, *[f"__w_{c}" for c in names]], {f"{c}_smoothed": "double" for c in names})
    return got.drop(*[f"__w_{c}" for c in names])


def smooth_geolocation(df: DataFrame, axis: Axis, lat: str, lon: str, window_hours: float = 24.0, max_speed_kmh: float | None = 10.0) -> DataFrame:
    """Light-based track smoothing: flag speed outliers, then error-weighted Gaussian smoothing of the rest."""
    from .folds import speed_filter
    d = df.where(F.col(axis.ts).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    d = speed_filter(d, axis, lat, lon, max_speed_kmh) if max_speed_kmh is not None else d.withColumn("outlier", F.lit(False))
    sig = latitude_sigma(axis.ts)
    good = kernel_smooth(d.where("NOT outlier"), axis, {lat: 1 / (sig * sig), lon: F.lit(1 / LON_SIGMA_DEG ** 2)}, window_hours * 3600)
    bad = d.where("outlier")
    return good.unionByName(bad, allowMissingColumns=True).withColumns({"lat_sigma_deg": sig, "lon_sigma_deg": F.lit(LON_SIGMA_DEG)})


def hourly_smooth(df: DataFrame, axis: Axis, columns: list[str], sigma: float = 2.0, taps: int = 9) -> DataFrame:
    """Hourly interpolation from the first fix, then a normalised Gaussian over ``taps`` rows (ends renormalised)."""
    from ..core.scan import drop_halo, halo_rows, row_frame
    from ..core.scan import IDX
    keys, half = list(axis.keys), taps // 2
    b = df.groupBy(*keys).agg(F.date_trunc("second", F.min(axis.ts)).alias("a"), F.max(axis.ts).alias("b"))
    axis = grid_axis(axis, b, "a", "b", 3_600_000_000)
    g = interpolate_onto(grid(b, keys, "a", "b", 3_600_000_000, axis.ts, axis.tasks), df, axis, columns).dropna(subset=columns)
    h = halo_rows(g, axis.with_(order=(axis.ts,)), half, half)
    from pyspark.sql import Window as W
    from ..core.scan import HALO
    w = W.partitionBy(*keys, HALO).orderBy(IDX)
    import math
    tap = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-half, half + 1)]
    out = {}
    for c in columns:
        cells = [(F.lag(c, -j).over(w) if j < 0 else (F.lead(c, j).over(w) if j else F.col(c)), t) for j, t in zip(range(-half, half + 1), tap)]
        num = sum((F.coalesce(v * t, F.lit(0.0)) for v, t in cells), F.lit(0.0))
        den = sum((F.when(v.isNotNull(), t).otherwise(0.0) for v, t in cells), F.lit(0.0))
        out[f"{c}_smoothed"] = num / den
    return drop_halo(h.withColumns(out))


def bin_locations(df: DataFrame, keys: list[str], ts: str, lat: str, lon: str, bin_s: float, first: list[str]) -> DataFrame:
    """Mean position per time bin with the earliest ids of the bin."""
    from .timebase import bucket
    return df.groupBy(*keys, bucket(ts, bin_s).alias("bin_ts")).agg(
        F.avg(lat).alias(lat), F.avg(lon).alias(lon), *[F.min_by(c, F.col(ts)).alias(c) for c in first])


def values_at_locations(track: DataFrame, values: DataFrame, keys: list[str], ts: str, lat: str, lon: str, value: str, bin_s: float, first: list[str]) -> DataFrame:
    """Binned mean positions with the mean value of the same bin; bins without a value keep a null, bins without a position go."""
    from .timebase import bucket
    v = values.groupBy(*keys, bucket(ts, bin_s).alias("bin_ts")).agg(F.avg(value).alias(value))
    return bin_locations(track, keys, ts, lat, lon, bin_s, first).join(v, [*keys, "bin_ts"], "left")


def track_extent(df: DataFrame, keys: list[str], lat: str, lon: str, pad: float = 20.0, global_extent: bool = False) -> DataFrame:
    """Padded map extent; longitudes are measured on 0..360 and returned on -180..180."""
    if global_extent:
        return df.select(*keys).distinct().select(*keys, F.lit(-90.0).alias("lat_min"), F.lit(90.0).alias("lat_max"),
                                                  F.lit(-180.0).alias("lon_min"), F.lit(180.0).alias("lon_max"))
    l360 = F.pmod(F.col(lon), F.lit(360.0))
    e = df.groupBy(*keys).agg(F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(l360).alias("c"), F.max(l360).alias("d"))
    wrap = lambda v: F.pmod(F.pmod(v, F.lit(360.0)) + 180.0, F.lit(360.0)) - 180.0
    return e.select(*keys, F.greatest(F.lit(-90.0), F.col("a") - pad).alias("lat_min"), F.least(F.lit(90.0), F.col("b") + pad).alias("lat_max"),
                    wrap(F.col("c") - pad).alias("lon_min"), wrap(F.col("d") + pad).alias("lon_max"))


def offset_to_latlon(lat0: Column, lon0: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    """Metres east and north of a point as latitude and longitude."""
    lat = lat0 + north_m / M_PER_DEGREE
    return lat, lon0 + east_m / (M_PER_DEGREE * F.cos(F.radians(lat0)))


def sun_local_hour(date: Column, lat: Column, lon: Column, tz: Column | str, sunrise: bool) -> Column:
    """Local decimal hour of sunrise or sunset (almanac approximation, zenith 90.833°); null in polar day or night."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    n = F.dayofyear(date)
    lng = lon / 15.0
    t = n + ((6.0 if sunrise else 18.0) - lng) / 24.0
    m = 0.9856 * t - 3.289
    L = F.pmod(m + 1.916 * F.sin(F.radians(m)) + 0.020 * F.sin(F.radians(2 * m)) + 282.634, F.lit(360.0))
    ra = F.pmod(F.degrees(F.atan(0.91764 * F.tan(F.radians(L)))), F.lit(360.0))
    ra = (ra + F.floor(L / 90.0) * 90.0 - F.floor(ra / 90.0) * 90.0) / 15.0
    sin_dec = 0.39782 * F.sin(F.radians(L))
    cos_dec = F.cos(F.asin(sin_dec))
    cos_h = F.try_divide(F.cos(F.radians(F.lit(90.833))) - sin_dec * F.sin(F.radians(lat)), cos_dec * F.cos(F.radians(lat)))
    acos = F.degrees(F.acos(cos_h))
    h = ((360.0 - acos) if sunrise else acos) / 15.0
    ut = F.pmod(h + ra - 0.06571 * t - 6.622 - lng, F.lit(24.0))
    utc = F.timestamp_micros(F.unix_micros(F.to_timestamp(date)) + F.floor(ut * 3.6e9).cast("bigint"))
    local = F.from_utc_timestamp(utc, zone)
    hour = F.hour(local) + F.minute(local) / 60.0 + F.floor(F.second(local)) / 3600.0
    return F.when(cos_h.between(-1.0, 1.0), hour)


def grid_covariates(df: DataFrame, covariates: DataFrame, lat: str, lon: str, resolution: float, values: list[str]) -> DataFrame:
    """Values of a gridded table at positions: equal cell keys. ``covariates``: lat, lon, values (one row per cell)."""
    cell = lambda c: F.round(F.col(c) / resolution).cast("bigint")
    g = covariates.groupBy(cell("lat").alias("__cy"), cell("lon").alias("__cx")).agg(*[F.avg(v).alias(v) for v in values])
    d = df.withColumns({"__cy": cell(lat), "__cx": cell(lon)})
    return d.join(g, ["__cy", "__cx"], "left").drop("__cy", "__cx")


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)
