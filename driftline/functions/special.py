"""Special functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Lanczos coefficients for g = 7.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 0.5."""
    x = z - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + k)
    t = x + LANCZOS_G + 0.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series)


def log_half_step(a: Column) -> Column:
    """log Γ(a + 1/2) - log Γ(a), without the cancellation of a difference where ``a`` is large."""
    u = F.lit(1.0) / a
    far = 0.5 * F.log(a) - u / 8 + u ** 3 / 192 - u ** 5 / 640 + 17 * u ** 7 / 14336
    return F.when(a >= 20, far).otherwise(log_gamma(a + 0.5) - log_gamma(F.greatest(a, F.lit(0.5))))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz rule; the terms needed grow with the root
    of the larger parameter."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < 1e-300, tiny).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / safe(1.0 - (a + b) * x / (a + 1.0))).alias("d"), F.lit(0.0).alias("h"))
    start = F.struct(start["c"].alias("c"), start["d"].alias("d"), start["d"].alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / safe(1.0 + even * s["d"])
        c = safe(1.0 + even / s["c"])
        h = s["h"] * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = 1.0 / safe(1.0 + odd * d)
        c2 = safe(1.0 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    terms = F.sequence(F.lit(1), (60 + 5 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(terms, start, step, lambda s: s["h"])


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability that a Student t variable of ``df`` degrees of freedom is at least as far from 0 as ``t``. The relative error
    is about 1e-16 times ``df``."""
    a, half = df.cast("double") / 2, F.lit(0.5)
    x = a * 2 / (a * 2 + t * t)
    y = t * t / (a * 2 + t * t)  # 1 - x without cancellation
    front = F.exp(log_half_step(a) - 0.5 * math.log(math.pi) + a * F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x)) + 0.5 * F.log(y))
    near = front * _fraction(a, half, x) / a
    far = 1.0 - front * _fraction(half, a, y) / 0.5
    p = F.when(x < (a + 1) / (a + 2.5), near).otherwise(far)
    return F.when(t.isNull() | (df <= 0), F.lit(None).cast("double")).when(y == 0, 1.0).when(x == 0, 0.0).otherwise(p)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs, against none: t with n - 2 degrees of freedom; 0 for a perfect
    one, 1 for two pairs."""
    df = n - 2
    t = F.abs(r) * F.sqrt(df / F.nullif((1 - r) * (1 + r), F.lit(0.0)))
    return F.when(n == 2, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, df))
