"""Special functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lanczos approximation of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
LANCZOS_G = 7.0
#: Keeps a continued fraction away from a division by zero.
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2."""
    z = x - F.lit(1.0)
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + F.lit(float(k)))
    t = z + F.lit(LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.log(t) - t + F.log(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz method.

    It needs about the square root of the larger parameter in steps, which run inside one expression per row.
    """
    guard = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    steps = F.sequence(F.lit(1), (F.lit(40) + 4 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    d0 = F.lit(1.0) / guard(F.lit(1.0) - (a + b) * x / (a + F.lit(1.0)))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(state: Column, term: Column) -> Column:
        d = F.lit(1.0) / guard(F.lit(1.0) + term * state["d"])
        c = guard(F.lit(1.0) + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def even(m: Column) -> Column:
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def odd(m: Column) -> Column:
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    # two half steps for each m, as steps 2m and 2m + 1 of one fold
    both = F.flatten(F.transform(steps, lambda m: F.array(even(m.cast("double")), odd(m.cast("double")))))
    return F.aggregate(both, start, half, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 1/2; NULL arguments give NULL."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(F.lit(1.0) - x))
    direct = front * _fraction(x, a, b) / a
    mirror = F.lit(1.0) - front * _fraction(F.lit(1.0) - x, b, a) / b
    inner = F.when(x < (a + F.lit(1.0)) / (a + b + F.lit(2.0)), direct).otherwise(mirror)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x.isNotNull(), inner)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n rows, from Student's t with n - 2 degrees of freedom; NULL below three rows."""
    dof = n.cast("double") - F.lit(2.0)
    share = F.greatest(F.lit(0.0), F.lit(1.0) - r * r)
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), incomplete_beta(share, F.greatest(dof, F.lit(1.0)) / 2.0, F.lit(0.5)))
