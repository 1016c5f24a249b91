"""Least squares from sums of products.

One aggregation pass with map-side combine yields the normal matrix of a few parameters;
only those sums, never rows, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitie.functions.chebyshev import basis
from lumitie.functions.special import correlation_p_value


@dataclass
class Fit:
    coeffs: np.ndarray
    n: int
    rms: float | None = None
    errors: np.ndarray | None = None


def _sums(features, target):
    out = [F.count(F.lit(1)).alias("n"), F.sum(target * target).alias("yy")]
    for i, f in enumerate(features):
        out.append(F.sum(f * target).alias(f"b{i}"))
        for j in range(i, len(features)):
            out.append(F.sum(f * features[j]).alias(f"g{i}_{j}"))
    return out


def _solve(row, k: int):
    gram = np.zeros((k, k))
    rhs = np.array([row[f"b{i}"] or 0.0 for i in range(k)], dtype=float)
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    coeffs = np.linalg.lstsq(gram / np.outer(scale, scale), rhs / scale, rcond=1e-13)[0] / scale
    return coeffs, gram


def least_squares(df: DataFrame, features, target: Column) -> Fit:
    """Ordinary least squares of ``target`` on a list of feature Columns."""
    row = df.agg(*_sums(features, target)).first()
    if not row["n"]:
        return Fit(np.full(len(features), np.nan), 0)
    coeffs, _ = _solve(row, len(features))
    return Fit(coeffs, int(row["n"]))


def predict(features, coeffs) -> Column:
    out = None
    for f, c in zip(features, coeffs):
        term = f * F.lit(float(c))
        out = term if out is None else out + term
    return out


def clipped_fit(df: DataFrame, features, target: Column, rounds: int, sigma: float = 3.0,
                least: int = 10, centred: bool = True):
    """Fit, clip against the residual scatter of the rows kept so far, repeat, fit again.

    ``centred`` measures scatter as the population std, otherwise as the RMS.  Returns
    the last fit and the Column that tells which rows it used; fewer than ``least``
    rows before any round end the clipping.
    """
    keep = F.lit(True)
    for _ in range(rounds):
        kept = df.where(keep)
        fit = least_squares(kept, features, target)
        if fit.n < least:
            break
        resid = target - predict(features, fit.coeffs)
        spread = kept.agg((F.stddev_pop(resid) if centred else
                           F.sqrt(F.avg(resid * resid))).alias("s")).first()["s"]
        keep = F.abs(resid) < F.lit(sigma * spread)
    kept = df.where(keep)
    row = kept.agg(*_sums(features, target)).first()
    n = int(row["n"])
    if n == 0:
        return Fit(np.full(len(features), np.nan), 0), keep
    coeffs, gram = _solve(row, len(features))
    resid = target - predict(features, coeffs)
    stats = kept.agg(F.sqrt(F.avg(resid * resid)).alias("rms"),
                     F.stddev_pop(resid).alias("std")).first()
    errors = None
    if n > len(features):
        errors = np.sqrt(np.abs(np.diag(np.linalg.pinv(gram))) * stats["rms"] ** 2)
    return Fit(coeffs, n, stats["std"] if centred else stats["rms"], errors), keep


def colour_term(df: DataFrame, colour: str, delta: str, rounds: int = 3):
    """Clipped line delta = a + b * colour; None when fewer than 10 rows remain."""
    features = [F.lit(1.0), F.col(colour)]
    usable = df.where(F.col(colour).isNotNull() & F.col(delta).isNotNull())
    fit, keep = clipped_fit(usable, features, F.col(delta), rounds, centred=False)
    return (fit, keep) if fit.n >= 10 else (None, keep)


def colour_polynomial(df: DataFrame, colour: str, delta: str, degree: int, rounds: int = 3):
    """Clipped polynomial colour term; coefficients from the highest power down.

    Fitted in a Chebyshev basis over the colour range, which keeps the sums well
    conditioned, and converted to powers at the end.
    """
    usable = df.where(F.col(colour).isNotNull() & F.col(delta).isNotNull())
    lo, hi, n = usable.agg(F.min(colour), F.max(colour), F.count(F.lit(1))).first()
    if n < degree + 5:
        return None, F.lit(True)
    span = (hi - lo) or 1.0
    features = basis(F.lit(2.0) * (F.col(colour) - F.lit(lo)) / F.lit(span) - F.lit(1.0), degree)
    fit, keep = clipped_fit(usable, features, F.col(delta), rounds, least=degree + 5,
                            centred=False)
    if fit.n < degree + 5:
        return None, keep
    series = np.polynomial.Chebyshev(fit.coeffs, domain=[lo, lo + span])
    power = series.convert(kind=np.polynomial.Polynomial, domain=[-1, 1], window=[-1, 1])
    coeffs = np.zeros(degree + 1)
    coeffs[: len(power.coef)] = power.coef
    fit.coeffs = coeffs[::-1]
    return fit, keep


def line(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Slope, intercept, correlation and its two-sided p-value per group."""
    fits = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))
    return fits.withColumn("p", correlation_p_value(F.col("r"), F.col("n")))
