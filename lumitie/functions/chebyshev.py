"""Two-dimensional Chebyshev series over detector pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Detector pixel ranges mapped onto [-1, 1].
X_RANGE = (1.0, 2048.0)
Y_RANGE = (1.0, 4096.0)


def unit_interval(c: Column, lo: float, hi: float) -> Column:
    return F.lit(2.0) * (c.cast("double") - F.lit(lo)) / F.lit(hi - lo) - F.lit(1.0)


def basis(u: Column, degree: int) -> list:
    """T_0 .. T_degree of ``u``, in closed form via the power polynomials."""
    import numpy as np

    out = []
    for k in range(degree + 1):
        power = np.polynomial.chebyshev.cheb2poly([0.0] * k + [1.0])
        term = F.lit(float(power[-1]))
        for c in power[-2::-1]:
            term = term * u + F.lit(float(c)) if c else term * u
        out.append(term)
    return out


def series(tx: list, ty: list, coeffs: Column) -> Column:
    """Sum of coeffs[i * len(ty) + j] * tx[i] * ty[j]; NULL where coeffs is."""
    total = None
    for i, t in enumerate(tx):
        row = None
        for j, u in enumerate(ty):
            term = coeffs[i * len(ty) + j] * u
            row = term if row is None else row + term
        total = row * t if total is None else total + row * t
    return total


def evaluate(x: Column, y: Column, coeffs: Column, order: int = 3) -> Column:
    """Sum of coeffs[i * (order + 1) + j] * T_i(x) * T_j(y); NULL where coeffs is."""
    return series(basis(unit_interval(x, *X_RANGE), order), basis(unit_interval(y, *Y_RANGE), order), coeffs)


def with_series(df: DataFrame, name: str, coeffs: str = "coeffs", order: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``evaluate`` of the columns as ``name``.

    Polynomials are columns of stacked projections, so each is computed once for a row and the series stays inside
    generated code; written out in one expression it is too large for that.
    """
    kept = df.columns
    tx, ty = [f"_cx{i}" for i in range(order + 1)], [f"_cy{j}" for j in range(order + 1)]
    out = df.withColumns({"_cx": unit_interval(F.col(x), *X_RANGE), "_cy": unit_interval(F.col(y), *Y_RANGE)})
    out = out.withColumns({**dict(zip(tx, basis(F.col("_cx"), order))), **dict(zip(ty, basis(F.col("_cy"), order)))})
    value = series([F.col(t) for t in tx], [F.col(t) for t in ty], F.col(coeffs))
    return out.select(*[c for c in kept if c != name], value.alias(name))
