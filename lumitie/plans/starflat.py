"""Phase 4: illumination corrections over the detector plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.functions import chebyshev as C
from lumitie.functions import photometry as P
from lumitie.functions.epochs import epoch_for_ccd
from lumitie.operators.robust import attach, robust_stats, scalar_median



def usable_zeropoints(zp: DataFrame) -> DataFrame:
    """Solutions within 5 mag below the median of those above 1 (drops empty nodes)."""
    middle = scalar_median(zp.where(F.col("zp_solved") > 1.0), "zp_solved")
    low = (middle if middle is not None else float("inf")) - 5.0
    return zp.where(F.col("zp_solved") > F.lit(low))


def plane_residuals(dets: DataFrame, zp: DataFrame, cfg: Config) -> DataFrame:
    """Residuals with pixel position and epoch, from all phase-0 detections."""
    cal = dets.join(zp.select("expnum", "ccdnum", "zp_solved"), ["expnum", "ccdnum"])
    m = F.col("m_inst") + F.col("zp_solved")
    star = Window.partitionBy("objectid")
    w = P.weight(F.col("m_err"))
    resid = m - F.sum(w * m).over(star) / F.sum(w).over(star)
    bounds = cfg.starflat.epoch_boundaries
    return cal.select("objectid", "expnum", "ccdnum", "x", "y", "mjd",
                      epoch_for_ccd(F.col("mjd"), F.col("ccdnum"), bounds).alias("epoch"),
                      resid.alias("residual"))


def clipped(resid: DataFrame, value: str = "residual", keys=("ccdnum", "epoch")) -> DataFrame:
    """Rows within three robust sigmas of their group's median; the groups are few, as detectors and epochs are."""
    keys = list(keys)
    stats = robust_stats(resid, value, keys, few=True).select(*keys, "median", "sigma")
    joined = attach(resid, stats, keys, few=True)
    return joined.where(F.abs(F.col(value) - F.col("median")) < 3.0 * F.col("sigma")).drop(
        "median", "sigma")


def fit_chebyshev(rows: DataFrame, value: str, order: int = 3, least: int = 1,
                  keys=("ccdnum", "epoch")) -> DataFrame:
    """Chebyshev coefficients (row-major, i for x) per group by least squares.

    Products of Chebyshev polynomials are sums of two of them, so the whole normal
    matrix follows from the moments sum T_a(x) T_b(y), a and b up to twice the order.
    Only those sums are shuffled; a group of any size is one row afterwards.
    """
    keys, k = list(keys), order + 1
    top = 2 * order
    tx = C.basis(C.unit_interval(F.col("x"), *C.X_RANGE), top)
    ty = C.basis(C.unit_interval(F.col("y"), *C.Y_RANGE), top)
    named = rows.select(*keys, F.col(value).alias("_v"),
                        *[t.alias(f"_x{a}") for a, t in enumerate(tx)],
                        *[t.alias(f"_y{b}") for b, t in enumerate(ty)])
    moments = [F.sum(F.col(f"_x{a}") * F.col(f"_y{b}")) for a in range(top + 1) for b in range(top + 1)]
    loads = [F.sum(F.col(f"_x{i}") * F.col(f"_y{j}") * F.col("_v")) for i in range(k) for j in range(k)]
    sums = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stars"),
                                    F.array(*moments).alias("_m"), F.array(*loads).alias("_b"))
    sums = sums.where(F.col("n_stars") >= least)

    def solve(batches):
        i, j = np.divmod(np.arange(k * k), k)
        plus_i, minus_i = i[:, None] + i, np.abs(i[:, None] - i)
        plus_j, minus_j = j[:, None] + j, np.abs(j[:, None] - j)
        for pdf in batches:
            out = []
            for m, b in zip(pdf["_m"], pdf["_b"]):
                s = np.asarray(m, dtype=float).reshape(top + 1, top + 1)
                gram = (s[plus_i, plus_j] + s[plus_i, minus_j]
                        + s[minus_i, plus_j] + s[minus_i, minus_j]) / 4.0
                out.append(np.linalg.lstsq(gram, np.asarray(b, dtype=float), rcond=1e-12)[0].tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in keys}, "n_stars": pdf["n_stars"],
                                "coeffs": pd.Series(out, index=pdf.index, dtype=object)})

    ddl = ", ".join([*(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys),
                     "n_stars bigint", "coeffs array<double>"])
    return sums.mapInPandas(solve, ddl)


def corrections(dets: DataFrame, zp: DataFrame, cfg: Config, stage):
    """(coefficients, staged clipped residuals) for groups with enough points twice."""
    least = cfg.starflat.min_stars_per_bin
    resid = stage.write(plane_residuals(dets, usable_zeropoints(zp), cfg), "plane-resid")
    sizes = resid.groupBy("ccdnum", "epoch").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= least).drop("_n")
    good = stage.write(clipped(attach(resid, sizes, ["ccdnum", "epoch"], few=True)), "plane-good")
    coeffs = stage.write(fit_chebyshev(good, "residual", cfg.starflat.polynomial_order, least),
                         "coeffs")
    return coeffs, good


def correction_stats(good: DataFrame, coeffs: DataFrame, order: int = 3) -> DataFrame:
    """Per group: points, size of the correction, residual RMS before and after (mmag)."""
    rms = lambda c: F.sqrt(F.avg(c * c)) * 1000.0
    joined = attach(good, coeffs.select("ccdnum", "epoch", "coeffs"), ["ccdnum", "epoch"], few=True)
    joined = C.with_series(joined, "_fit", order=order)
    return joined.groupBy("ccdnum", "epoch").agg(
        F.count(F.lit(1)).alias("n_stars"), rms(F.col("_fit")).alias("correction_rms_mmag"),
        rms(F.col("residual")).alias("rms_before_mmag"),
        rms(F.col("residual") - F.col("_fit")).alias("rms_after_mmag"))


def flat_offset(rows: DataFrame, coeffs: DataFrame | None, cfg: Config) -> DataFrame:
    """Add ``delta_sf``: the correction at each detection, 0 without a fit."""
    if coeffs is None:
        return rows.withColumn("delta_sf", F.lit(0.0))
    bounds = cfg.starflat.epoch_boundaries
    keyed = rows.withColumn("epoch", epoch_for_ccd(F.col("mjd"), F.col("ccdnum"), bounds))
    joined = keyed.join(coeffs.select("ccdnum", "epoch", "coeffs"), ["ccdnum", "epoch"], "left")
    joined = C.with_series(joined, "delta_sf", order=cfg.starflat.polynomial_order)
    known = F.col("mjd").isNotNull()
    return joined.withColumn("delta_sf", F.coalesce(F.when(known, F.col("delta_sf")), F.lit(0.0))).drop(
        "coeffs", "epoch")


def apply_flat(rows: DataFrame, coeffs: DataFrame, cfg: Config) -> DataFrame:
    """Detections with the systematic removed from m_inst."""
    out = flat_offset(rows, coeffs, cfg)
    return out.withColumn("m_inst", F.col("m_inst") - F.col("delta_sf")).drop("delta_sf")
