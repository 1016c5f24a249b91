"""Large-scale gradients of the unanchored solution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.functions import photometry as P
from lumitie.operators.regress import clipped_fit, least_squares, predict
from lumitie.operators.robust import scalar_median
from lumitie.operators.solver import shift_to_anchors


@dataclass
class Gradient:
    ra_slope: float = 0.0           # mmag per degree
    dec_slope: float = 0.0
    ra_center: float | None = None
    dec_center: float | None = None
    n_stars: int = 0
    color_source: str = "g-r"
    source: str = "gaia"
    applied: bool = False


def star_means(star_lists: DataFrame, zp: DataFrame, name: str, least: int) -> DataFrame:
    """Soft-weighted calibrated magnitude per star with at least ``least`` rows."""
    w = P.weight(F.col("m_err"), P.SOFT_FLOOR)
    cal = star_lists.join(zp.where(P.is_finite(F.col("zp_solved")))
                          .select("expnum", "ccdnum", "zp_solved"), ["expnum", "ccdnum"])
    out = cal.groupBy("objectid").agg(
        F.sum(w * (F.col("m_inst") + F.col("zp_solved"))).alias("_wm"), F.sum(w).alias("_w"),
        F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= least).select("objectid", (F.col("_wm") / F.col("_w")).alias(name))


def gradient_sample(star_lists: DataFrame, zp: DataFrame, other_lists: DataFrame,
                    other_zp: DataFrame, gaia: DataFrame, band: str) -> DataFrame:
    """Stars with residual (mmag), g-r and position, before the residual clip."""
    ref = "phot_bp_mean_mag" if band == "g" else "phot_rp_mean_mag"
    stars = star_means(star_lists, zp, "m_cal", 2).join(
        star_means(other_lists, other_zp, "m_other", 1), "objectid")
    good = gaia.where(F.col(ref).between(10.0, 25.0) & F.col("bp_rp").between(0.3, 3.5)
                      & (F.col("phot_g_mean_flux_over_error") > 50.0))
    good = good.select(F.col("nsc_objectid").alias("objectid"), "ra", "dec", F.col(ref).alias("_ref"))
    joined = stars.join(good, "objectid")
    gr = P.colour(band, F.col("m_cal"), F.col("m_other"))
    return joined.select("objectid", "ra", "dec", gr.alias("gr"),
                         ((F.col("m_cal") - F.col("_ref")) * 1000.0).alias("resid_mmag"))


def fit_gradient(sample: DataFrame, stage) -> Gradient:
    """Cubic in colour plus a plane on the sky, refitted once after a 3 sigma clip."""
    sample = stage.write(sample, "gradient-sample")
    middle = scalar_median(sample, "resid_mmag")
    if middle is None:
        return Gradient()
    cut = sample.where(F.col("resid_mmag").between(middle - 500.0, middle + 500.0)
                       & F.col("gr").between(-0.5, 2.5))
    n, ra0, dec0 = cut.agg(F.count(F.lit(1)), F.avg("ra"), F.avg("dec")).first()
    if n < 100:
        return Gradient(n_stars=n)
    dc = F.col("gr") - F.lit(scalar_median(cut, "gr"))
    features = [dc, dc * dc, dc * dc * dc, F.col("ra") - F.lit(ra0), F.col("dec") - F.lit(dec0),
                F.lit(1.0)]
    target = F.col("resid_mmag")
    first = least_squares(cut, features, target)
    scatter = target - predict(features, first.coeffs)
    std = cut.agg(F.stddev_pop(scatter)).first()[0]
    second = least_squares(cut.where(F.abs(scatter) < F.lit(3.0 * std)), features, target)
    fit = second if second.n > 100 else first
    return Gradient(float(fit.coeffs[3]), float(fit.coeffs[4]), ra0, dec0, fit.n, applied=True)


def subtract_plane(zp: DataFrame, positions: DataFrame, g: Gradient, anchors: DataFrame | None):
    """Remove the plane from every node with a position, then re-shift to the anchors."""
    if not g.applied:
        return zp
    pos = positions.select("expnum", "ccdnum", "ra_mean", "dec_mean")
    plane = (F.lit(g.ra_slope) * (F.col("ra_mean") - F.lit(g.ra_center))
             + F.lit(g.dec_slope) * (F.col("dec_mean") - F.lit(g.dec_center))) / 1000.0
    out = (zp.join(pos, ["expnum", "ccdnum"], "left")
           .withColumn("zp_solved", F.col("zp_solved") - F.coalesce(plane, F.lit(0.0)))
           .drop("ra_mean", "dec_mean"))
    return shift_to_anchors(out, anchors)[0] if anchors is not None else out


def gaia_detrend(zp: DataFrame, star_lists: DataFrame, other_lists: DataFrame, other_zp: DataFrame,
                 gaia: DataFrame, positions: DataFrame, anchors: DataFrame, band: str, stage):
    """Measure the sky gradient against Gaia and take it out of the solution."""
    sample = gradient_sample(star_lists, zp, other_lists, other_zp, gaia, band)
    g = fit_gradient(sample, stage)
    return subtract_plane(zp, positions, g, anchors), g


def anchor_plane(zp: DataFrame, positions: DataFrame, anchors: DataFrame):
    """Plane through the anchor differences below 200 mmag; needs more than 100 nodes."""
    ref = anchors.where(P.valid_zp(F.col("zp_fgcm")))
    rows = zp.join(ref, ["expnum", "ccdnum"]).join(positions, ["expnum", "ccdnum"])
    rows = rows.withColumn("_d", (F.col("zp_solved") - F.col("zp_fgcm")) * 1000.0).where(
        F.abs(F.col("_d")) < 200.0)
    n, ra0, dec0 = rows.agg(F.count(F.lit(1)), F.avg("ra_mean"), F.avg("dec_mean")).first()
    if n <= 100:
        return Gradient(n_stars=n, source="fgcm")
    fit = least_squares(rows, [F.col("ra_mean") - F.lit(ra0), F.col("dec_mean") - F.lit(dec0),
                               F.lit(1.0)], F.col("_d"))
    return Gradient(float(fit.coeffs[0]), float(fit.coeffs[1]), ra0, dec0, n, source="fgcm",
                    applied=True)


def polynomial_detrend(zp: DataFrame, positions: DataFrame, anchors: DataFrame, degree: int = 3):
    """Subtract a surface linear in RA and of ``degree`` in Dec fitted to the anchors.

    Three clip rounds at 3 sigma; the constant is kept for the final shift.  Returns the
    solution and the fit summary, or the input when fewer than 10 anchors qualify.
    """
    ref = anchors.where(P.valid_zp(F.col("zp_fgcm")))
    rows = (zp.where(F.col("zp_solved") > 1.0).join(ref, ["expnum", "ccdnum"])
            .join(positions, ["expnum", "ccdnum"])
            .withColumn("_d", F.col("zp_solved") - F.col("zp_fgcm")))
    n, ra0, dec0 = rows.agg(F.count(F.lit(1)), F.avg("ra_mean"), F.avg("dec_mean")).first()
    if n < 10:
        return zp, {"n_nodes_fit": 0}
    ra, dec = F.col("ra_mean") - F.lit(ra0), F.col("dec_mean") - F.lit(dec0)
    powers = [dec]
    for _ in range(degree - 1):
        powers.append(powers[-1] * dec)
    features = [F.lit(1.0), ra, *powers, ra * dec]
    fit, keep = clipped_fit(rows, features, F.col("_d"), rounds=3)
    surface = predict(features[1:], fit.coeffs[1:])
    out = (zp.join(positions, ["expnum", "ccdnum"], "left")
           .withColumn("zp_solved", F.col("zp_solved") - F.coalesce(surface, F.lit(0.0)))
           .drop("ra_mean", "dec_mean"))
    names = ["const", "ra", *[f"dec^{k}" for k in range(1, degree + 1)], "ra*dec"]
    before = rows.where(keep).agg(F.stddev_pop("_d")).first()[0]
    return shift_to_anchors(out, anchors)[0], {
        "poly_degree": degree, "n_nodes_fit": n, "n_nodes_clipped": n - fit.n,
        "coefficients_mmag": {k: float(c) * 1000.0 for k, c in zip(names, fit.coeffs)},
        "rms_before_mmag": before * 1000.0, "rms_after_mmag": fit.rms * 1000.0}
