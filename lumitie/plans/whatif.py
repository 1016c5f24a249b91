"""What-if solves: the same survey without some exposures, or with corrected magnitudes.

Both start from stored stars, so a variant costs a filter or a linear combination of their arrays and a solve.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.functions import photometry as P
from lumitie.functions.epochs import epoch_index
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.relational import node_columns
from lumitie.operators.robust import bin_index, binned_median, quantiles, scalar_median
from lumitie.plans import diagnostics as D
from lumitie.plans.diagnostics import RA_ONE_DEGREE
from lumitie.plans.outliers import star_flat

# Exposures longer than this are deep (s), the boundary between the two epochs of the flat (MJD), the
# regularisation of both solves, and the least number of nodes of a reported bin.
DEEP_SECONDS = 100.0
FLAT_BOUNDARY = (56404.0,)
REGULARISATION = 1e-6
LEAST_NODES = 11
# RA range (deg), bin widths and least rows of the reports on the aperture correction.
AC_RA, AC_NODE_BIN, AC_FWHM_BIN = (48.0, 61.0), 1.0, 0.5
AC_FWHM_END, AC_LEAST_NODES, AC_LEAST_DETECTIONS = 61.5, 10, 50


def flat_and_gray(system: N.System, anchors: DataFrame, exposure_mjd: DataFrame, cfg, stage, bounds=FLAT_BOUNDARY):
    """Node solve, star flat, gray solve, shifted to the anchors: (expnum, ccdnum, zp), with both solves' outcomes.

    The flat of an exposure without MJD is that of the first epoch.
    """
    x, first = V._run(system, cfg, stage, tikhonov=REGULARISATION, mode="nodes")
    zp = stage.write(x.select(*node_columns("i"), F.col("x").alias("zp_solved")), "node-zp")
    flat = stage.write(star_flat(zp, exposure_mjd, bounds), "node-flat")
    gray, second = V._run(N.gray_system(system, flat, exposure_mjd, bounds, stage), cfg, stage, tikhonov=REGULARISATION, mode="gray")
    timed = zp.select("expnum", "ccdnum").join(exposure_mjd.select("expnum", "mjd"), "expnum", "left").withColumn(
        "epoch_idx", F.coalesce(epoch_index(F.col("mjd"), bounds), F.lit(0)))
    whole = (timed.join(gray.select(F.col("i").alias("expnum"), F.col("x").alias("gray")), "expnum")
             .join(flat, ["ccdnum", "epoch_idx"], "left")
             .select("expnum", "ccdnum", (F.col("gray") + F.coalesce("flat_correction", F.lit(0.0))).alias("zp")))
    whole = stage.write(whole, "flat-gray")
    tied = whole.join(anchors.where(P.valid_zp(F.col("zp_fgcm"))), ["expnum", "ccdnum"])
    shift = scalar_median(tied.select((F.col("zp_fgcm") - F.col("zp")).alias("s")), "s") or 0.0
    return whole.withColumn("zp", F.col("zp") + F.lit(shift)), (first, second)


def without_deep(system: N.System, table: DataFrame, exptime: DataFrame, anchors: DataFrame, exposure_mjd: DataFrame, positions: DataFrame,
                 cfg, stage, flagged_nodes: DataFrame | None = None) -> DataFrame:
    """Solve without deep exposures and flagged nodes; every reference node with both differences (mmag).

    ``table`` is the full solution with its reference; only nodes physical in reference and both solutions are compared.
    """
    node = system.unknowns.select("i", *node_columns("i"))
    keep = node.join(exptime.where(F.col("exptime") > DEEP_SECONDS).select("expnum").distinct(), "expnum", "left_anti")
    if flagged_nodes is not None:
        keep = keep.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    zp, _ = flat_and_gray(N.sub_system(system, keep, stage), anchors, exposure_mjd, cfg, stage)
    both = zp.join(table.select("expnum", "ccdnum", "zp_solved", "zp_fgcm"), ["expnum", "ccdnum"])
    fine = P.valid_zp(F.col("zp")) & P.valid_zp(F.col("zp_solved")) & P.valid_zp(F.col("zp_fgcm"))
    return stage.write(both.where(fine).join(positions.select("expnum", "exp_ra"), "expnum", "left").select(
        "expnum", "ccdnum", "exp_ra", ((F.col("zp") - F.col("zp_fgcm")) * 1000.0).alias("normal_mmag"),
        ((F.col("zp_solved") - F.col("zp_fgcm")) * 1000.0).alias("full_mmag"), ((F.col("zp") - F.col("zp_solved")) * 1000.0).alias("change_mmag")),
        "without-deep")


def by_right_ascension(compared: DataFrame, grid=RA_ONE_DEGREE) -> DataFrame:
    """Median of both differences and of their change per RA bin with enough nodes."""
    rows = compared.withColumn("bin", bin_index(F.col("exp_ra"), *grid)).where("bin is not null")
    out = None
    for name in ("normal_mmag", "full_mmag", "change_mmag"):
        one = quantiles(rows, name, {name: 0.5}, ["bin"])
        out = one if out is None else out.join(one.drop("n"), "bin")
    return out.where(F.col("n") >= LEAST_NODES)


def depth_verdict(compared: DataFrame, bins: DataFrame) -> DataFrame:
    """One row: nodes, scatter of both differences, ranges along RA, and whether deep exposures cause the gradient.

    ``cause`` is removed where the range falls below half of the full solve's, kept above four fifths, else reduced.
    """
    scatter = compared.agg(F.count(F.lit(1)).alias("n_nodes"), F.stddev_samp("normal_mmag").alias("rms_normal_mmag"),
                           F.stddev_samp("full_mmag").alias("rms_full_mmag"))
    span = lambda c: F.max(c) - F.min(c)
    ranges = bins.agg(F.count(F.lit(1)).alias("n_bins"), span("normal_mmag").alias("range_normal_mmag"), span("full_mmag").alias("range_full_mmag"))
    a, b = F.col("range_normal_mmag"), F.col("range_full_mmag")
    gradient = F.when(a < 0.5 * b, "removed").when(a > 0.8 * b, "kept").when(a.isNotNull(), "reduced")
    return scatter.join(F.broadcast(ranges)).withColumn("gradient", gradient)


def aperture_system(dets: DataFrame, nodes: DataFrame, cfg, stage, degree: int = D.APERTURE_DEGREE) -> N.System:
    """Constraints of the detections with usable seeing, with the powers u1, u2, ... of the seeing about the fit's middle."""
    mid = sum(D.FWHM_FIT) / 2.0
    rows = D.usable_seeing(dets)
    for k in range(1, degree + 1):
        rows = rows.withColumn(f"u{k}", F.pow(F.col("fwhm") - F.lit(mid), F.lit(float(k))))
    return N.accumulate(rows, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star, basis=tuple(f"u{k}" for k in range(1, degree + 1)))


def centred(coeffs) -> dict:
    """Coefficients of the powers u1, u2, ... from those of the seeing itself, highest first; a constant cancels in differences."""
    mid = sum(D.FWHM_FIT) / 2.0
    lowest_first = np.poly1d(coeffs)(np.poly1d([1.0, mid])).coeffs[::-1]
    return {f"u{k}": float(c) for k, c in enumerate(lowest_first) if k}


def aperture_what_if(system: N.System, coeffs, nodes: DataFrame, anchors: DataFrame, cfg, stage):
    """Solve with the measured and with the corrected magnitudes: rows (label, expnum, ccdnum, zp_solved) and both outcomes."""
    out, infos = None, {}
    for label, one in (("original", system), ("corrected", N.corrected(system, centred(coeffs)))):
        zp, infos[label] = V.solve_unanchored(one, nodes, anchors, cfg, stage)
        zp = zp.select(F.lit(label).alias("label"), "expnum", "ccdnum", "zp_solved")
        out = zp if out is None else out.unionByName(zp)
    return stage.write(out, "aperture-zp"), infos


def reference_rows(zp: DataFrame, anchors: DataFrame, positions: DataFrame, flagged_nodes: DataFrame | None = None) -> DataFrame:
    """label, ra_mean and difference (mag) of every unflagged reference node with a position."""
    rows = zp.join(anchors.where(P.valid_zp(F.col("zp_fgcm"))), ["expnum", "ccdnum"]).join(positions, ["expnum", "ccdnum"])
    if flagged_nodes is not None:
        rows = rows.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    return rows.select("label", "ra_mean", (F.col("zp_solved") - F.col("zp_fgcm")).alias("diff"))


def gradient_bins(rows: DataFrame) -> DataFrame:
    """Median difference (mmag) per label and degree of RA."""
    inside = rows.where((F.col("ra_mean") >= AC_RA[0]) & (F.col("ra_mean") < AC_RA[1]))
    return binned_median(inside, "ra_mean", "diff", AC_RA[0], AC_NODE_BIN, least=AC_LEAST_NODES, keys=["label"]).select(
        "label", "bin", "center", "n", (F.col("median") * 1000.0).alias("median_mmag"))


def gradient_table(rows: DataFrame) -> DataFrame:
    """Per label: nodes, bins, slope along RA of the binned medians, its total over the range, RMS (all mmag).

    With fewer than three bins the slope is 0.
    """
    bins = gradient_bins(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n_bins"), F.regr_slope("median_mmag", "center").alias("_s"))
    whole = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"), (F.sqrt(F.avg(F.col("diff") * F.col("diff"))) * 1000.0).alias("rms_mmag"),
                                      (F.max("ra_mean") - F.min("ra_mean")).alias("_range"))
    slope = F.when(F.col("n_bins") >= 3, F.col("_s")).otherwise(F.lit(0.0))
    return (whole.join(bins, "label", "left").withColumn("n_bins", F.coalesce("n_bins", F.lit(0).cast("long")))
            .withColumn("slope_mmag_per_deg", slope).withColumn("total_mmag", F.col("slope_mmag_per_deg") * F.col("_range")).drop("_s", "_range"))


def seeing_by_right_ascension(dets: DataFrame) -> DataFrame:
    """Median FWHM per half degree of RA."""
    rows = D.usable_seeing(dets).where((F.col("ra") >= AC_RA[0]) & (F.col("ra") < AC_FWHM_END))
    return binned_median(rows, "ra", "fwhm", AC_RA[0], AC_FWHM_BIN, least=AC_LEAST_DETECTIONS).select("bin", "center", "n", "median", "std_err")


def correction_by_right_ascension(by_node: DataFrame) -> DataFrame:
    """Medians over nodes of mean correction (mmag) and median FWHM per degree of RA."""
    rows = by_node.where((F.col("ra") >= AC_RA[0]) & (F.col("ra") < AC_RA[1]))
    both = [binned_median(rows, "ra", c, AC_RA[0], AC_NODE_BIN, least=AC_LEAST_NODES + 1) for c in ("mean_ac", "median_fwhm")]
    return both[0].select("bin", "center", "n", (F.col("median") * 1000.0).alias("mean_ac_mmag")).join(
        both[1].select("bin", F.col("median").alias("median_fwhm")), "bin")
