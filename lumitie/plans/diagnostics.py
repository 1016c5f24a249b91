"""Diagnostic reports: gradients, exposure classes, seeing, graph reach, what-if solves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.functions import photometry as P
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.regress import clipped_fit, least_squares, line
from lumitie.operators.relational import remove_flagged
from lumitie.operators.robust import (attach_scalar, bin_index, binned_median, exact_mean, quantiles,
                                      scalar_median, scalar_quantiles)

# An edge and the width of the reports' bins, in degrees or arcsec; bins are open-ended.
RA_ONE_DEGREE = (49.0, 1.0)
RA_HALF_DEGREE = (49.0, 0.5)
FWHM_FINE = (0.5, 0.1)
DEC_HALF_DEGREE = (-35.0, 0.5)
RA_TWO_DEGREES = (50.0, 2.0)
# Exposure-time bin edges in seconds and RA-distance thresholds in degrees.
EXPTIME_EDGES = (30, 50, 80, 95, 120, 160, 190, 250, 350, 500)
REACH_DEGREES = (2.0, 5.0, 8.0)
# Prior strengths swept, and the offset added to zpterm as prior target.
PRIOR_STRENGTHS = (0, 1, 10, 100, 300, 1000, 3000, 10000, 30000, 100000)
PRIOR_OFFSET = 31.4389
# Seeing range, fit range, bin width and degree of the aperture correction.
FWHM_QUALITY = (0.5, 3.0)
FWHM_FIT = (0.8, 2.0)
FWHM_BIN = 0.05
APERTURE_DEGREE = 3


def exposure_positions(dets: DataFrame) -> DataFrame:
    """Median position per exposure, whose rows grow with stars per field."""
    dec = quantiles(dets, "dec", {"exp_dec": 0.5}, ["expnum"]).drop("n")
    return exposure_right_ascensions(dets).join(dec, "expnum")


def exposure_right_ascensions(dets: DataFrame) -> DataFrame:
    """Median right ascension per exposure alone, for reports that need no declination."""
    return quantiles(dets, "ra", {"exp_ra": 0.5}, ["expnum"]).drop("n")


def reference_differences(table: DataFrame, positions: DataFrame, exptime: DataFrame,
                          flagged_nodes: DataFrame | None = None) -> DataFrame:
    """Solved minus reference (mmag) of physical, unflagged reference nodes."""
    rows = table.where(P.valid_zp(F.col("zp_fgcm")) & P.valid_zp(F.col("zp_solved")))
    if flagged_nodes is not None:
        rows = rows.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    return (rows.join(positions, "expnum", "left").join(exptime, "expnum", "left")
            .withColumn("exptime", F.coalesce("exptime", F.lit(-1.0)))
            .withColumn("diff_mmag", (F.col("zp_solved") - F.col("zp_fgcm")) * 1000.0))


def gradient_by_depth(diffs: DataFrame) -> DataFrame:
    """Binned median difference along RA for all, 90 s and deep exposures."""
    tagged = diffs.select("exp_ra", "diff_mmag", F.explode(F.filter(F.array(
        F.lit("all"), F.when(F.col("exptime") == 90.0, "90s"),
        F.when(F.col("exptime") > 100.0, "deep")), lambda s: s.isNotNull())).alias("sample"))
    return binned_median(tagged, "exp_ra", "diff_mmag", *RA_ONE_DEGREE, least=11, keys=["sample"])


def difference_by_exptime(diffs: DataFrame) -> DataFrame:
    """Median difference per exposure-time bin with more than 10 nodes."""
    bucket = None
    for k, (lo, hi) in enumerate(zip(EXPTIME_EDGES, EXPTIME_EDGES[1:])):
        hit = (F.col("exptime") >= lo) & (F.col("exptime") < hi)
        bucket = F.when(hit, k) if bucket is None else bucket.when(hit, k)
    rows = diffs.withColumn("bin", bucket).where(F.col("bin").isNotNull())
    return quantiles(rows, "diff_mmag", {"median": 0.5}, ["bin"]).where(F.col("n") > 10)


def exposure_classes(exptime: DataFrame, positions: DataFrame) -> DataFrame:
    return exptime.join(positions, "expnum").withColumn("exp_class", P.exposure_class(F.col("exptime")))


def deep_fraction(classes: DataFrame) -> DataFrame:
    """Per RA bin: exposures, deep exposures and their fraction."""
    rows = classes.withColumn("bin", bin_index(F.col("exp_ra"), *RA_HALF_DEGREE)).where("bin IS NOT NULL")
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.col("exp_class") == "deep_>100s", 1)).alias("n_deep")).withColumn(
        "fraction", F.col("n_deep") / F.col("n_total"))


def deep_minus_normal(dets: DataFrame, exptime: DataFrame) -> DataFrame:
    """Stars seen in deep and in 90 s exposures with the difference of their means."""
    rows = dets.join(exptime, "expnum")
    deep, norm = F.col("exptime") > 100.0, F.col("exptime") == 90.0
    m = F.col("m_inst")
    out = rows.groupBy("objectid").agg(
        F.avg(F.when(deep, m)).alias("m_deep"), F.count(F.when(deep, m)).alias("n_deep"),
        F.avg(F.when(norm, m)).alias("m_normal"), F.count(F.when(norm, m)).alias("n_normal"))
    return out.where((F.col("n_deep") > 0) & (F.col("n_normal") > 0)).withColumn(
        "dm", F.col("m_deep") - F.col("m_normal"))


def seeing_by_exposure(dets: DataFrame, exptime: DataFrame) -> DataFrame:
    """Median FWHM and RA per exposure with its depth class."""
    rows = dets.where(F.col("fwhm").isNotNull())
    f = quantiles(rows, "fwhm", {"fwhm_median": 0.5}, ["expnum"]).withColumnRenamed("n", "n_det")
    ra = quantiles(rows, "ra", {"ra_median": 0.5}, ["expnum"]).drop("n")
    return (f.join(ra, "expnum").join(exptime, "expnum", "left")
            .withColumn("exptime", F.coalesce("exptime", F.lit(-1.0)))
            .withColumn("exp_class", P.depth_class(F.col("exptime"))))


def seeing_residuals(dets: DataFrame, least: int = 3) -> DataFrame:
    """Deviation from the star's plain mean, for stars with enough detections."""
    star = Window.partitionBy("objectid")
    rows = dets.where(F.col("fwhm").isNotNull())
    return (rows.withColumn("_n", F.count(F.lit(1)).over(star))
            .withColumn("resid", F.col("m_inst") - F.avg("m_inst").over(star))
            .where(F.col("_n") >= least).drop("_n"))


def program_breakdown(dets: DataFrame, exposure: DataFrame, exptime: DataFrame) -> DataFrame:
    """Exposures and detections per observing program."""
    exps = dets.groupBy("expnum").agg(F.count(F.lit(1)).alias("n_det"))
    rows = exps.join(exposure.select("expnum", "instrument"), "expnum", "left").join(
        exptime, "expnum", "left")
    return rows.groupBy(P.program_class(F.col("instrument"), F.col("exptime")).alias("program")).agg(
        F.count(F.lit(1)).alias("n_exposures"), F.sum("n_det").alias("n_detections"))


def graph_reach(pairs: DataFrame) -> DataFrame:
    """Exposure pairs and how many reach beyond 2, 5 and 8 degrees of RA."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), *[
        F.count(F.when(F.col("dra") > t, 1)).alias(f"n_beyond_{int(t)}deg") for t in REACH_DEGREES])


def gradient_table(table: DataFrame, zpterm: DataFrame, positions: DataFrame, offset: float) -> DataFrame:
    """Nodes with solved, reference and original zero-points and their differences."""
    node = ["expnum", "ccdnum"]
    rows = (table.where(P.valid_zp(F.col("zp_fgcm")) & F.col("zp_solved").between(P.ZP_LOW, P.ZP_HIGH))
            .join(zpterm, node).join(positions, node))
    before = F.col("zpterm") + F.lit(offset)
    return rows.select(*node, F.col("ra_mean").alias("ra"), F.col("dec_mean").alias("dec"),
                       ((F.col("zp_solved") - F.col("zp_fgcm")) * 1000.0).alias("solved_minus_fgcm_mmag"),
                       ((before - F.col("zp_fgcm")) * 1000.0).alias("before_minus_fgcm_mmag"),
                       ((F.col("zp_solved") - before) * 1000.0).alias("solved_minus_before_mmag"),
                       ((F.col("zp_fgcm") - F.col("zpterm")) * 1000.0).alias("fgcm_minus_zpterm_mmag"))


GRADIENT_QUANTITIES = ("solved_minus_fgcm_mmag", "before_minus_fgcm_mmag",
                       "solved_minus_before_mmag", "fgcm_minus_zpterm_mmag")


def gradient_summary(rows: DataFrame, quantities=GRADIENT_QUANTITIES) -> DataFrame:
    """Slope along RA, intercept, correlation with its p-value and total change per quantity."""
    long = rows.select("ra", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quantity"), F.col(q).alias("value")) for q in quantities])).alias("e"))
    long = long.select("ra", "e.quantity", "e.value")
    fits = line(long, "ra", "value", ["quantity"])
    span = long.groupBy("quantity").agg((F.max("ra") - F.min("ra")).alias("_span"))
    return fits.join(span, "quantity").select(
        "quantity", "n", "slope", "intercept", "r", "p", (F.col("slope") * F.col("_span")).alias("total"))


def per_exposure_gradients(rows: DataFrame) -> DataFrame:
    """Exposure means of position and medians of the differences (bounded by the camera)."""
    return rows.groupBy("expnum").agg(
        F.avg("ra").alias("ra"), F.avg("dec").alias("dec"),
        *[F.median(q).alias(q) for q in GRADIENT_QUANTITIES[:3]])


def node_medians(dets: DataFrame) -> DataFrame:
    """Mean over pixels of the median position of each node."""
    per = ["healpix_pixel", "expnum", "ccdnum"]
    ra = quantiles(dets, "ra", {"ra": 0.5}, per).drop("n")
    dec = quantiles(dets, "dec", {"dec": 0.5}, per).drop("n")
    return ra.join(dec, per).groupBy("expnum", "ccdnum").agg(
        exact_mean("ra").alias("ra_median"), exact_mean("dec").alias("dec_median"))


def dec_step(table: DataFrame, medians: DataFrame, at: float = -30.0, window: float = 2.0) -> DataFrame:
    """Lines fitted on both sides of a declination and their gap at it."""
    rows = (table.where(P.valid_zp(F.col("zp_fgcm"))).join(medians, ["expnum", "ccdnum"])
            .withColumn("diff", F.col("delta_zp") * 1000.0)
            .where((F.col("dec_median") > at - window) & (F.col("dec_median") < at + window)))

    def side(cond, tag):
        x, y = F.when(cond, F.col("dec_median")), F.when(cond, F.col("diff"))
        return [F.count(x).alias(f"n_{tag}"), F.regr_slope(y, x).alias(f"slope_{tag}"),
                F.regr_intercept(y, x).alias(f"intercept_{tag}"), F.corr(x, y).alias(f"r_{tag}")]

    one = rows.agg(*side(F.col("dec_median") > at, "north"), *side(F.col("dec_median") < at, "south"))
    edge = lambda t: F.col(f"slope_{t}") * at + F.col(f"intercept_{t}")
    enough = (F.col("n_north") > 10) & (F.col("n_south") > 10)
    return one.withColumn("discontinuity_mmag", F.when(enough, edge("south") - edge("north")))


def binned_along(table: DataFrame, medians: DataFrame, x: str, grid, split: bool = False) -> DataFrame:
    """Binned median differences along declination, or along RA on both sides of -30."""
    rows = table.where(P.valid_zp(F.col("zp_fgcm"))).join(medians, ["expnum", "ccdnum"]).withColumn(
        "diff", F.col("delta_zp") * 1000.0)
    if not split:
        return binned_median(rows, x, "diff", *grid, least=11)
    side = F.when(F.col("dec_median") > -30.0, "north").when(F.col("dec_median") < -30.0, "south")
    rows = rows.withColumn("side", side).where(F.col("side").isNotNull())
    return binned_median(rows, x, "diff", *grid, least=11, keys=["side"])


def ra_gradient(table: DataFrame, positions: DataFrame, flagged_nodes: DataFrame | None = None):
    """Clipped slope of the differences along RA (mmag/deg) and scatter about it (mmag)."""
    rows = table.where(P.valid_zp(F.col("zp_fgcm"))).join(positions, ["expnum", "ccdnum"])
    if flagged_nodes is not None:
        rows = rows.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    rows = rows.withColumn("_d", F.col("zp_solved") - F.col("zp_fgcm"))
    n, center = rows.agg(F.count(F.lit(1)), F.avg("ra_mean")).first()
    if n < 10:
        return None, None
    fit, _ = clipped_fit(rows, [F.col("ra_mean") - F.lit(center), F.lit(1.0)], F.col("_d"), rounds=3)
    return float(fit.coeffs[0]) * 1000.0, fit.rms * 1000.0


def reference_rms(table: DataFrame, flagged_nodes: DataFrame | None = None) -> DataFrame:
    """RMS (mmag) of solved minus reference over unflagged valid nodes."""
    rows = table.where(P.valid_zp(F.col("zp_fgcm")))
    if flagged_nodes is not None:
        rows = rows.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    d = F.col("zp_solved") - F.col("zp_fgcm")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sqrt(F.avg(d * d)) * 1000.0).alias("rms_mmag"))


def scatter_floor(star_lists: DataFrame, zp: DataFrame) -> DataFrame:
    """Sample std and mean of the calibrated magnitudes of stars with three rows."""
    cal = star_lists.join(zp.select("expnum", "ccdnum", "zp_solved"), ["expnum", "ccdnum"])
    m = F.col("m_inst") + F.col("zp_solved")
    out = cal.groupBy("healpix_pixel", "objectid").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(m).alias("scatter"), F.avg(m).alias("mag"))
    return out.where(F.col("n") >= 3)


def repeatability_floor(star_lists: DataFrame, zp: DataFrame):
    """Smallest binned median scatter (mag) over half-magnitude bins with more than 20 stars."""
    stars = scatter_floor(star_lists, zp)
    cut = scalar_quantiles(stars, "mag", {"lo": 0.02, "hi": 0.98})
    if cut["n"] < 100:
        return None
    n_bins = int(np.ceil((cut["hi"] - cut["lo"]) / 0.5))
    if n_bins:
        bins = binned_median(stars.where(F.col("mag") <= cut["hi"]), "mag", "scatter", cut["lo"], 0.5, n_bins, least=21)
        low = bins.agg(F.min("median")).first()[0]
        if low is not None:
            return low
    return scalar_median(stars, "scatter")


def prior_sweep(star_lists: DataFrame, nodes: DataFrame, anchors: DataFrame, zpterm: DataFrame,
                positions: DataFrame, cfg, stage, flagged_nodes=None, flagged_stars=None,
                flagged_exposures=None, strengths=PRIOR_STRENGTHS) -> DataFrame:
    """Solve under ever stronger zpterm priors, in one recurrence, and report gradient, RMS and floor."""
    clean = stage.write(remove_flagged(star_lists, flagged_stars, None, flagged_exposures,
                                       flagged_nodes, least=1), "prior-lists")
    system = N.accumulate(clean, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star)
    out = []
    solved = V.solve_with_priors(system, nodes, anchors, zpterm, strengths, PRIOR_OFFSET, None, cfg, stage, flagged_nodes)
    for lam, (zp, info) in solved.items():
        table = stage.write(V.zeropoint_table(zp, anchors, "g"), "prior-table")
        slope, scatter = ra_gradient(table, positions, flagged_nodes)
        rms = reference_rms(table, flagged_nodes).first()["rms_mmag"]
        floor = repeatability_floor(clean, table)
        out.append((float(lam), slope, scatter, rms, None if floor is None else floor * 1000.0,
                    info.iterations, info.converged))
    return star_lists.sparkSession.createDataFrame(
        out, "strength double, ra_gradient double, ra_scatter double, des_rms double, "
             "repeatability double, iterations int, converged boolean")


def usable_seeing(dets: DataFrame) -> DataFrame:
    """Detections with a FWHM inside the quality range (both ends excluded)."""
    lo, hi = FWHM_QUALITY
    return dets.where((F.col("fwhm") > lo) & (F.col("fwhm") < hi))


def seeing_bins(dets: DataFrame) -> DataFrame:
    """Median weighted-mean residual per FWHM bin with at least 50 rows."""
    star = Window.partitionBy("objectid")
    w = P.weight(F.col("m_err"))
    rows = usable_seeing(dets)
    mean = F.sum(w * F.col("m_inst")).over(star) / F.sum(w).over(star)
    rows = (rows.withColumn("_n", F.count(F.lit(1)).over(star))
            .withColumn("residual", F.col("m_inst") - mean).where(F.col("_n") >= 2))
    lo, hi = FWHM_FIT
    n_bins = int(round((hi - lo) / FWHM_BIN))
    b = bin_index(F.col("fwhm"), lo, FWHM_BIN, n_bins)
    binned = rows.withColumn("bin", b).where(F.col("bin").isNotNull())
    med = quantiles(binned, "residual", {"median": 0.5}, ["bin"], few=True).where(F.col("n") >= 50)
    err = binned.groupBy("bin").agg(F.stddev_pop("residual").alias("_s"))
    return med.join(err, "bin").select(
        "bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(FWHM_BIN)).alias("center"), "n", "median",
        (F.col("_s") / F.sqrt("n")).alias("std_err"))


def aperture_correction(bins: DataFrame, degree: int = APERTURE_DEGREE):
    """Weighted polynomial through the binned medians, highest power first.

    The table has one row per FWHM bin, so only its sums matter and they are exact.
    """
    rows = bins.where(F.col("std_err") > 0)
    scale = F.lit(1.0) / F.col("std_err")
    mid = sum(FWHM_FIT) / 2.0
    powers = [F.pow(F.col("center") - F.lit(mid), F.lit(float(k))) * scale for k in range(degree, -1, -1)]
    fit = least_squares(rows, powers, F.col("median") * scale)
    return np.poly1d(fit.coeffs)(np.poly1d([1.0, -mid])).coeffs


def corrected_magnitudes(dets: DataFrame, coeffs) -> DataFrame:
    """Detections with the seeing-dependent aperture loss removed."""
    rows = usable_seeing(dets)
    ac = P.polynomial(F.col("fwhm"), coeffs)
    return rows.withColumn("ac", ac).withColumn("m_inst_corr", F.col("m_inst") - F.col("ac"))


def correction_by_node(corrected: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean correction and median FWHM per node with its RA.

    A node's rows are the stars in the field of one detector, a bounded group, so they meet once in a task.
    """
    rows = corrected.select("expnum", "ccdnum", "fwhm", "ac").repartition("expnum", "ccdnum")
    nodes = rows.groupBy("expnum", "ccdnum").agg(F.avg("ac").alias("mean_ac"), F.count(F.lit(1)).alias("n_det"), F.median("fwhm").alias("median_fwhm"))
    return nodes.join(positions.select("expnum", "ccdnum", F.col("ra_mean").alias("ra")), ["expnum", "ccdnum"])


def flat_closure(star_lists: DataFrame, nodes: DataFrame, anchors: DataFrame, positions: DataFrame,
                 cfg, stage, zp_true: float = 31.4, seed: int = 42) -> dict:
    """Solve magnitudes that carry no zero-point differences; any gradient is the solver's.

    Star medians plus seeded noise replace the measurements on the real graph.
    """
    star = Window.partitionBy("healpix_pixel", "objectid")
    # Twelve uniform numbers from the row's key sum to nearly normal noise, the same in every attempt.
    draws = [F.pmod(F.xxhash64("objectid", "expnum", "ccdnum", F.lit(seed + k)), F.lit(1 << 20)) / F.lit(float(1 << 20)) for k in range(12)]
    noise = (sum(draws[1:], draws[0]) - F.lit(6.0)) * F.col("m_err")
    flat = stage.write(star_lists.withColumn("m_inst", F.median("m_inst").over(star) + noise), "flat-lists")
    system = N.accumulate(flat, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star)
    ref = anchors.where(P.valid_zp(F.col("zp_fgcm"))).withColumn("zp_fgcm", F.lit(zp_true))
    zp, info = V.solve_unanchored(system, nodes, ref, cfg, stage)
    rows = stage.write(zp.join(positions, ["expnum", "ccdnum"]).withColumn(
        "err", (F.col("zp_solved") - F.lit(zp_true)) * 1000.0), "flat-err")
    ra0, dec0 = rows.agg(F.avg("ra_mean"), F.avg("dec_mean")).first()
    fit = least_squares(rows, [F.lit(1.0), F.col("ra_mean") - F.lit(ra0), F.col("dec_mean") - F.lit(dec0)],
                        F.col("err"))
    rms = rows.agg(F.stddev_pop("err")).first()[0]
    worst = max(abs(fit.coeffs[1]), abs(fit.coeffs[2]))
    verdict = "clean" if worst < 1.0 else ("significant" if worst > 10.0 else "moderate")
    return {"ra_slope": float(fit.coeffs[1]), "dec_slope": float(fit.coeffs[2]), "rms_mmag": rms,
            "iterations": info.iterations, "verdict": verdict}


def star_level_reference(dets: DataFrame, table: DataFrame, flagged_nodes: DataFrame | None = None):
    """Mean-subtracted solved-minus-reference difference (mmag) and position per star."""
    rows = dets.join(table.where(P.valid_zp(F.col("zp_fgcm")) & P.valid_zp(F.col("zp_solved")))
                     .select("expnum", "ccdnum", "zp_solved", "zp_fgcm"), ["expnum", "ccdnum"])
    if flagged_nodes is not None:
        rows = rows.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    w = P.weight(F.col("m_err"), P.SOFT_FLOOR)
    diff = F.sum(w * (F.col("zp_solved") - F.col("zp_fgcm"))) / F.sum(w) * 1000.0
    stars = rows.groupBy("objectid").agg(F.avg("ra").alias("ra"), F.avg("dec").alias("dec"),
                                         diff.alias("_d"), F.count(F.lit(1)).alias("n"))
    stars = stars.where(F.col("n") >= 2)
    return attach_scalar(stars, stars.agg(F.avg("_d").alias("_mean"))).select(
        "objectid", "ra", "dec", "n", (F.col("_d") - F.col("_mean")).alias("diff_mmag"))


def sample_rows(df: DataFrame, n: int, keys, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a congruence of their integer keys, which a retried task gives again.

    The limit merges per-task samples; ties go by all columns.
    """
    mixed = F.lit(seed).cast("long")
    for k in keys:
        mixed = F.pmod(mixed * F.lit(69069) + F.col(k).cast("long") * F.lit(7919), F.lit(1_000_003))
    return df.orderBy(F.pmod(mixed * F.lit(7907) + F.lit(13), F.lit(1_000_003)), *df.columns).limit(n)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency of each value, most frequent first, smallest value on ties."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out
