"""Phase 6: checks of the solution and the catalog against references.

Every check returns one row: test, status, passed and its metrics.  A check without
enough input reports SKIP with passed NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.functions import photometry as P
from lumitie.operators.regress import colour_polynomial, colour_term, predict
from lumitie.operators.robust import attach_scalar, binned_median, quantiles, scalar_quantiles
from lumitie.plans.catalog import constant_flat
from lumitie.sources.stage import Stage

METRICS_DDL = "test string, metric string, value double"


def _rms(c):
    return F.sqrt(F.avg(c * c))


def _finish(row: DataFrame, test: str, passed, enough) -> DataFrame:
    """Prefix the metrics with test, status and verdict."""
    verdict = F.when(enough, passed)
    status = (F.when(~enough, "SKIP").when(verdict, "PASS").otherwise("FAIL"))
    return row.select(F.lit(test).alias("test"), status.alias("status"), verdict.alias("passed"), "*")


def star_level(dets: DataFrame, zp: DataFrame, anchors: DataFrame, zpterm: DataFrame, offset: float,
               cfg: Config, flat: DataFrame | None = None, exposure_mjd: DataFrame | None = None,
               flagged_stars: DataFrame | None = None) -> DataFrame:
    """Star magnitudes on the reference, solved, original and flat-only systems.

    Only detections on valid reference nodes count, and only stars with two of them.
    """
    node = ["expnum", "ccdnum"]
    rows = dets
    if flagged_stars is not None:
        rows = rows.join(flagged_stars.select("objectid"), "objectid", "left_anti")
    rows = (rows.join(anchors.where(P.valid_zp(F.col("zp_fgcm"))).select(*node, "zp_fgcm"), node)
            .join(zp.where(F.col("zp_solved") > 1.0).select(*node, "zp_solved"), node)
            .join(zpterm.select(*node, "zpterm"), node))
    if flat is not None and exposure_mjd is not None:
        rows = rows.drop("mjd").join(exposure_mjd.select("expnum", "mjd"), "expnum", "left")
    rows = constant_flat(rows, flat if exposure_mjd is not None else None, cfg)
    w = P.weight(F.col("m_err"))
    before = F.col("m_inst") + F.col("zpterm") + F.lit(offset)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    out = rows.groupBy("objectid").agg(
        mean(F.col("m_inst") + F.col("zp_fgcm")).alias("mag_fgcm"),
        mean(F.col("m_inst") + F.col("zp_solved")).alias("mag_solved"),
        mean(before).alias("mag_before"), mean(before + F.col("flat_const")).alias("mag_starflat"),
        F.count(F.lit(1)).alias("n_des"))
    return out.where(F.col("n_des") >= 2)


def fgcm_comparison(stars: DataFrame) -> DataFrame:
    """Scatter (mmag, mean removed) of each system against the reference."""
    def spread(c):
        return F.stddev_pop((F.col(c) - F.col("mag_fgcm")) * 1000.0)

    row = stars.agg(spread("mag_solved").alias("rms_solved_mmag"),
                    spread("mag_starflat").alias("rms_starflat_mmag"),
                    spread("mag_before").alias("rms_before_mmag"),
                    F.count(F.lit(1)).alias("n_stars"))
    row = row.withColumn("improvement_mmag", F.col("rms_before_mmag") - F.col("rms_solved_mmag"))
    return _finish(row, "Test 0: FGCM comparison",
                   F.col("rms_solved_mmag") < F.col("rms_before_mmag"), F.col("n_stars") >= 50)


def multi_epoch(catalog: DataFrame, band: str) -> DataFrame:
    mag = F.col(f"mag_cal_{band}")
    return catalog.where((F.col(f"nobs_{band}") >= 3) & P.is_finite(mag)).withColumn(
        "scatter_mmag", P.scatter_mmag(F.col(f"magerr_cal_{band}"), F.col(f"nobs_{band}")))


def repeatability(catalog: DataFrame, band: str) -> DataFrame:
    """Median scatter of the stars between the 20 % and 40 % magnitude quantiles."""
    mag = f"mag_cal_{band}"
    multi = multi_epoch(catalog, band)
    cuts = quantiles(multi, mag, {"q20": 0.2, "q40": 0.4}).drop("n")
    bright = attach_scalar(multi, cuts).where(
        (F.col(mag) >= F.col("q20")) & (F.col(mag) < F.col("q40")))
    floor = quantiles(bright, "scatter_mmag", {"floor_mmag": 0.5}).agg(
        F.max("floor_mmag").alias("floor_mmag"))
    row = attach_scalar(multi.agg(F.count(F.lit(1)).alias("n_stars")), floor)
    return _finish(row.select("floor_mmag", "n_stars"), "Test 1: Repeatability",
                   F.col("floor_mmag") < 10.0, F.col("n_stars") > 0)


def repeatability_bins(catalog: DataFrame, band: str) -> DataFrame:
    """Median scatter in 15 magnitude bins between the 5 % and 95 % quantiles."""
    mag = f"mag_cal_{band}"
    multi = multi_epoch(catalog, band)
    cut = scalar_quantiles(multi, mag, {"lo": 0.05, "hi": 0.95})
    if cut["lo"] is None or cut["hi"] <= cut["lo"]:
        return binned_median(multi.limit(0), mag, "scatter_mmag", 0.0, 1.0, 1, 6)
    return binned_median(multi.where(F.col(mag) <= cut["hi"]), mag, "scatter_mmag", cut["lo"], (cut["hi"] - cut["lo"]) / 15.0, 15, 6)


def valid_reference() -> object:
    return (F.col("zp_solved") > 1.0) & P.valid_zp(F.col("zp_fgcm"))


def anchored_difference(table: DataFrame) -> DataFrame:
    """RMS and median of the anchored solution against its reference."""
    d = table.where(valid_reference()).withColumn("_d", F.col("delta_zp") * 1000.0)
    med = quantiles(d, "_d", {"median_mmag": 0.5}).agg(F.max("median_mmag").alias("median_mmag"))
    row = attach_scalar(d.agg(_rms(F.col("_d")).alias("rms_mmag"), F.count(F.lit(1)).alias("n_nodes")), med)
    return _finish(row, "Test 2: DR2 comparison", F.col("rms_mmag") < 15.0, F.col("n_nodes") > 0)


def boundary(table: DataFrame, flagged_nodes: DataFrame | None = None,
             flagged_exposures: DataFrame | None = None) -> DataFrame:
    """Offset between the median zero-points inside and outside the reference survey."""
    if flagged_exposures is not None:
        table = table.join(flagged_exposures.select("expnum"), "expnum", "left_anti")
    if flagged_nodes is not None:
        table = table.join(flagged_nodes.select("expnum", "ccdnum"), ["expnum", "ccdnum"], "left_anti")
    inside = table.where(valid_reference())
    outside = table.where(F.col("zp_fgcm").isNull() & (F.col("zp_solved") > 1.0))
    a = quantiles(inside, "zp_solved", {"m": 0.5}).agg(
        F.max("m").alias("des_median"), F.coalesce(F.max("n"), F.lit(0)).alias("n_des"))
    b = quantiles(outside, "zp_solved", {"m": 0.5}).agg(
        F.max("m").alias("non_des_median"), F.coalesce(F.max("n"), F.lit(0)).alias("n_non_des"))
    row = attach_scalar(a, b).withColumn(
        "boundary_offset_mmag", F.abs(F.col("des_median") - F.col("non_des_median")) * 1000.0)
    return _finish(row, "Test 6: DES boundary", F.col("boundary_offset_mmag") < 10.0,
                   (F.col("n_des") > 0) & (F.col("n_non_des") > 0))


def _colour_result(rows: DataFrame, fit, keep, model, test: str, limit: float, has_before: bool,
                   names) -> DataFrame:
    """RMS before and after the colour term on the rows the fit kept."""
    spark = rows.sparkSession
    if fit is None:
        empty = spark.createDataFrame([(0,)], "n_stars bigint")
        return _finish(empty, test, F.lit(None).cast("boolean"), F.lit(False))
    common = rows.where(keep)
    if has_before:
        common = common.where(P.is_finite(F.col("delta_before")))
    aggs = [F.count(F.lit(1)).alias("n_common"), _rms(F.col("delta")).alias("rms_before_ct_mmag"),
            _rms(F.col("delta") - model).alias("rms_after_ct_mmag")]
    if has_before:
        aggs.append(_rms(F.col("delta_before") - model).alias("rms_before_solve_mmag"))
    row = common.agg(*aggs).withColumn("n_stars", F.lit(fit.n))
    for name, c in zip(names, fit.coeffs):
        row = row.withColumn(name, F.lit(float(c)))
    ok = F.col("rms_after_ct_mmag") < limit
    if has_before:
        ok = ok & (F.col("rms_after_ct_mmag") <= F.col("rms_before_solve_mmag"))
    return _finish(row, test, ok, F.col("n_stars") > 0)


def ls_comparison(catalog: DataFrame, ls: DataFrame, band: str, stage: Stage) -> DataFrame:
    """Linear colour term against Legacy Survey PSF magnitudes (g - i, else g - r)."""
    m = catalog.where((F.col(f"nobs_{band}") >= 3) & P.is_finite(F.col(f"mag_cal_{band}")))
    joined = m.select("objectid", f"mag_cal_{band}").join(
        ls.withColumnRenamed("nsc_objectid", "objectid").drop("ra", "dec"), "objectid")
    second = "mag_i" if "mag_i" in ls.columns else "mag_r"
    rows = joined.select(((F.col(f"mag_cal_{band}") - F.col(f"mag_{band}")) * 1000.0).alias("delta"),
                         (F.col("mag_g") - F.col(second)).alias("color"))
    return _linear(rows, "Test 3: LS DR10 comparison", 30.0, False, stage)


def _linear(rows: DataFrame, test: str, limit: float, has_before: bool, stage: Stage) -> DataFrame:
    rows = stage.write(rows, "colour-rows")
    n = rows.count()
    fit, keep = colour_term(rows, "color", "delta") if n >= 50 else (None, F.lit(True))
    model = predict([F.lit(1.0), F.col("color")], fit.coeffs) if fit else F.lit(0.0)
    return _colour_result(rows, fit, keep, model, test, limit, has_before,
                          ["color_term_offset", "color_term_slope"])


def good_colours(g_cat: DataFrame, r_cat: DataFrame) -> DataFrame:
    """(objectid, color_g_r) of stars with physical magnitudes in both bands."""
    both = g_cat.select("objectid", "mag_cal_g").join(r_cat.select("objectid", "mag_cal_r"), "objectid")
    gr = F.col("mag_cal_g") - F.col("mag_cal_r")
    ok = (gr > -0.5) & (gr < 2.5)
    for c in ("mag_cal_g", "mag_cal_r"):
        ok = ok & (F.col(c) > 15.0) & (F.col(c) < 22.0)
    return both.where(ok).select("objectid", gr.alias("color_g_r"))


def gaia_rows(catalog: DataFrame, gaia: DataFrame, band: str, colours: DataFrame | None,
              use_survey_colour: bool) -> DataFrame:
    """Dereddened differences (mmag) and colours of the stars matched to Gaia."""
    ref, system = (("phot_bp_mean_mag", "gaia_bp") if band == "g" else ("phot_rp_mean_mag", "gaia_rp"))
    mag = F.col(f"mag_cal_{band}")
    cat = catalog.where((F.col(f"nobs_{band}") >= 3) & (mag > 15.0) & (mag < 22.0))
    if colours is not None:
        cat = cat.join(colours, "objectid", "left")
    good = gaia.where((F.col(ref) > 10.0) & (F.col(ref) < 25.0)).select(
        F.col("nsc_objectid").alias("objectid"), F.col(ref).alias("_ref"), "bp_rp")
    joined = cat.join(good, "objectid")
    ebv = F.col("ebv_sfd")
    target = P.deredden(F.col("_ref"), system, ebv)
    shade = (P.deredden_colour(F.col("color_g_r"), "decam_g", "decam_r", ebv) if use_survey_colour
             else P.deredden_colour(F.col("bp_rp"), "gaia_bp", "gaia_rp", ebv))
    diff = lambda c: (P.deredden(F.col(c), f"decam_{band}", ebv) - target) * 1000.0
    return joined.select("objectid", "ra", "dec", diff(f"mag_cal_{band}").alias("delta"),
                         diff(f"mag_before_{band}").alias("delta_before"), shade.alias("color"))


def gaia_comparison(catalog: DataFrame, gaia: DataFrame, band: str, stage: Stage,
                    colours: DataFrame | None = None, degree: int = 5, least_colours: int = 1000) -> DataFrame:
    """Degree-5 colour term against Gaia, before and after, on the same stars.

    The survey's own g - r is the colour when more than ``least_colours`` stars have it, else
    BP - RP; ``survey_colour`` in the result says which (1 or 0).
    """
    own = False
    if colours is not None:
        colours = stage.write(colours, "colours")
        mag = F.col(f"mag_cal_{band}")
        seen = catalog.where((F.col(f"nobs_{band}") >= 3) & (mag > 15.0) & (mag < 22.0)).join(colours, "objectid", "left_semi").count()
        own = seen > least_colours
    rows = stage.write(gaia_rows(catalog, gaia, band, colours, own), "gaia-rows")
    n = rows.count()
    fit, keep = (colour_polynomial(rows, "color", "delta", degree) if n >= 50
                 else (None, F.lit(True)))
    model = P.polynomial(F.col("color"), fit.coeffs) if fit else F.lit(0.0)
    names = [f"color_term_c{k}" for k in range(degree, -1, -1)]
    out = _colour_result(rows, fit, keep, model, "Test 4: Gaia comparison", 50.0, True, names)
    return out.withColumn("survey_colour", F.lit(int(own)))


def ps1_rows(catalog: DataFrame, ps1: DataFrame, band: str) -> DataFrame:
    """Dereddened differences to PS1 with its g - i colour, sentinels removed."""
    mag = F.col(f"mag_cal_{band}")
    cat = catalog.where((F.col(f"nobs_{band}") >= 3) & (mag > 15.0) & (mag < 22.0))
    joined = cat.join(ps1, "objectid")
    ref, g, i = F.col(f"ps1_{band}MeanPSFMag"), F.col("ps1_gMeanPSFMag"), F.col("ps1_iMeanPSFMag")
    for c in (ref, g, i):
        joined = joined.where((c > 10.0) & (c < 25.0))
    ebv = F.col("ebv_sfd")
    target = P.deredden(ref, f"ps1_{band}", ebv)
    diff = lambda c: (P.deredden(F.col(c), f"decam_{band}", ebv) - target) * 1000.0
    return joined.select("objectid", diff(f"mag_cal_{band}").alias("delta"),
                         diff(f"mag_before_{band}").alias("delta_before"),
                         P.deredden_colour(g - i, "ps1_g", "ps1_i", ebv).alias("color"))


def ps1_comparison(catalog: DataFrame, ps1: DataFrame, band: str, stage: Stage) -> DataFrame:
    return _linear(ps1_rows(catalog, ps1, band), "Test 7: PS1 DR2 comparison", 30.0, True, stage)


def stellar_locus(spark) -> DataFrame:
    """Placeholder check: needs three bands and always reports SKIP."""
    row = spark.range(1).select(F.lit(0).cast("bigint").alias("n_stars"))
    return _finish(row, "Test 5: Stellar locus", F.lit(None).cast("boolean"), F.lit(False))


def melt(row: DataFrame) -> DataFrame:
    """(test, status, metric, value) rows of a check."""
    names = [c for c in row.columns if c not in ("test", "status", "passed")]
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                        for c in names])
    return row.select("test", "status", F.explode(entries).alias("e")).select("test", "status", "e.*")


def tally(checks) -> DataFrame:
    """Counts of PASS, FAIL and SKIP over a list of checks."""
    out = None
    for c in checks:
        one = c.select("test", "status")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
