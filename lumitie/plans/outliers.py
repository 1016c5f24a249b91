"""Phase 3: residuals, flags and the rejection loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.functions import photometry as P
from lumitie.functions.epochs import epoch_index, night
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.relational import remove_flagged
from lumitie.operators.robust import quantiles
from lumitie.sources.stage import Stage


def residuals(dets: DataFrame, zp: DataFrame) -> DataFrame:
    """Calibrated magnitude, weighted star mean, residual and count per detection.

    ``zp`` (expnum, ccdnum, zp_solved) also selects the connected nodes.  The mean runs
    over a star's rows in all pixels, a bounded group after the detection cap.
    """
    cal = dets.join(zp.select("expnum", "ccdnum", "zp_solved"), ["expnum", "ccdnum"])
    cal = cal.withColumn("m_cal", F.col("m_inst") + F.col("zp_solved"))
    star = Window.partitionBy("objectid")
    w = P.weight(F.col("m_err"))
    mean = F.sum(w * F.col("m_cal")).over(star) / F.sum(w).over(star)
    return (cal.withColumn("m_star_mean", mean)
            .withColumn("n_det", F.count(F.lit(1)).over(star))
            .withColumn("residual", F.col("m_cal") - F.col("m_star_mean")))


def is_outlier(sigma_cut: float):
    return F.abs(F.col("residual")) > F.lit(sigma_cut) * F.col("m_err")


def variable_stars(resid: DataFrame, chi2_cut: float) -> DataFrame:
    """Stars whose chi-square per degree of freedom exceeds the cut."""
    stars = resid.groupBy("objectid").agg(
        F.sum(F.pow(F.col("residual") / F.col("m_err"), 2)).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("dof"))
    return (stars.where(F.col("dof") >= 1).withColumn("chi2_dof", F.col("chi2") / F.col("dof"))
            .where(F.col("chi2_dof") > chi2_cut))


def unusable_stars(resid: DataFrame, chi2_cut: float, sigma_cut: float) -> DataFrame:
    """Variable stars that keep fewer than two clean detections."""
    stars = resid.groupBy("objectid").agg(
        F.sum(F.pow(F.col("residual") / F.col("m_err"), 2)).alias("chi2"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_outlier(sigma_cut), 1)).alias("n_bad"))
    return stars.where((F.col("n") >= 2) & (F.col("chi2") / (F.col("n") - 1) > chi2_cut)
                       & (F.col("n") - F.col("n_bad") < 2)).select("objectid")


def bad_exposures(zp: DataFrame, exposure_mjd: DataFrame, zp_cut: float) -> DataFrame:
    """Exposures whose median zero-point strays from the night's median.

    Both medians run over bounded groups: a camera's detectors, a night's exposures.
    """
    exps = zp.groupBy("expnum").agg(F.median("zp_solved").alias("zp_exp_median"))
    timed = exps.join(exposure_mjd.select("expnum", "mjd"), "expnum").where(F.col("mjd").isNotNull())
    timed = timed.withColumn("night", night(F.col("mjd")))
    nightly = F.median("zp_exp_median").over(Window.partitionBy("night"))
    return (timed.withColumn("zp_deviation", F.abs(F.col("zp_exp_median") - nightly))
            .where(F.col("zp_deviation") > zp_cut))


def ccd_scatter(resid: DataFrame) -> DataFrame:
    """Sample standard deviation and count per node with at least three rows."""
    stats = resid.groupBy("expnum", "ccdnum").agg(
        F.stddev_samp("residual").alias("scatter"), F.count("residual").alias("n"))
    return stats.where(F.col("n") >= 3)


def bad_ccds(resid: DataFrame, sigma_factor: float = 3.0, min_scatter_mag: float = 0.05):
    """Nodes whose scatter exceeds max(median + k * robust sigma, floor)."""
    from lumitie.operators.robust import attach_scalar

    stats = ccd_scatter(resid)
    center = quantiles(stats, "scatter", {"median": 0.5}).select("median")
    dev = attach_scalar(stats, center).withColumn("_d", F.abs(F.col("scatter") - F.col("median")))
    mad = quantiles(dev, "_d", {"mad": 0.5}).select("mad")
    spread = dev.agg(F.stddev_samp("scatter").alias("_s"), F.first("median").alias("median"))
    limits = attach_scalar(mad, spread)
    sigma = F.when(F.col("mad") > 0, F.lit(1.4826) * F.col("mad")).otherwise(F.col("_s"))
    limits = limits.select(F.greatest(F.col("median") + F.lit(sigma_factor) * sigma,
                                      F.lit(min_scatter_mag)).alias("threshold"))
    return attach_scalar(stats, limits).where(F.col("scatter") > F.col("threshold"))


def star_flat(zp: DataFrame, exposure_mjd: DataFrame, bounds, flagged_nodes: DataFrame | None = None,
              flagged_exposures: DataFrame | None = None) -> DataFrame:
    """Median of (zero-point - exposure median) per detector and epoch, 0 below 3 values."""
    if flagged_nodes is not None:
        zp = zp.join(flagged_nodes, ["expnum", "ccdnum"], "left_anti")
    if flagged_exposures is not None:
        zp = zp.join(flagged_exposures, "expnum", "left_anti")
    gray = F.median("zp_solved").over(Window.partitionBy("expnum"))
    delta = zp.select("expnum", "ccdnum", (F.col("zp_solved") - gray).alias("delta"))
    timed = (delta.join(exposure_mjd.select("expnum", "mjd"), "expnum")
             .withColumn("epoch_idx", epoch_index(F.col("mjd"), bounds)))
    # A detector-epoch holds a fixed share of all nodes, so its median is the scalable one.
    med = quantiles(timed, "delta", {"m": 0.5}, ["ccdnum", "epoch_idx"])
    return med.select("ccdnum", "epoch_idx",
                      F.when(F.col("n") >= 3, F.col("m")).otherwise(0.0).alias("flat_correction"))


@dataclass
class Rejection:
    """State of the loop: star lists left, the solution, and all flags."""

    star_lists: DataFrame
    zp: DataFrame
    flagged_stars: DataFrame
    flagged_exposures: DataFrame
    flagged_nodes: DataFrame
    flagged_detections: DataFrame
    stats: list = field(default_factory=list)
    system: N.System | None = None
    table: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    flat: DataFrame | None = None
    gray: DataFrame | None = None


def _rms(resid: DataFrame):
    return F.sqrt(F.avg(F.col("residual") * F.col("residual"))) * 1000.0


def reject(star_lists: DataFrame, nodes: DataFrame, anchors: DataFrame, exposure_mjd: DataFrame,
           cfg: Config, stage: Stage, zp: DataFrame | None = None) -> Rejection:
    """Flag, clean, re-solve (anchored) until nothing new is flagged.

    Flags are staged tables; the star lists of a round are staged once and feed the
    normal equations, the residuals after the solve and the next round.
    """
    cut = cfg.outlier_rejection
    spark = star_lists.sparkSession
    star_type = star_lists.schema["objectid"].dataType.simpleString()
    empty = lambda ddl: spark.createDataFrame([], ddl)
    if zp is None:
        system = N.accumulate(star_lists, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star)
        zp, _ = V.solve_anchored(system, nodes, anchors, cfg, stage)
    zp = stage.write(zp, "zp")
    out = Rejection(star_lists, zp, empty(f"objectid {star_type}"), empty("expnum bigint"),
                    empty("expnum bigint, ccdnum int"),
                    empty(f"objectid {star_type}, expnum bigint, ccdnum int"))

    for iteration in range(1, cut.n_iterations + 1):
        flagged = residuals(out.star_lists, out.zp).withColumn("_out", is_outlier(cut.detection_sigma_cut))
        resid, seen = stage.write(flagged, "resid", {
            "n": F.count(F.lit(1)), "rms": _rms(flagged), "bad": F.count(F.when(F.col("_out"), 1))})
        if not seen["n"]:
            break
        # A key flagged on any of its rows removes all rows of that key.
        new_dets = resid.where("_out").select("objectid", "expnum", "ccdnum").distinct()
        dets = stage.write(out.flagged_detections.unionByName(new_dets).distinct(), "flag-det")
        new_stars, s = stage.write(
            unusable_stars(resid, cut.star_chi2_cut, cut.detection_sigma_cut)
            .join(out.flagged_stars, "objectid", "left_anti"), "flag-star", {"n": F.count(F.lit(1))})
        new_exps, e = stage.write(
            bad_exposures(out.zp, exposure_mjd, cut.exposure_zp_cut).select("expnum")
            .join(out.flagged_exposures, "expnum", "left_anti"), "flag-exp", {"n": F.count(F.lit(1))})
        new_nodes, m = stage.write(
            bad_ccds(resid).select("expnum", "ccdnum")
            .join(out.flagged_nodes, ["expnum", "ccdnum"], "left_anti"), "flag-node",
            {"n": F.count(F.lit(1))})
        new = s["n"] + e["n"] + m["n"]
        if not new and not seen["bad"] and out.system is not None and out.stats[-1].converged:
            # No row goes, so system, solution and residuals stay as they are.
            stage.drop(resid)
            out.stats.append(Row(**{**out.stats[-1].asDict(), "iteration": iteration, "n_stars_flagged": 0, "n_exposures_flagged": 0, "n_nodes_flagged": 0,
                                    "n_outlier_dets": 0, "rms_before_mmag": seen["rms"], "rms_after_mmag": seen["rms"]}))
            break
        before = out.flagged_detections, out.star_lists, out.zp
        out.flagged_detections = dets
        out.flagged_stars = out.flagged_stars.unionByName(new_stars)
        out.flagged_exposures = out.flagged_exposures.unionByName(new_exps)
        out.flagged_nodes = out.flagged_nodes.unionByName(new_nodes)

        out.star_lists = stage.write(
            remove_flagged(out.star_lists, out.flagged_stars, out.flagged_detections,
                           out.flagged_exposures, out.flagged_nodes), "star-lists")
        out.system = N.accumulate(out.star_lists, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star)
        zp, info = V.solve_anchored(out.system, nodes, anchors, cfg, stage, out.zp)
        out.zp = stage.write(zp, "zp")
        after = residuals(out.star_lists, out.zp).agg(_rms(None).alias("rms")).first()["rms"]
        stage.drop(resid)
        for old in before:  # those of this loop; the caller's tables are not staged under it
            if iteration > 1 or old is before[2]:
                stage.drop(old)
        out.stats.append(Row(
            iteration=iteration, n_stars_flagged=s["n"], n_exposures_flagged=e["n"],
            n_nodes_flagged=m["n"], n_outlier_dets=seen["bad"], rms_before_mmag=seen["rms"],
            rms_after_mmag=after, n_stars_clean=out.system.n_stars,
            n_pairs_clean=out.system.n_pairs, converged=info.converged))
        if not new:
            break
        if len(out.stats) >= 2 and (after or 0.0) > 1.5 * (out.stats[-2].rms_after_mmag or 0.0):
            break
    return out


STATS_DDL = ("iteration int, n_stars_flagged bigint, n_exposures_flagged bigint, "
             "n_nodes_flagged bigint, n_outlier_dets bigint, rms_before_mmag double, "
             "rms_after_mmag double, n_stars_clean bigint, n_pairs_clean bigint, converged boolean")


def iteration_table(spark, stats) -> DataFrame:
    return spark.createDataFrame(stats, STATS_DDL)


def final_solutions(state: Rejection, nodes: DataFrame, anchors: DataFrame, exposure_mjd: DataFrame,
                    band: str, cfg: Config, stage: Stage, modes=("unanchored", "anchored")) -> Rejection:
    """Solve the cleaned data in both modes; unanchored is refined by star flat + gray."""
    if state.system is None:
        state.system = N.accumulate(state.star_lists, nodes, stage, cap=cfg.quality_cuts.max_detections_per_star)
    if "unanchored" in modes:
        zp, info = V.solve_unanchored(state.system, nodes, anchors, cfg, stage)
        zp = stage.write(zp, "zp")
        if cfg.starflat.enabled:
            bounds = cfg.starflat.epoch_boundaries.all_ccds
            flat = stage.write(star_flat(zp, exposure_mjd, bounds, state.flagged_nodes,
                                         state.flagged_exposures), "flat")
            exps = stage.write(
                nodes.select("expnum", "ccdnum")
                .join(state.flagged_nodes, ["expnum", "ccdnum"], "left_anti")
                .join(state.flagged_exposures, "expnum", "left_anti").select("expnum").distinct(),
                "exposures")
            system = N.accumulate_gray(state.star_lists, exps, exposure_mjd, flat, bounds, stage,
                                       cap=cfg.quality_cuts.max_detections_per_star)
            refined, gray, ginfo = V.solve_gray(system, nodes, anchors, flat, exposure_mjd, cfg, stage)
            state.info["gray"] = ginfo
            if ginfo.converged:
                zp, info.mode = stage.write(refined, "zp"), "unanchored_starflat"
                state.flat, state.gray = flat, gray
        state.info["unanchored"] = info
        state.table["unanchored"] = stage.write(V.zeropoint_table(zp, anchors, band), "table")
    if "anchored" in modes:
        # The loop's last solve used the same cleaned data and anchors.
        if not state.stats:
            zp, info = V.solve_anchored(state.system, nodes, anchors, cfg, stage)
            state.zp = stage.write(zp, "zp")
            state.info["anchored"] = info
        state.table["anchored"] = stage.write(V.zeropoint_table(state.zp, anchors, band), "table")
    return state
