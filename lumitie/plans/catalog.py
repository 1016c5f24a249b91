"""Phase 5: the calibrated star catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.functions import photometry as P
from lumitie.functions.epochs import epoch_for_ccd, epoch_index
from lumitie.operators.robust import scalar_median
from lumitie.plans.starflat import flat_offset, usable_zeropoints


def magzero(anchors: DataFrame, zpterm: DataFrame) -> float:
    """Median of reference zero-point minus zpterm over valid nodes."""
    both = anchors.where(P.valid_zp(F.col("zp_fgcm"))).join(
        zpterm.where(F.abs(F.col("zpterm")) < 2.0), ["expnum", "ccdnum"])
    m = scalar_median(both.select((F.col("zp_fgcm") - F.col("zpterm")).alias("d")), "d")
    return P.DEFAULT_MAGZERO if m is None else m


def constant_flat(rows: DataFrame, flat: DataFrame | None, cfg: Config,
                  per_ccd_epochs: bool = False) -> DataFrame:
    """Add ``flat_const`` from the per-detector, per-epoch flat.

    The flat is keyed by the shared epoch count, so that is the default lookup;
    ``per_ccd_epochs`` looks it up with the detector's own epoch count instead.
    """
    if flat is None:
        return rows.withColumn("flat_const", F.lit(0.0))
    bounds = cfg.starflat.epoch_boundaries
    mjd = F.col("mjd")
    idx = (epoch_for_ccd(mjd, F.col("ccdnum"), bounds) if per_ccd_epochs
           else epoch_index(mjd, bounds.all_ccds))
    keyed = rows.withColumn("epoch_idx", F.when(mjd.isNotNull(), idx))
    joined = keyed.join(flat, ["ccdnum", "epoch_idx"], "left")
    return joined.withColumn("flat_const", F.coalesce("flat_correction", F.lit(0.0))).drop(
        "flat_correction", "epoch_idx")


def calibrated_rows(dets: DataFrame, zp: DataFrame, zpterm: DataFrame, offset: float, cfg: Config,
                    coeffs=None, flat=None, flagged_stars=None, per_ccd_epochs=False) -> DataFrame:
    """Detections with calibrated, original and flat-only magnitudes and weights."""
    rows = dets.join(usable_zeropoints(zp).select("expnum", "ccdnum", "zp_solved"),
                     ["expnum", "ccdnum"])
    if flagged_stars is not None:
        rows = rows.join(flagged_stars.select("objectid"), "objectid", "left_anti")
    rows = rows.join(zpterm, ["expnum", "ccdnum"], "left")
    rows = constant_flat(flat_offset(rows, coeffs, cfg), flat, cfg, per_ccd_epochs)
    before = F.col("m_inst") + F.coalesce("zpterm", F.lit(0.0))
    return rows.select(
        "objectid", "healpix_pixel", "expnum", "ccdnum", "mjd", "ra", "dec",
        (F.col("m_inst") + F.col("zp_solved") - F.lit(offset) - F.col("delta_sf")).alias("m_cal"),
        before.alias("m_before"), (before + F.col("flat_const")).alias("m_flat"),
        P.weight(F.col("m_err")).alias("w"))


def star_catalog(rows: DataFrame, band: str) -> DataFrame:
    """One row per star: weighted means, error, count, reduced chi-square, first position.

    The mean is attached by window first, so chi-square sums squares of small
    differences instead of cancelling large sums.
    """
    star = Window.partitionBy("objectid")
    mean = F.sum(F.col("w") * F.col("m_cal")).over(star) / F.sum("w").over(star)
    rows = rows.withColumn("_mean", mean)
    order = F.struct("healpix_pixel", "mjd", "expnum", "ccdnum")
    wsum = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    agg = rows.groupBy("objectid").agg(
        F.min_by(F.struct("ra", "dec"), order).alias("_pos"),
        F.first("_mean").alias("_mag"), wsum("m_flat").alias("_flat"),
        wsum("m_before").alias("_before"), (F.lit(1.0) / F.sqrt(F.sum("w"))).alias("_err"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("w") * F.pow(F.col("m_cal") - F.col("_mean"), 2)).alias("_chi2"))
    return agg.select(
        "objectid", F.col("_pos.ra").alias("ra"), F.col("_pos.dec").alias("dec"),
        F.col("_mag").alias(f"mag_cal_{band}"), F.col("_flat").alias(f"mag_starflat_{band}"),
        F.col("_before").alias(f"mag_before_{band}"), F.col("_err").alias(f"magerr_cal_{band}"),
        F.col("_n").alias(f"nobs_{band}"),
        (F.col("_chi2") / F.greatest(F.col("_n") - 1, F.lit(1))).alias(f"chi2_{band}"))


def deredden_catalog(catalog: DataFrame, band: str) -> DataFrame:
    """Add the dereddened magnitude; needs ``ebv_sfd``."""
    return catalog.withColumn(
        f"mag_dered_{band}", P.deredden(F.col(f"mag_cal_{band}"), f"decam_{band}", F.col("ebv_sfd")))


def zeropoint_list(zp: DataFrame, nodes: DataFrame, band: str) -> DataFrame:
    """Published zero-points: connected nodes with a physical solution."""
    return (usable_zeropoints(zp).join(nodes.select("expnum", "ccdnum"), ["expnum", "ccdnum"], "left_semi")
            .select("expnum", "ccdnum", F.lit(band).alias("band"), "zp_solved"))


def catalog_summary(catalog: DataFrame, band: str) -> DataFrame:
    """One-row sanity summary of a catalog."""
    from lumitie.operators.robust import attach_scalar, quantiles

    m, b = F.col(f"mag_cal_{band}"), F.col(f"mag_before_{band}")
    delta = (m - b) * 1000.0
    one = lambda df, c, n: quantiles(df, c, {n: 0.5}).agg(F.max(n).alias(n))
    base = catalog.agg(
        F.count(F.lit(1)).alias("n_stars"), F.stddev_samp(m).alias("mag_std"), F.min(m).alias("mag_min"),
        F.max(m).alias("mag_max"), F.sqrt(F.avg(delta * delta)).alias("correction_rms_mmag"),
        F.max(f"nobs_{band}").alias("nobs_max"),
        F.count(F.when(~P.is_finite(m), 1)).alias("n_not_finite"))
    base = attach_scalar(base, one(catalog, f"mag_cal_{band}", "mag_median"))
    base = attach_scalar(base, one(catalog, f"nobs_{band}", "nobs_median"))
    return attach_scalar(base, one(catalog.withColumn("_d", delta), "_d", "correction_median_mmag"))
