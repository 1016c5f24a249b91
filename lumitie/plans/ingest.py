"""Phase 0: clean, capped detections per pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.functions.healpix import with_pixel
from lumitie.operators.relational import ARRIVAL, cap_arrivals, cap_detections, min_detections
from lumitie.operators.robust import exact_mean
from lumitie.sources import tables as T


def local_joins(meas: DataFrame, chip: DataFrame, exposure: DataFrame, band: str,
                cfg: Config) -> DataFrame:
    """Attach exposure number and zpterm, keep the instrument, form m_inst.

    Lookups are joined without hints: Catalyst broadcasts them while they are small and
    shuffles them (with skew splitting) when they are not.
    """
    exps = exposure.where(F.col("instrument") == cfg.quality_cuts.instrument).select(
        "exposure", "expnum")
    joined = meas.join(exps, "exposure").join(
        chip.select("exposure", "ccdnum", "zpterm"), ["exposure", "ccdnum"])
    cols = joined.columns
    return joined.select(
        "objectid", F.col("expnum").cast("long"), F.col("ccdnum").cast("int"),
        F.lit(band).alias("band"), (F.col("mag_aper4") - F.col("zpterm")).alias("m_inst"),
        F.col("magerr_aper4").cast("double").alias("m_err"),
        *[F.col(c).cast("double") for c in ("mjd", "ra", "dec", "fwhm") if c in cols],
        *[F.col(c).cast("float") for c in ("x", "y") if c in cols], *[c for c in ARRIVAL if c in cols])


def detections(meas: DataFrame, chip: DataFrame, exposure: DataFrame, band: str, cfg: Config,
               pixels=None) -> DataFrame:
    """The whole of phase 0 as one declarative plan with a single wide shuffle."""
    cuts = cfg.quality_cuts
    rows = T.quality_scan(meas, band, cuts)
    rows = local_joins(rows, T.band_lookup(chip, band, cuts.exclude_ccdnums),
                       T.band_lookup(exposure, band), band, cfg)
    rows = with_pixel(rows, cfg.survey.nside_chunk)
    if pixels is not None:
        if isinstance(pixels, DataFrame):
            rows = rows.join(pixels.select("healpix_pixel"), "healpix_pixel", "left_semi")
        else:
            rows = rows.where(F.col("healpix_pixel").isin(list(pixels)))
    return min_detections(cap_detections(rows, cuts.max_detections_per_star),
                          cuts.min_detections_per_star)


def requeried_detections(meas: DataFrame, chip: DataFrame, exposure: DataFrame, band: str, cfg: Config, pixels=None) -> DataFrame:
    """Detections of pixels that were queried again: capped by order of arrival, with ``star_id``, without a least number.

    Columns that the query did not return are padded with NULLs; ``meas`` comes from ``tables.with_arrival``.
    """
    cuts = cfg.quality_cuts
    rows = local_joins(T.quality_scan(meas, band, cuts), T.band_lookup(chip, band, cuts.exclude_ccdnums), T.band_lookup(exposure, band), band, cfg)
    rows = with_pixel(rows, cfg.survey.nside_chunk)
    if pixels is not None:
        rows = rows.join(pixels.select("healpix_pixel"), "healpix_pixel", "left_semi")
    return cap_arrivals(rows, cuts.max_detections_per_star).drop(*ARRIVAL).withColumn("star_id", F.col("objectid"))


def star_lists(dets: DataFrame) -> DataFrame:
    """The narrow columns the solver reads."""
    return dets.select("healpix_pixel", "objectid", "expnum", "ccdnum", "m_inst", "m_err")


def ingest_stats(dets: DataFrame) -> DataFrame:
    """Stars, detections, exposures, detector exposures and pixels."""
    from lumitie.operators.robust import attach_scalar

    base = dets.agg(F.count(F.lit(1)).alias("n_detections"))
    for name, keys in (("n_stars", ["objectid"]), ("n_exposures", ["expnum"]),
                       ("n_ccd_exposures", ["expnum", "ccdnum"]), ("n_pixels", ["healpix_pixel"])):
        base = attach_scalar(base, dets.select(*keys).distinct().agg(F.count(F.lit(1)).alias(name)))
    return base


def missing_pixels(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pixels that should hold detections and do not."""
    return expected.select("healpix_pixel").distinct().join(
        found.select("healpix_pixel").distinct(), "healpix_pixel", "left_anti")


def node_positions(dets: DataFrame) -> DataFrame:
    """Mean over pixels of the per-pixel mean position of each node."""
    per_pixel = dets.groupBy("healpix_pixel", "expnum", "ccdnum").agg(
        exact_mean("ra").alias("ra"), exact_mean("dec").alias("dec"))
    return per_pixel.groupBy("expnum", "ccdnum").agg(
        exact_mean("ra").alias("ra_mean"), exact_mean("dec").alias("dec_mean"))
