"""Calibration inputs mapped from the TPC-H-like test tables.

Star = part, exposure = supplier, detector = line number; every node has a known true
zero-point, so solutions can be checked at any scale.  All relations derive from the
given tables with Spark expressions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitie.config import Config

MEAS_EXPR = {
    "objectid": "CAST(l_partkey AS BIGINT)",
    "exposure": "concat('c4d_', CAST(l_suppkey AS STRING))",
    "expnum_src": "CAST(l_suppkey AS BIGINT)",
    "ccdnum": "CAST(l_linenumber AS INT)",
    "mag_aper4": ("17.0e0 + (l_partkey % 300)/100.0e0"
                  " - (31.4e0 + ((l_suppkey*7 + l_linenumber*3) % 41 - 20)/1000.0e0) + 31.4e0"
                  " + (l_quantity - 25.5e0)/5000.0e0"
                  " + CASE WHEN l_orderkey % 97 = 0 THEN 0.15e0 ELSE 0.0e0 END"
                  " + ((l_suppkey*11 + l_linenumber*5) % 61 - 30)/1000.0e0"),
    "magerr_aper4": "0.004e0 + l_tax/10.0e0",
    "class_star": "1.0e0 - 3.0e0*l_discount",
    "flags": "CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END",
    "mjd": "55900.3e0 + ((l_suppkey - l_suppkey % 5)/5e0*127) % 2600 + (l_suppkey % 5)*0.015e0",
    "ra": "50.0e0 + (l_partkey % 997)/99.7e0",
    "dec": "-35.0e0 + ((l_partkey*31) % 1009)/100.9e0",
    "x": "1.0e0 + (l_orderkey*13) % 2047",
    "y": "1.0e0 + (l_orderkey*29) % 4095",
    "fwhm": "0.8e0 + ((l_suppkey*17 + l_linenumber) % 29)/40.0e0",
}


def config() -> Config:
    """Default configuration with the mapping's excluded detector."""
    base = Config()
    return replace(base, quality_cuts=replace(base.quality_cuts, exclude_ccdnums=(6,)))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meas(spark: SparkSession, sf_dir: str, band: str = "g") -> DataFrame:
    """Single-epoch measurements; the r band is the g band minus the star's colour."""
    li = _read(spark, sf_dir, "lineitem")
    out = li.selectExpr(*[f"{e} AS {n}" for n, e in MEAS_EXPR.items() if n != "expnum_src"])
    if band == "r":
        out = out.withColumn("mag_aper4", F.col("mag_aper4") - star_colour("objectid"))
    return out.withColumn("filter", F.lit(band))


def arriving_meas(spark: SparkSession, sf_dir: str, band: str = "g") -> DataFrame:
    """The measurements with their places in the source."""
    from lumitie.sources.tables import with_arrival

    rows = with_arrival(_read(spark, sf_dir, "lineitem"))
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in MEAS_EXPR.items() if n != "expnum_src"], "arrival_file", "arrival_row", f"'{band}' AS filter")


def star_colour(objectid: str):
    return F.expr(f"0.3e0 + ({objectid} % 20)/10.0e0")


def chip(spark: SparkSession, sf_dir: str, band: str = "g") -> DataFrame:
    nodes = node_grid(spark, sf_dir)
    return nodes.selectExpr("concat('c4d_', CAST(expnum AS STRING)) AS exposure", "ccdnum",
                            "((expnum*11 + ccdnum*5) % 61 - 30)/1000.0e0 AS zpterm",
                            f"'{band}' AS filter")


def node_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.selectExpr("CAST(l_suppkey AS BIGINT) AS expnum",
                         "CAST(l_linenumber AS INT) AS ccdnum").distinct()


def exposure(spark: SparkSession, sf_dir: str, band: str = "g") -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.selectExpr(
        "concat('c4d_', CAST(s_suppkey AS STRING)) AS exposure", "CAST(s_suppkey AS BIGINT) AS expnum",
        "CASE WHEN s_suppkey % 10 = 9 THEN 'k4m' ELSE 'c4d' END AS instrument",
        "55900.3e0 + ((s_suppkey - s_suppkey % 5)/5e0*127) % 2600 + (s_suppkey % 5)*0.015e0 AS mjd",
        f"'{band}' AS filter")


def exptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.where("s_suppkey % 3 <> 2").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS expnum",
        "CASE WHEN s_suppkey % 6 = 0 THEN 200.0e0 ELSE 90.0e0 END AS exptime")


def anchor(spark: SparkSession, sf_dir: str, band: str = "g") -> DataFrame:
    """Reference zero-points of every fourth exposure, with sentinels and exptime terms."""
    nodes = node_grid(spark, sf_dir).where("expnum % 4 = 0")
    return nodes.selectExpr(
        "expnum", "ccdnum", f"'{band}' AS band",
        "CASE WHEN (expnum + ccdnum) % 50 = 0 THEN -9999.0e0 ELSE"
        " 31.4e0 + ((expnum*7 + ccdnum*3) % 41 - 20)/1000.0e0"
        " + CASE WHEN expnum % 6 = 0 THEN 2.5e0*log10(200.0e0/90.0e0) ELSE 0.0e0 END END AS mag_zero",
        "0.002e0 AS sigma_mag_zero", "'FGCM' AS source", "0 AS flag")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per star with its true position, magnitude and colour."""
    p = _read(spark, sf_dir, "part")
    return p.selectExpr("CAST(p_partkey AS BIGINT) AS objectid",
                        "50.0e0 + (p_partkey % 997)/99.7e0 AS ra",
                        "-35.0e0 + ((p_partkey*31) % 1009)/100.9e0 AS dec",
                        "17.0e0 + (p_partkey % 300)/100.0e0 AS mag_true",
                        "0.3e0 + (p_partkey % 20)/10.0e0 AS color",
                        "0.02e0 + (p_partkey % 7)/100.0e0 AS ebv")


def second_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stars, shifted by 0.3 and -0.2 arcsec, without every seventh one."""
    s = stars(spark, sf_dir).where("objectid % 7 <> 0")
    return s.selectExpr("objectid + 5000000 AS objid", "ra + 0.3e0/3600 AS ra_mean",
                        "dec - 0.2e0/3600 AS dec_mean",
                        "mag_true - (0.05e0 + 0.02e0*color) AS psf_mag",
                        "mag_true + 0.1e0 AS g_mag", "mag_true + 0.1e0 - 1.3e0*color AS i_mag")


def gaia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference photometry with a colour term, a sky gradient and a few spikes."""
    s = stars(spark, sf_dir)
    spike = "CASE WHEN objectid % 83 = 0 THEN 0.4e0 ELSE 0.0e0 END"
    tilt = "0.004e0*(ra - 55.0e0) - 0.002e0*(dec + 30.0e0)"
    ct = "0.05e0 + 0.02e0*color + 0.01e0*color*color"
    return s.selectExpr(
        "objectid + 7000000 AS source_id", "ra", "dec",
        f"mag_true - ({ct}) - ({tilt}) + {spike} AS phot_bp_mean_mag",
        f"mag_true - color - ({ct}) - ({tilt}) + {spike} AS phot_rp_mean_mag",
        "mag_true - 0.5e0*color AS phot_g_mean_mag", "0.4e0 + 1.1e0*color AS bp_rp",
        "CASE WHEN objectid % 41 = 0 THEN 20.0e0 ELSE 300.0e0 END AS phot_g_mean_flux_over_error",
        "80.0e0 AS phot_bp_mean_flux_over_error", "80.0e0 AS phot_rp_mean_flux_over_error")


def xmatch(spark: SparkSession, sf_dir: str, offset: int = 7000000) -> DataFrame:
    s = stars(spark, sf_dir)
    return s.selectExpr(f"objectid + {offset} AS id1", "objectid AS id2",
                        "0.1e0 + (objectid % 12)/10.0e0 AS distance")


def dust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dust map around all stars at a coarse resolution and around those east of RA 54 at a finer one."""
    from lumitie.functions.healpix import interpolation_rows

    out = None
    for nside, where in ((16, "true"), (64, "ra > 54.0e0")):
        cells = interpolation_rows(stars(spark, sf_dir).where(where), nside).select(F.col("pixel").alias("healpix_pixel")).distinct()
        one = cells.selectExpr(f"{nside} AS nside", "healpix_pixel", f"0.02e0 + ((healpix_pixel*37) % 101)/1000.0e0 + {nside}/10000.0e0 AS ebv")
        out = one if out is None else out.unionByName(one)
    return out


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy Survey objects: every star, some of them extended or without a measured flux."""
    return stars(spark, sf_dir).selectExpr(
        "objectid + 9000000 AS ls_id", "ra", "dec", "CASE WHEN objectid % 17 = 3 THEN 'REX' ELSE 'PSF' END AS type",
        "mag_true - 0.03e0*color + CASE WHEN objectid % 83 = 0 THEN 0.4e0 ELSE 0.0e0 END AS mag_g", "mag_true - color AS mag_r",
        "mag_true - 1.4e0*color AS mag_i", "CASE WHEN objectid % 19 = 5 THEN 0.0e0 ELSE 4.0e0 END AS flux_ivar_g")


def ps1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PS1 mean objects: the second catalog with numbers of detections and quality."""
    return second_catalog(spark, sf_dir).selectExpr(
        "objid AS objID", "ra_mean AS raMean", "dec_mean AS decMean", "CASE WHEN objid % 23 = 7 THEN 1 ELSE 5 END AS nDetections",
        "g_mag AS gMeanPSFMag", "i_mag AS iMeanPSFMag", "CASE WHEN objid % 29 = 3 THEN 0.5e0 ELSE 0.99e0 END AS gQfPerfect")
