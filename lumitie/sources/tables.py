"""Readers and sinks of the stored relations.

Layout: ``<root>/<relation>/band=<b>`` (detections and star lists additionally split by
``healpix_pixel``), so a pixel list prunes partitions and a band is one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitie import schema as S
from lumitie.functions import photometry as P
from lumitie.operators.relational import ARRIVAL, last_wins

# Raw columns a detection needs; FWHM rides along for the aperture diagnostics.
MEAS_COLUMNS = ("objectid", "exposure", "ccdnum", "mag_aper4", "magerr_aper4", "mjd", "ra", "dec",
                "x", "y", "fwhm")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of several candidate locations that holds data."""
    return next((p for p in paths if exists(spark, p)), None)


def read(spark: SparkSession, path: str, struct) -> DataFrame:
    return spark.read.schema(struct).parquet(path)


def read_pixels(spark: SparkSession, path: str, struct, pixels=None) -> DataFrame:
    """Detections of the wanted pixels.

    A short literal list prunes partitions statically, a DataFrame of pixels through
    dynamic partition pruning.
    """
    df = read(spark, path, struct)
    if pixels is None:
        return df
    if isinstance(pixels, DataFrame):
        return df.join(pixels.select("healpix_pixel"), "healpix_pixel", "left_semi")
    return df.where(F.col("healpix_pixel").isin(list(pixels)))


def write_pixels(df: DataFrame, path: str) -> None:
    """Replace the pixels present in ``df``; a large pixel is split over several tasks."""
    (df.repartitionByRange("healpix_pixel", "objectid").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("healpix_pixel").parquet(path))


def drop_pixels(spark: SparkSession, path: str, pixels) -> None:
    """Delete the partitions of the listed pixels."""
    for pixel in pixels:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/healpix_pixel={int(pixel)}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON file for a metrics table of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def with_arrival(scan: DataFrame) -> DataFrame:
    """A Parquet scan with the place of each row in the source: arrival_file and arrival_row.

    The places are hidden columns of the file source, so they are the same under any division into tasks.
    """
    return scan.select("*", F.col("_metadata.file_path").alias("arrival_file"), F.col("_metadata.row_index").alias("arrival_row"))


def quality_scan(meas: DataFrame, band: str, cuts) -> DataFrame:
    """Pushed-down selection of usable measurements with NaN turned into NULL."""
    rows = meas.where(F.col("filter") == band) if "filter" in meas.columns else meas
    rows = rows.where(P.quality_predicate(cuts))
    keep = [c for c in (*MEAS_COLUMNS, *ARRIVAL) if c in rows.columns]
    return rows.select(*[P.nan_to_null(F.col(c)).alias(c) if c in ("mjd", "ra", "dec", "x", "y", "fwhm")
                         else F.col(c) for c in keep])


def band_lookup(df: DataFrame, band: str, exclude_ccdnums=()) -> DataFrame:
    rows = df.where(F.col("filter") == band) if "filter" in df.columns else df
    if exclude_ccdnums:
        rows = rows.where(~F.col("ccdnum").isin(*exclude_ccdnums))
    return rows


def anchors(anchor: DataFrame, band: str, exptime: DataFrame | None = None) -> DataFrame:
    """(expnum, ccdnum, zp_fgcm): FGCM rows of a band, normalised to 90 s, one per node."""
    rows = anchor.where((F.col("source") == "FGCM") & (F.col("band") == band))
    rows = rows.select("expnum", "ccdnum", "mag_zero")
    if exptime is not None:
        one = exptime.groupBy("expnum").agg(F.max("exptime").alias("exptime"))
        rows = rows.join(one, "expnum", "left").select(
            "expnum", "ccdnum",
            P.exptime_normalised(F.col("mag_zero"), F.col("exptime")).alias("mag_zero"))
    return last_wins(rows.withColumnRenamed("mag_zero", "zp_fgcm"), ["expnum", "ccdnum"], ["zp_fgcm"])


def zpterms(chip: DataFrame, exposure: DataFrame) -> DataFrame:
    """(expnum, ccdnum, zpterm), one row per node."""
    joined = chip.select("exposure", "ccdnum", "zpterm").join(
        exposure.select("exposure", "expnum"), "exposure")
    return last_wins(joined.select("expnum", "ccdnum", "zpterm"), ["expnum", "ccdnum"], ["zpterm"])


def exposure_mjds(exposure: DataFrame, instrument: str = "c4d") -> DataFrame:
    rows = exposure.where((F.col("instrument") == instrument) & F.col("mjd").isNotNull())
    return last_wins(rows.select("expnum", "mjd"), ["expnum"], ["mjd"])


def anchor_exposures(anchor: DataFrame, band: str) -> DataFrame:
    return anchor.where((F.col("source") == "FGCM") & (F.col("band") == band)).select(
        "expnum").distinct()


def pad_columns(df: DataFrame, struct) -> DataFrame:
    """Rows with every declared column; absent ones become typed NULLs."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], struct)
    return empty.unionByName(df, allowMissingColumns=True).select(*[f.name for f in struct])


def attach_ebv(catalog: DataFrame, ebv: DataFrame | None, nside: int = 512) -> DataFrame:
    """Reddening from a dust table; NULL without a map.

    A table with a column ``nside`` is interpolated between cells (see ``sources.dust``); one without gives the value of the cell at
    the given resolution.
    """
    from lumitie.functions.healpix import with_pixel
    from lumitie.sources.dust import lookup

    if ebv is None:
        return catalog.withColumn("ebv_sfd", F.lit(None).cast("double"))
    if "nside" in ebv.columns:
        return catalog.join(lookup(catalog, ebv).select("objectid", "ebv_sfd"), "objectid", "left")
    keyed = with_pixel(catalog, nside)
    return (keyed.join(ebv.select("healpix_pixel", F.col("ebv").alias("ebv_sfd")),
                       "healpix_pixel", "left").drop("healpix_pixel"))


def flagged(spark: SparkSession, path: str, struct=S.NODES) -> DataFrame:
    """A flag table, or an empty one of the same shape when it was never written."""
    return read(spark, path, struct) if exists(spark, path) else spark.createDataFrame([], struct)
