"""Selections from the external reference catalogs, as (object, nsc_objectid) tables.

Catalogs without a published match are stored in zones of right ascension and declination.  A match reads the zones its stars
can reach, which Spark finds out while it runs and hands to the scan as a partition filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumitie.operators.skymatch import bounding_box, nearest_within, prebuilt_match

# PS1 coverage limit, selection limits, and the columns carried along.
PS1_SOUTH = -30.0
PS1_MAG_LIMIT = 22.0
PS1_QUALITY = 0.85
# Fixed value: width of the strips in right ascension, in degrees; declination is cut at every degree.
STRIP_RA = 2.0


def _zone(ra: Column, dec: Column) -> Column:
    """Number of the zone that holds a position."""
    strip = F.floor(F.pmod(ra, F.lit(360.0)) / F.lit(STRIP_RA))
    row = F.least(F.greatest(F.floor(dec + F.lit(90.0)), F.lit(0)), F.lit(179))
    return (row * F.lit(int(360 / STRIP_RA)) + strip).cast("int")


def write_zones(objects: DataFrame, path: str, ra: str = "raMean", dec: str = "decMean") -> None:
    """Store a catalog in zones, each sorted by declination; rows without a position are left out."""
    placed = objects.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).withColumn("zone", _zone(F.col(ra), F.col(dec)))
    (placed.repartitionByRange("zone", dec).sortWithinPartitions("zone", dec).write.mode("overwrite").partitionBy("zone").parquet(path))


def zones_near(stars: DataFrame, radius_arcsec: float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The zones within the radius of any star: a position can reach the zones of its circle's corners."""
    reach = radius_arcsec / 3600.0
    wide = F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col(dec)) + F.lit(reach), F.lit(90.0)))), F.lit(1e-6))
    corners = [_zone(F.col(ra) + F.lit(float(x)) * F.least(wide, F.lit(STRIP_RA)), F.col(dec) + F.lit(y * reach)) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    near = stars.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).select(F.explode(F.array_distinct(F.array(*corners))).alias("zone"))
    # within two degrees of a pole a small circle can reach every strip of its row
    polar = stars.where(F.abs(F.col(dec)) > 88.0).select(F.floor(F.least(F.col(dec), F.lit(89.5)) + F.lit(90.0)).cast("int").alias("row")).distinct()
    around = polar.select(F.explode(F.sequence(F.greatest(F.col("row") - 1, F.lit(0)), F.least(F.col("row") + 1, F.lit(179)))).alias("row")).select(
        F.explode(F.sequence(F.col("row") * int(360 / STRIP_RA), F.col("row") * int(360 / STRIP_RA) + int(360 / STRIP_RA) - 1)).alias("zone"))
    return near.unionByName(around).distinct()


def read_zones(spark: SparkSession, path: str, struct: StructType, stars: DataFrame, radius_arcsec: float = 1.0) -> DataFrame:
    """The stored objects of the zones that ``stars`` can reach."""
    stored = spark.read.schema(StructType([*struct.fields, StructField("zone", IntegerType())])).parquet(path)
    return stored.join(zones_near(stars, radius_arcsec), "zone", "left_semi").drop("zone")


def gaia(objects: DataFrame, xmatch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Gaia sources with good fluxes inside the catalog's box, matched within 1 arcsec."""
    good = ((F.col("phot_g_mean_flux_over_error") > 50) & (F.col("phot_bp_mean_flux_over_error") > 10)
            & (F.col("phot_rp_mean_flux_over_error") > 10))
    return prebuilt_match(objects, xmatch, "source_id", bounding_box(catalog), where=good)


def legacy_survey(objects: DataFrame, xmatch: DataFrame, catalog: DataFrame, band: str) -> DataFrame:
    """Point sources of the Legacy Survey with a measured flux in the band."""
    good = (F.col("type") == "PSF") & (F.col(f"flux_ivar_{band}") > 0)
    return prebuilt_match(objects, xmatch, "ls_id", bounding_box(catalog), where=good)


def ps1(objects: DataFrame, catalog: DataFrame, band: str) -> DataFrame:
    """Nearest PS1 mean object of each catalog star north of -30 degrees, within 1 arcsec.

    PS1 columns carry the prefix ``ps1_``.
    """
    north = catalog.where(F.col("dec") > PS1_SOUTH).select("objectid", "ra", "dec")
    box = bounding_box(north)
    mag, quality = F.col(f"{band}MeanPSFMag"), F.col(f"{band}QfPerfect")
    good = objects.where((F.col("nDetections") > 1) & (mag > 0) & (mag < PS1_MAG_LIMIT)
                         & (quality > PS1_QUALITY))
    if box is not None:
        good = good.where(F.col("raMean").between(box[0], box[1])
                          & F.col("decMean").between(max(box[2], PS1_SOUTH), box[3]))
    match = nearest_within(north, good, "objectid", "objID", right_ra="raMean", right_dec="decMean")
    named = good.withColumnsRenamed({c: f"ps1_{c}" for c in good.columns if c != "objID"})
    return match.withColumnRenamed("sep_arcsec", "ps1_xmatch_dist_arcsec").join(named, "objID").withColumnRenamed(
        "objID", "ps1_objID")
