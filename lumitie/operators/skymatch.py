"""Nearest-neighbour match of two sky catalogs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitie.functions.sky import separation_arcsec

CELL_ARCSEC = 10.0


def _zone(dec: Column, size: float) -> Column:
    top = math.floor(180.0 / size) - 1
    return F.least(F.floor((dec + 90.0) / size), F.lit(top)).cast("long")


def _buckets(zone: Column, size: float) -> Column:
    """RA buckets of a zone: each at least ``size`` degrees wide, one at the poles."""
    edge = F.greatest(F.abs(zone * size - 90.0), F.abs((zone + 1) * size - 90.0))
    return F.greatest(F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (360.0 / size)),
                      F.lit(1)).cast("long")


def _cell(zone: Column, n: Column, ra: Column) -> Column:
    bucket = F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / F.lit(360.0) * n).cast("long"), n)
    return F.shiftleft(zone, 32).bitwiseOR(bucket)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                   radius_arcsec: float = 1.0, left_ra="ra", left_dec="dec", right_ra="ra",
                   right_dec="dec") -> DataFrame:
    """Each left row's nearest right row closer than the radius: (left_id, right_id, sep).

    Right rows are copied to every cell their circle touches, so one equi-join on cells
    finds all candidates.  Equal positions are first merged on both sides, hence piles
    of copies at one spot cannot multiply; the nearest is a grouped minimum with
    map-side combine.  Ties go to the smallest right id.
    """
    size = CELL_ARCSEC / 3600.0
    reach = radius_arcsec / 3600.0
    r = (right.where(F.col(right_ra).isNotNull() & F.col(right_dec).isNotNull())
         .groupBy(F.col(right_ra).alias("_rra"), F.col(right_dec).alias("_rdec"))
         .agg(F.min(right_id).alias("_rid")))
    wide = F.degrees(F.asin(F.least(
        F.sin(F.radians(F.lit(reach))) / F.greatest(F.cos(F.radians("_rdec")), F.lit(1e-12)),
        F.lit(1.0))))
    # Zones and bucket counts become columns first, so each is computed once.
    r = r.withColumn("_wide", wide)
    for k, dy in enumerate((-1.0, 0.0, 1.0)):
        r = r.withColumn(f"_z{k}", _zone(F.col("_rdec") + dy * reach, size))
    for k in range(3):
        r = r.withColumn(f"_n{k}", _buckets(F.col(f"_z{k}"), size))
    corners = [_cell(F.col(f"_z{k}"), F.col(f"_n{k}"), F.col("_rra") + dx * F.col("_wide"))
               for k in range(3) for dx in (-1.0, 0.0, 1.0)]
    r = r.select("_rra", "_rdec", "_rid", F.explode(F.array_distinct(F.array(*corners))).alias("_cell"))

    spots = (left.where(F.col(left_ra).isNotNull() & F.col(left_dec).isNotNull())
             .select(F.col(left_ra).alias("_lra"), F.col(left_dec).alias("_ldec")).distinct())
    spots = spots.withColumn("_z", _zone(F.col("_ldec"), size))
    spots = spots.withColumn("_n", _buckets(F.col("_z"), size))
    spots = spots.select("_lra", "_ldec", _cell(F.col("_z"), F.col("_n"), F.col("_lra")).alias("_cell"))
    sep = separation_arcsec(F.col("_lra"), F.col("_ldec"), F.col("_rra"), F.col("_rdec"))
    near = (spots.join(r, "_cell").withColumn("sep_arcsec", sep)
            .where(F.col("sep_arcsec") < radius_arcsec)
            .groupBy("_lra", "_ldec").agg(F.min(F.struct("sep_arcsec", "_rid")).alias("_best")))
    rows = left.select(left_id, F.col(left_ra).alias("_lra"), F.col(left_dec).alias("_ldec"))
    return (rows.join(near, ["_lra", "_ldec"])
            .select(left_id, F.col("_best._rid").alias(right_id), F.col("_best.sep_arcsec")))


def prebuilt_match(objects: DataFrame, xmatch: DataFrame, object_id: str, box=None,
                   max_distance: float = 1.0, where: Column | None = None) -> DataFrame:
    """Objects joined to a published cross-match (id1, id2, distance) inside a box."""
    if box is not None:
        ra0, ra1, dec0, dec1 = box
        objects = objects.where(F.col("ra").between(ra0, ra1) & F.col("dec").between(dec0, dec1))
    if where is not None:
        objects = objects.where(where)
    x = xmatch.where(F.col("distance") < max_distance).select(
        F.col("id1").alias(object_id), F.col("id2").alias("nsc_objectid"),
        F.col("distance").alias("xmatch_dist"))
    return objects.join(x, object_id)


def bounding_box(catalog: DataFrame, margin: float = 0.1):
    """(ra_min, ra_max, dec_min, dec_max) with a margin, from one aggregate row."""
    row = catalog.agg(F.min("ra"), F.max("ra"), F.min("dec"), F.max("dec")).first()
    if row[0] is None:
        return None
    return row[0] - margin, row[1] + margin, row[2] - margin, row[3] + margin
