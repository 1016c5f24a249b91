"""Extinction from a dust map given as HEALPix cells, of one or several resolutions.

A map is a table (nside, healpix_pixel, ebv).  Positions are interpolated between the cells around them at every resolution
and take the finest one that knows all of these cells; where none does, the finest that knows some, weighted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.functions.healpix import interpolation_rows

#: Weights are complete from here on.
COMPLETE = 1.0 - 1e-9


def resolutions(dust: DataFrame) -> list[int]:
    """The resolutions of a map; being powers of two up to 2^29 there are at most 30."""
    sides = sorted(r[0] for r in dust.select("nside").where(F.col("nside").isNotNull()).distinct().limit(31).collect())
    if any(n < 1 or n & (n - 1) for n in sides) or len(sides) > 30:
        raise ValueError(f"resolutions of a dust map must be powers of two, not {sides}")
    return sides


def lookup(positions: DataFrame, dust: DataFrame, key: str = "objectid", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """key, ebv_sfd, nside: interpolated extinction of every position that has a known cell around it.

    Repeated keys must repeat their position.  Cells with NULL extinction are unknown; a repeated cell counts once, with its mean.
    """
    cells = dust.where(F.col("ebv").isNotNull() & F.col("healpix_pixel").isNotNull()).groupBy("nside", F.col("healpix_pixel").alias("pixel")).agg(F.avg("ebv").alias("ebv"))
    places = positions.select(F.col(key).alias("_key"), F.col(ra).alias("ra"), F.col(dec).alias("dec")).where("_key is not null").dropDuplicates(["_key"])
    around = None
    for nside in resolutions(dust):
        one = interpolation_rows(places, nside).select("_key", F.lit(nside).alias("nside"), "pixel", "weight")
        around = one if around is None else around.unionByName(one)
    if around is None:
        return positions.select(key).limit(0).select(F.col(key), F.lit(None).cast("double").alias("ebv_sfd"), F.lit(None).cast("int").alias("nside"))
    met = around.groupBy("_key", "nside", "pixel").agg(F.sum("weight").alias("weight")).join(cells, ["nside", "pixel"])
    each = met.groupBy("_key", "nside").agg((F.sum(F.col("weight") * F.col("ebv")) / F.sum("weight")).alias("ebv_sfd"), F.sum("weight").alias("known"))
    order = F.struct(F.col("known") >= COMPLETE, F.col("nside"))
    best = each.where("known > 0").groupBy("_key").agg(F.max_by(F.struct("ebv_sfd", "nside"), order).alias("b"))
    return best.select(F.col("_key").alias(key), "b.ebv_sfd", "b.nside")
