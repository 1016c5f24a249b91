"""Interpolation between HEALPix cells and the dust map lookup."""

import math

import pytest
from pyspark.sql import functions as F

from lumitie.functions import healpix as H
from lumitie.sources import dust as DU
from lumitie.sources import tables as T


@pytest.fixture(scope="module")
def sky(spark):
    rows = [(f"{a}/{d}", float(a), float(d)) for a in (0, 13, 45, 90.5, 179.99, 270, 359.9) for d in (-90, -89.5, -60, -41.9, -30, 0, 12.5, 41.8, 75, 89.9, 90)]
    return spark.createDataFrame(rows, "objectid string, ra double, dec double")


@pytest.mark.parametrize("nside", [1, 4, 32])
def test_weights_sum_to_one_and_pixels_exist(sky, nside):
    out = H.interpolation_rows(sky, nside).groupBy("objectid").agg(F.sum("weight").alias("w"), F.min("weight").alias("low"), F.min("pixel").alias("a"), F.max("pixel").alias("b")).collect()
    assert len(out) == 77
    for r in out:
        assert r.w == pytest.approx(1.0, abs=1e-9) and r.low > -1e-9 and r.a >= 0 and r.b < 12 * nside * nside


def test_centres_take_their_own_value(spark):
    centres = H.all_pixels(spark, 4).selectExpr("healpix_pixel AS objectid", "ra_center AS ra", "dec_center AS dec")
    own = H.interpolation_rows(centres, 4).where("pixel = objectid").groupBy("objectid").agg(F.sum("weight").alias("w")).collect()
    assert len(own) == 192 and min(r.w for r in own) > 1 - 1e-6


def test_a_smooth_field_is_followed(spark, sky):
    z = H.all_pixels(spark, 64).select(F.lit(64).alias("nside"), "healpix_pixel", F.sin(F.radians("dec_center")).alias("ebv"))
    for r in DU.lookup(sky, z).join(sky, "objectid").collect():
        assert r.ebv_sfd == pytest.approx(math.sin(math.radians(r.dec)), abs=2e-3)


def test_finest_complete_resolution_wins(spark):
    stars = spark.createDataFrame([("a", 55.0, -30.0), ("b", 57.0, -30.0), ("c", None, 1.0), (None, 1.0, 1.0), ("d", 200.0, 60.0)], "objectid string, ra double, dec double")
    coarse = H.all_pixels(spark, 8).where("dec_center < 20").selectExpr("8 AS nside", "healpix_pixel", "0.1D AS ebv")
    fine = H.interpolation_rows(stars.where("objectid = 'a'"), 64).selectExpr("64 AS nside", "pixel AS healpix_pixel", "0.3D AS ebv").distinct()
    partly = H.interpolation_rows(stars.where("objectid = 'd'"), 64).where("weight > 0").limit(1).selectExpr("64 AS nside", "pixel AS healpix_pixel", "0.7D AS ebv")
    got = {r.objectid: (round(r.ebv_sfd, 9), r.nside) for r in DU.lookup(stars, coarse.unionByName(fine).unionByName(partly)).collect()}
    assert got == {"a": (0.3, 64), "b": (0.1, 8), "d": (0.7, 64)}
    catalog = T.attach_ebv(stars.where("objectid is not null"), coarse)
    assert {r.objectid: r.ebv_sfd for r in catalog.collect()}["d"] is None and catalog.count() == 4
    assert DU.lookup(stars, coarse.limit(0)).count() == 0
    with pytest.raises(ValueError):
        DU.resolutions(spark.createDataFrame([(3, 1, 0.1)], "nside int, healpix_pixel long, ebv double"))
