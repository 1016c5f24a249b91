import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitie.config import EpochBoundaries, load_config
from lumitie.functions import chebyshev as C
from lumitie.functions import epochs as E
from lumitie.functions import healpix as H
from lumitie.functions import photometry as P


def test_default_config_values():
    cfg = load_config()
    assert cfg.survey.bands == ("g", "r", "i", "z") and cfg.survey.nside_chunk == 32
    q = cfg.quality_cuts
    assert (q.mag_min, q.mag_max, q.magerr_max, q.class_star_min) == (17.0, 20.0, 0.05, 0.8)
    assert (q.min_detections_per_star, q.max_detections_per_star, q.exclude_ccdnums) == (2, 25, (61,))


def test_yaml_overrides_are_coerced(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("solve:\n  des_anchor_weight: 1.0e6\n  tolerance: 1.0e-7\nquality_cuts:\n"
                 "  exclude_ccdnums: [61, 2]\nstarflat:\n  epoch_boundaries:\n    global: [56404]\n"
                 "    per_ccd: {2: [57000]}\n")
    cfg = load_config(f)
    assert cfg.solve.des_anchor_weight == 1.0e6 and cfg.solve.tolerance == 1e-7
    assert cfg.quality_cuts.exclude_ccdnums == (61, 2)
    assert cfg.starflat.epoch_boundaries == EpochBoundaries((56404,), {2: (57000,)})


def test_patch_has_forty_known_pixels(spark):
    pix = {r[0] for r in H.named_region_pixels(spark, 32, "test-patch").collect()}
    assert len(pix) == 40
    assert {8657, 8787, 9043, 9298, 9299} <= pix


def test_region_contains_patch(spark):
    region = {r[0] for r in H.named_region_pixels(spark, 32, "test-region").collect()}
    patch = {r[0] for r in H.named_region_pixels(spark, 32, "test-patch").collect()}
    assert patch <= region and len(region) == 96


def test_footprint_count(spark):
    assert H.footprint_pixels(spark, 32, 35.0).count() == 9664


def test_footprint_is_a_range_without_a_filter(spark):
    """A filter on the centre came back in joins on the pixel, as a plan of a megabyte."""
    for nside, limit in ((1, 0.0), (2, 41.0), (8, -29.5), (32, -29.5), (16, -66.0), (8, 90.0), (8, -90.0)):
        want = {r[0] for r in H.all_pixels(spark, nside).where(F.col("dec_center") < limit).select("healpix_pixel").collect()}
        assert {r[0] for r in H.footprint_pixels(spark, nside, limit).select("healpix_pixel").collect()} == want
    stars = H.with_pixel(spark.range(9).selectExpr("40.0D + id AS ra", "-35.0D AS dec"), 32).groupBy("healpix_pixel").count()
    joined = H.footprint_pixels(spark, 32, -29.5).join(stars, "healpix_pixel", "left")
    assert len(joined._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_pixel_centre_maps_back(spark):
    for nside in (1, 2, 16):
        pix = H.all_pixels(spark, nside).withColumnRenamed("healpix_pixel", "p")
        back = H.with_pixel(pix, nside, "ra_center", "dec_center")
        assert back.where("p <> healpix_pixel").count() == 0


def test_pixel_box_is_half_again_wider(spark):
    ra0, ra1, d0, d1 = H.pixel_box(32, F.col("id"))
    row = spark.range(8657, 8658).select(ra0.alias("a"), ra1.alias("b"), d0.alias("c"), d1.alias("d")).first()
    assert row.d - row.c == pytest.approx(2 * 1.5 * H.pixel_radius(32))
    assert row.b - row.a > row.d - row.c


def _epochs(spark, rows):
    df = spark.createDataFrame(rows, "mjd double, ccdnum int")
    b = EpochBoundaries()
    return [tuple(r) for r in df.select(
        E.epoch_for_ccd(F.col("mjd"), F.col("ccdnum"), b), E.epoch_index(F.col("mjd"), b.all_ccds)).collect()]


def test_epochs_of_an_ordinary_detector(spark):
    got = _epochs(spark, [(56000.0, 1), (56500.0, 1), (57000.0, 1)])
    assert [g[0] for g in got] == [0, 1, 3]


def test_epochs_of_detector_with_own_boundaries(spark):
    got = [g[0] for g in _epochs(spark, [(56600.0, 2), (57000.0, 2), (58000.0, 2)])]
    assert got[0] < got[1] < got[2]
    assert [g[0] for g in _epochs(spark, [(58300.0, 41), (58400.0, 41)])] == [3, 4]


def test_epoch_functions_differ_on_the_boundary(spark):
    assert _epochs(spark, [(56404.0, 1)]) == [(0, 1)]


def test_chebyshev_evaluation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, y, c = rng.uniform(1, 2048, 50), rng.uniform(1, 4096, 50), rng.normal(size=16)
    df = spark.createDataFrame([(float(a), float(b), [float(v) for v in c]) for a, b in zip(x, y)],
                               "x double, y double, coeffs array<double>")
    got = [r[0] for r in df.select(C.evaluate(F.col("x"), F.col("y"), F.col("coeffs"))).collect()]
    want = np.polynomial.chebyshev.chebval2d(2 * (x - 1) / 2047 - 1, 2 * (y - 1) / 4095 - 1, c.reshape(4, 4))
    assert np.allclose(got, want, atol=1e-12)


def test_program_and_class_labels(spark):
    df = spark.createDataFrame([("c4d", 90.0), ("c4d", 45.0), ("c4d", 200.0), ("c4d", 360.0), ("c4d", 77.0),
                                ("c4d", None), ("k4m", None), (None, None)], "i string, t double")
    got = [r[0] for r in df.select(P.program_class(F.col("i"), F.col("t"))).collect()]
    assert got == ["DES_survey_90s", "DES_45s", "DES_SN_deep", "DES_long", "DES_other",
                   "DECam_no_DES_ZP", "non-DES", "unknown"]


def test_exptime_normalisation(spark):
    df = spark.createDataFrame([(31.0, 90.0), (31.0, 200.0), (31.0, None)], "z double, t double")
    got = [r[0] for r in df.select(P.exptime_normalised(F.col("z"), F.col("t"))).collect()]
    assert got == pytest.approx([31.0, 31.0 - 2.5 * np.log10(200 / 90), 31.0])
