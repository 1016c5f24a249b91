from lumitie import schema as S
from lumitie.plans import validate as V
from lumitie.sources import references as R
from lumitie.sources import tables as T


def catalog(spark):
    rows = [("a", 50.0, -29.0), ("b", 51.0, -28.0), ("c", 52.0, -33.0)]
    return spark.createDataFrame(rows, "objectid string, ra double, dec double")


def test_gaia_selection(spark):
    g = [(1, 50.0, -29.0, 100.0, 50.0, 50.0), (2, 51.0, -28.0, 40.0, 50.0, 50.0), (3, 90.0, -29.0, 100.0, 50.0, 50.0)]
    src = T.pad_columns(spark.createDataFrame(g, "source_id bigint, ra double, dec double, phot_g_mean_flux_over_error double,"
                        " phot_bp_mean_flux_over_error double, phot_rp_mean_flux_over_error double"), S.GAIA)
    x = spark.createDataFrame([(1, "a", 0.2), (2, "b", 0.2), (3, "c", 0.2)], "id1 bigint, id2 string, distance double")
    assert [r.nsc_objectid for r in R.gaia(src, x, catalog(spark)).collect()] == ["a"]


def test_legacy_selection(spark):
    rows = [(1, 50.0, -29.0, "PSF", 5.0), (2, 51.0, -28.0, "REX", 5.0), (3, 52.0, -33.0, "PSF", 0.0)]
    src = T.pad_columns(spark.createDataFrame(rows, "ls_id bigint, ra double, dec double, type string, flux_ivar_g double"), S.LEGACY)
    x = spark.createDataFrame([(k, "abc"[k - 1], 0.2) for k in (1, 2, 3)], "id1 bigint, id2 string, distance double")
    assert [r.nsc_objectid for r in R.legacy_survey(src, x, catalog(spark), "g").collect()] == ["a"]


def test_ps1_match_is_north_of_the_limit_and_nearest(spark):
    eps = 0.5 / 3600
    rows = [(1, 50.0, -29.0 + eps, 3, 18.0, 0.9), (2, 50.0, -29.0 + eps / 2, 3, 18.1, 0.9), (3, 51.0, -28.0, 1, 18.0, 0.9),
            (4, 52.0, -33.0, 3, 18.0, 0.9), (5, 51.0, -28.0, 3, 18.0, 0.5)]
    src = T.pad_columns(spark.createDataFrame(
        rows, "objID bigint, raMean double, decMean double, nDetections int, gMeanPSFMag double, gQfPerfect double"), S.PS1)
    got = R.ps1(src, catalog(spark), "g").collect()
    assert [(r.objectid, r.ps1_objID) for r in got] == [("a", 2)]
    assert abs(got[0].ps1_xmatch_dist_arcsec - 0.25) < 1e-3 and got[0].ps1_gMeanPSFMag == 18.1


def test_checks_skip_without_enough_stars(spark, stage):
    few = spark.createDataFrame([("a", 18.0, 18.0, 18.0, 18.0, 2)],
                                "objectid string, mag_fgcm double, mag_solved double, mag_before double, mag_starflat double, n_des int")
    row = V.fgcm_comparison(few).first()
    assert (row.status, row.passed) == ("SKIP", None)
    assert V.stellar_locus(spark).first().status == "SKIP"
    none = spark.createDataFrame([], S.ZEROPOINTS)
    assert V.boundary(none).first().status == "SKIP" and V.anchored_difference(none).first().status == "SKIP"


def test_boundary_offset_and_tally(spark):
    rows = [(k, 1, "g", 31.4, 31.4, 0.0) for k in range(5)] + [(k, 1, "g", 31.405, None, None) for k in range(5, 9)]
    t = spark.createDataFrame(rows, S.ZEROPOINTS)
    row = V.boundary(t).first()
    assert row.status == "PASS" and abs(row.boundary_offset_mmag - 5.0) < 1e-6
    counts = {r.status: r.n for r in V.tally([V.boundary(t), V.stellar_locus(spark)]).collect()}
    assert counts == {"PASS": 1, "SKIP": 1}


def test_zones_are_pruned_while_running_and_lose_no_match(spark, tmp_path):
    grid = [(k, (k * 7.31) % 360.0, -89.9 + (k * 3.77) % 179.8) for k in range(900)]
    edges = [(1000 + k, ra, dec) for k, (ra, dec) in enumerate([(0.0, 10.0), (359.99999, 10.0), (2.0, -30.0), (100.0, 89.9999), (280.0, -89.9999), (50.0, 41.0)])]
    rows = [(*r, 3, 18.0, 0.9) for r in grid + edges]
    src = T.pad_columns(spark.createDataFrame(
        rows + [(5000, None, 1.0, 3, 18.0, 0.9)], "objID bigint, raMean double, decMean double, nDetections int, gMeanPSFMag double, gQfPerfect double"), S.PS1)
    path = str(tmp_path / "zones")
    R.write_zones(src, path)
    off = 0.4 / 3600
    stars = spark.createDataFrame([(str(i), ra, dec + (off if dec < 89 else -off)) for i, ra, dec in grid[:30] + edges] + [("x", None, 1.0)],
                                  "objectid string, ra double, dec double")
    from lumitie.operators.skymatch import nearest_within

    near = R.read_zones(spark, path, S.PS1, stars)
    got = {(r.objectid, r.objID) for r in nearest_within(stars, near, "objectid", "objID", right_ra="raMean", right_dec="decMean").collect()}
    assert got == {(str(i), i) for i, _, _ in grid[:30] + edges}
    few = stars.where("objectid in ('0', '1005')")
    found = R.read_zones(spark, path, S.PS1, few)
    assert found.count() < 20 and {r.objID for r in found.collect()} >= {0, 1005}
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
