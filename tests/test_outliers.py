import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.operators.relational import remove_flagged
from lumitie.plans import outliers as O

STAR = "healpix_pixel bigint, objectid string, expnum bigint, ccdnum int, m_inst double, m_err double"


def test_residuals_vanish_for_perfect_zeropoints(spark):
    zp = {(e, 1): 31.0 + 0.1 * e for e in range(5)}
    rows = [(1, f"s{s}", e, 1, 18.0 + s - z, 0.01 + 0.001 * e) for s in range(4) for (e, _), z in zp.items()]
    z = spark.createDataFrame([(*k, v) for k, v in zp.items()], "expnum bigint, ccdnum int, zp_solved double")
    r = O.residuals(spark.createDataFrame(rows, STAR), z)
    assert r.agg(F.max(F.abs("residual"))).first()[0] < 1e-10
    assert {x.n_det for x in r.collect()} == {5}


def resid(spark, rows):
    return spark.createDataFrame(rows, "objectid string, expnum bigint, ccdnum int, residual double, m_err double")


def test_outlier_rule_scales_with_the_error(spark):
    r = resid(spark, [("a", 1, 1, 0.025, 0.01), ("a", 2, 1, 0.025, 0.004)])
    assert [x.expnum for x in r.where(O.is_outlier(5.0)).collect()] == [2]


def test_variable_star_and_unusable_star(spark):
    calm = [("calm", e, 1, 0.005, 0.01) for e in range(5)]
    wild = [("wild", e, 1, 0.1 * (-1) ** e, 0.01) for e in range(5)]
    r = resid(spark, calm + wild + [("one", 1, 1, 9.0, 0.01)])
    assert [x.objectid for x in O.variable_stars(r, 3.0).collect()] == ["wild"]
    assert [x.objectid for x in O.unusable_stars(r, 3.0, 4.0).collect()] == ["wild"]
    assert O.unusable_stars(r, 3.0, 50.0).count() == 0          # all rows still clean


def test_bad_exposure_of_a_night(spark):
    zp = spark.createDataFrame([(e, c, 25.01 + 0.001 * c) for e in range(4) for c in (1, 2, 3)]
                               + [(4, c, 25.5) for c in (1, 2, 3)], "expnum bigint, ccdnum int, zp_solved double")
    mjd = spark.createDataFrame([(e, 56000.1 + 0.01 * e) for e in range(5)], "expnum bigint, mjd double")
    assert [r.expnum for r in O.bad_exposures(zp, mjd, 0.3).collect()] == [4]


def test_bad_ccd_by_scatter(spark):
    rng = np.random.default_rng(1)
    rows = [("s", 1, c, float(rng.normal(0, 0.1 if c == 11 else 0.005)), 0.01) for c in range(1, 12) for _ in range(20)]
    assert [r.ccdnum for r in O.bad_ccds(resid(spark, rows)).collect()] == [11]


def test_flags_remove_rows_then_lonely_stars(spark):
    rows = [(1, s, e, 1, 18.0, 0.01) for s in ("a", "b", "c") for e in (1, 2, 3)]
    d = spark.createDataFrame(rows, STAR)
    stars = spark.createDataFrame([("a",)], "objectid string")
    dets = spark.createDataFrame([("b", 1, 1), ("b", 2, 1)], "objectid string, expnum bigint, ccdnum int")
    exps = spark.createDataFrame([(3,)], "expnum bigint")
    out = remove_flagged(d, stars, dets, exps, None)
    assert {(r.objectid, r.expnum) for r in out.collect()} == {("c", 1), ("c", 2)}


def test_star_flat_median_and_minimum(spark):
    zp = spark.createDataFrame([(e, c, 31.0 + e + 0.01 * (c - 2)) for e in range(3) for c in (1, 2, 3)]
                               + [(9, 1, 50.0), (9, 7, 50.5)], "expnum bigint, ccdnum int, zp_solved double")
    mjd = spark.createDataFrame([(e, 56000.0) for e in (0, 1, 2, 9)], "expnum bigint, mjd double")
    flat = {r.ccdnum: r.flat_correction for r in O.star_flat(zp, mjd, (56404,)).collect()}
    assert flat[2] == pytest.approx(0.0) and flat[3] == pytest.approx(0.01) and flat[7] == 0.0


def test_rejection_loop_improves_and_finds_outliers(spark, stage):
    rng = np.random.default_rng(2)
    nodes = [(e, c) for e in range(15) for c in range(4)]
    truth = {n: 31.4 + rng.normal(0, 0.03) for n in nodes}
    bad, rows = set(), []
    for s in range(400):
        mag = rng.uniform(17, 20)
        for k in rng.choice(60, 8, replace=False):
            hit = rng.random() < 0.03
            if hit:
                bad.add((f"s{s}", *nodes[k]))
            rows.append((1, f"s{s}", *nodes[k], float(mag - truth[nodes[k]] + rng.normal(0, 0.005) + 0.2 * hit), 0.005))
    d = spark.createDataFrame(rows, STAR)
    nd = spark.createDataFrame(nodes, "expnum bigint, ccdnum int")
    anchors = spark.createDataFrame([(*n, float(truth[n])) for n in nodes[:12]], "expnum bigint, ccdnum int, zp_fgcm double")
    mjd = spark.createDataFrame([(e, 56000.0 + e) for e in range(15)], "expnum bigint, mjd double")
    state = O.reject(d, nd, anchors, mjd, Config(), stage)
    assert state.stats[-1].rms_after_mmag < 0.5 * state.stats[0].rms_before_mmag
    found = {tuple(r) for r in state.flagged_detections.collect()}
    assert len(found & bad) > 0.5 * len(bad)
    state = O.final_solutions(state, nd, anchors, mjd, "g", Config(), stage)
    err = {(r.expnum, r.ccdnum): r.zp_solved - truth[(r.expnum, r.ccdnum)] for r in state.table["anchored"].collect()}
    assert np.std(list(err.values())) * 1000 < 2.0
    assert state.table["unanchored"].count() == 60 and state.info["gray"].converged
