"""Products formed star by star, and rounds of the rejection loop that flag nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_solver import dense, synthetic

from lumitie.config import Config
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.relational import node_id
from lumitie.plans import outliers as O


def test_a_system_keeps_detections_and_no_pairs(spark, stage):
    stars, nodes, _, truth, rows = synthetic(spark, 60, 300)
    system = N.accumulate(stars, nodes, stage)
    assert system.stars.count() == system.n_stars == 300
    assert system.stars.agg(F.sum(F.size("k"))).first()[0] == len(rows) < system.n_pairs
    a, b = dense(rows, list(truth))
    place = {e * 1024 + c: k for k, (e, c) in enumerate(truth)}
    x = np.random.default_rng(2).normal(0, 1, len(truth))
    with V.assembled(system) as (held, vec):
        assert "posexplode" not in held._jdf.queryExecution().toString()
        got = {r.i: (r.d, r.b) for r in vec.collect()}
        one = vec.join(spark.createDataFrame([(i, float(x[k])) for i, k in place.items()], "i long, x double"), "i")
        out = {r.i: r.y for r in V._times_matrix(held, one, "x", "y").collect()}
    for i, k in place.items():
        assert got[i] == pytest.approx((a[k, k], b[k]), rel=1e-9, abs=1e-6)
        assert out[i] == pytest.approx(a[k] @ x, rel=1e-9, abs=1e-6)


def test_links_beside_stars_and_repeats_on_a_node(spark, stage):
    """A link counts like a pair; two detections of a star on one node give nothing between them."""
    d = spark.createDataFrame([(1, "a", 1, 1, 18.0, 0.01), (1, "a", 1, 1, 18.2, 0.01), (1, "a", 2, 1, 18.1, 0.01)],
                              "healpix_pixel bigint, objectid string, expnum bigint, ccdnum int, m_inst double, m_err double")
    system = N.accumulate(d, d.select("expnum", "ccdnum").distinct(), stage)
    extra = d.select("expnum", "ccdnum").distinct().agg(F.min(node_id()).alias("i"), F.max(node_id()).alias("j"), F.lit(7.0).alias("w"), F.lit(3.5).alias("wdm"))
    with V.assembled(system, (), [extra], 0.5) as (_, vec):
        got = {r.i: (r.d, r.b) for r in vec.collect()}
    assert got[1025] == pytest.approx((10007.5, -3.5), abs=1e-6) and got[2049] == pytest.approx((10007.5, 3.5), abs=1e-6)


def test_a_system_too_large_for_arrays_goes_by_links(spark, stage, monkeypatch):
    stars, nodes, anchors, truth, _ = synthetic(spark, 60, 300, anchored=20)
    system = N.accumulate(stars, nodes, stage)
    want = {tuple(r)[:2]: r[2] for r in V.solve_anchored(system, nodes, anchors, Config(), stage)[0].collect()}
    monkeypatch.setattr(V, "PACKED_VALUES", 10)
    got = {tuple(r)[:2]: r[2] for r in V.solve_anchored(system, nodes, anchors, Config(), stage)[0].collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_a_round_without_flags_builds_no_system_again(spark, stage, monkeypatch):
    stars, nodes, anchors, *_ = synthetic(spark, 60, 300, anchored=20)
    wild = [(1, "wild", 100, 1, 18.0, 0.005), (1, "wild", 100, 2, 19.0, 0.005)]     # a star without a clean detection
    stars = stars.unionByName(spark.createDataFrame(wild, stars.schema))
    mjd = nodes.select("expnum").distinct().selectExpr("expnum", "56000.0D + expnum AS mjd")
    made, real = [], N.accumulate
    monkeypatch.setattr(N, "accumulate", lambda *a, **k: made.append(1) or real(*a, **k))
    state = O.reject(stars, nodes, anchors, mjd, Config(), stage)
    quiet = [s for s in state.stats[1:] if s.n_outlier_dets + s.n_stars_flagged + s.n_exposures_flagged + s.n_nodes_flagged == 0]
    assert len(quiet) == 1 and len(made) == len(state.stats)    # the first system and one for each round but the last
    assert state.stats[-1].rms_before_mmag == state.stats[-1].rms_after_mmag
