from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.relational import node_columns, node_id

STAR = "healpix_pixel bigint, objectid string, expnum bigint, ccdnum int, m_inst double, m_err double"


def synthetic(spark, n_nodes=200, n_stars=2000, seed=7, noise=0.005, anchored=60):
    """Stars on random neighbouring nodes with known zero-points; returns frames and truth."""
    rng = np.random.default_rng(seed)
    nodes = [(100 + k // 10, 1 + k % 10) for k in range(n_nodes)]
    truth = 31.4 + rng.normal(0, 0.05, n_nodes)
    rows = []
    for s in range(n_stars):
        mag, start = rng.uniform(17, 20), rng.integers(0, n_nodes)
        for k in (start + rng.choice(40, rng.integers(3, 10), replace=False)) % n_nodes:
            rows.append((1, f"s{s}", *nodes[k], float(mag - truth[k] + rng.normal(0, noise)), noise))
    stars = spark.createDataFrame(rows, STAR)
    nd = spark.createDataFrame(nodes, "expnum bigint, ccdnum int")
    anchors = spark.createDataFrame([(*nodes[k], float(truth[k])) for k in range(anchored)] + [(9999, 1, 31.0)],
                                    "expnum bigint, ccdnum int, zp_fgcm double")
    return stars, nd, anchors, dict(zip(nodes, truth)), rows


def errors(zp, truth):
    got = {(r.expnum, r.ccdnum): r.zp_solved for r in zp.collect()}
    return np.array([got[k] - truth[k] for k in truth])


def test_two_node_system(spark):
    d = spark.createDataFrame([(1, "a", 1, 1, 18.0, 0.01), (1, "a", 2, 1, 18.1, 0.01)], STAR).withColumn(
        "node", F.col("expnum"))
    links = N.pair_sums(N.star_pairs(d))
    m = {(r.i, r.j): r.v for r in N.matrix_entries(links).collect()}
    assert m == pytest.approx({(1, 1): 5000.0, (2, 2): 5000.0, (1, 2): -5000.0, (2, 1): -5000.0})
    rhs = {r.i: r.rhs for r in N.right_hand_side(links).collect()}
    assert rhs == pytest.approx({1: 500.0, 2: -500.0})      # -w dm and +w dm with dm = -0.1


def test_matrix_is_a_symmetric_laplacian(spark):
    stars, *_ = synthetic(spark, 60, 300)
    links = N.pair_sums(N.star_pairs(stars.withColumn("node", node_id()))).where("i < j")
    m = N.matrix_entries(links)
    t = m.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("t"))
    assert m.join(t, ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("t")))).first()[0] < 1e-10
    assert m.groupBy("i").agg(F.sum("v").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-6


def dense(rows, nodes):
    idx = {n: k for k, n in enumerate(nodes)}
    a, b = np.zeros((len(nodes),) * 2), np.zeros(len(nodes))
    stars = {}
    for _, s, e, c, m, err in rows:
        stars.setdefault(s, []).append((idx[(e, c)], m, err))
    for obs in stars.values():
        for p in range(len(obs)):
            for q in range(p + 1, len(obs)):
                (i, mi, ei), (j, mj, ej) = obs[p], obs[q]
                w, dm = 1 / (ei * ei + ej * ej), mi - mj
                a[i, i] += w; a[j, j] += w; a[i, j] -= w; a[j, i] -= w  # noqa: E702
                b[i] -= w * dm; b[j] += w * dm  # noqa: E702
    return a, b


def test_solution_matches_dense_algebra(spark, stage):
    stars, nd, anchors, truth, rows = synthetic(spark, 80, 400, seed=3, anchored=20)
    cfg = replace(Config(), solve=replace(Config().solve, tolerance=1e-10))
    a, b = dense(rows, list(truth))
    anchored = a + np.diag([1e6 if k < 20 else 0.0 for k in range(80)])
    want = np.linalg.solve(anchored, b + 1e6 * np.array([t if k < 20 else 0.0 for k, t in enumerate(truth.values())]))
    system = N.accumulate(stars, nd, stage)
    zp, info = V.solve_anchored(system, nd, anchors, cfg, stage)
    got = errors(zp, dict(zip(truth, want)))
    assert info.converged and np.abs(got).max() < 1e-6
    assert info.relative_residual < 1e-9
    assert np.abs(errors(zp, truth)[:20]).max() * 1000 < 2.0        # anchors hold their values
    zp, _ = V.solve_unanchored(system, nd, anchors, cfg, stage)
    want = np.linalg.pinv(a) @ b
    want -= np.median(want[:20] - np.array(list(truth.values()))[:20])
    assert np.abs(errors(zp, dict(zip(truth, want)))).max() < 1e-6


def test_recovery_below_one_mmag(spark, stage):
    stars, nd, anchors, truth, _ = synthetic(spark)
    system = N.accumulate(stars, nd, stage)
    zp, info = V.solve_unanchored(system, nd, anchors, Config(), stage)
    e = errors(zp, truth)
    assert info.converged and np.std(e) * 1000 < 1.0
    zp, info = V.solve_anchored(system, nd, anchors, Config(), stage)
    e = errors(zp, truth)
    assert info.converged and np.std(e) * 1000 < 1.0


def test_strengths_too_long_together_are_solved_in_turn(spark, stage, monkeypatch):
    """No task gets more numbers at once than fixed, and every strength ends as in a recurrence shared by all."""
    stars, nd, anchors, truth, _ = synthetic(spark, 60, 300, anchored=20)
    zpterm = nd.withColumn("zpterm", F.lit(0.01) * F.col("ccdnum"))
    system, strengths = N.accumulate(stars, nd, stage), (10 ** 6, 10 ** 7, 10 ** 8)
    def sweep():
        return V.solve_with_priors(system, nd, anchors, zpterm, strengths, 31.4, None, Config(), stage)
    whole, vector, sent = sweep(), V._vector, []
    monkeypatch.setattr(V, "TOGETHER_VALUES", 130, raising=False)
    monkeypatch.setattr(V, "_vector", lambda vec, columns: sent.append(len(columns)) or vector(vec, columns))
    parts = sweep()
    assert max(sent) == 2 and list(parts) == list(whole) == list(strengths)
    for lam in strengths:
        (zp, info), (alone, same) = whole[lam], parts[lam]
        assert (info.iterations, info.converged, info.mode) == (same.iterations, same.converged, same.mode)
        assert np.abs(errors(alone, truth) - errors(zp, truth)).max() < 1e-9


def test_empty_nodes_keep_their_documented_values(spark, stage):
    stars, nd, anchors, truth, _ = synthetic(spark, 60, 300, anchored=20)
    extra = nd.unionByName(spark.createDataFrame([(9999, 1), (9998, 1)], "expnum bigint, ccdnum int"))
    system = N.accumulate(stars, extra, stage)
    zp = {(r.expnum, r.ccdnum): r.zp_solved for r in V.solve_anchored(system, extra, anchors, Config(), stage)[0].collect()}
    assert zp[(9999, 1)] == pytest.approx(31.0, abs=1e-3) and zp[(9998, 1)] == 0.0
    zp, info = V.solve_unanchored(system, extra, anchors, Config(), stage)
    zp = {(r.expnum, r.ccdnum): r.zp_solved for r in zp.collect()}
    assert zp[(9998, 1)] == pytest.approx(-info.offset)


def test_counts_include_repeats_on_one_node(spark, stage):
    d = spark.createDataFrame([(1, "a", 1, 1, 18.0, 0.01), (1, "a", 1, 1, 18.2, 0.01), (1, "a", 2, 1, 18.1, 0.01),
                               (2, "a", 3, 1, 18.0, 0.01), (1, "b", 1, 1, 18.0, 0.01)], STAR)
    nodes = d.select("expnum", "ccdnum").distinct()
    s = N.accumulate(d, nodes, stage)
    assert (s.n_pairs, s.n_self, s.n_stars) == (3, 1, 1)      # pixel 2 holds a single row


def test_uncapped_star_stops_the_job(spark):
    d = spark.range(150).selectExpr("1L AS healpix_pixel", "'a' AS objectid", "id AS node", "18.0D AS m_inst", "0.01D AS m_err")
    with pytest.raises(Exception, match="cap"):
        N.star_pairs(d).count()


def test_exposure_regulariser_is_the_projection(spark):
    nodes = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1)], "expnum bigint, ccdnum int")
    m = {(r.i, r.j): r.v for r in N.matrix_entries(N.exposure_links(nodes, 5.0)).collect()}
    ids = [7 * 1024 + c for c in (1, 2, 3)]
    want = 5.0 * (np.eye(3) - 1 / 3)
    assert m == pytest.approx({(i, j): want[a, b] for a, i in enumerate(ids) for b, j in enumerate(ids)})


def test_consecutive_exposures_across_chunks(spark):
    edge = 32.0 * 1750
    t = [edge - 0.03, edge - 0.01, edge - 0.001, edge + 0.005, edge + 0.5, edge + 0.51]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(t)], "expnum bigint, mjd double")
    got = sorted((r.expnum, r.next_expnum) for r in N.consecutive_exposures(df).collect())
    want = [(k, k + 1) for k in range(5) if t[k + 1] - t[k] < 0.02]
    assert got == want


def test_smoothness_pulls_neighbours_together(spark, stage):
    stars, nd, anchors, truth, _ = synthetic(spark, 100, 500, anchored=30)
    exps = nd.select("expnum").distinct()
    mjd = exps.withColumn("mjd", F.lit(56000.0) + F.col("expnum") * 0.001)
    flat = spark.createDataFrame([], "ccdnum int, epoch_idx int, flat_correction double")
    cfg = Config()
    system = N.accumulate_gray(stars, exps, mjd, flat, cfg.starflat.epoch_boundaries.all_ccds, stage)
    def spread(sigma):
        c = replace(cfg, starflat=replace(cfg.starflat, gray_smooth_sigma=sigma))
        _, gray, info = V.solve_gray(system, nd, anchors, flat, mjd, c, stage)
        assert info.converged
        return gray.agg(F.stddev("gray")).first()[0]
    free = spread(0.0)
    assert spread(0.0001) < free / 2


def test_gray_recovers_exposure_terms(spark, stage):
    """Zero-points made of exposure + detector terms come back from the two-step solve."""
    rng = np.random.default_rng(5)
    gray, flat = 31.4 + rng.normal(0, 0.05, 20), rng.normal(0, 0.01, 10)
    rows = []
    for s in range(1500):
        mag = rng.uniform(17, 20)
        for e in rng.choice(20, 5, replace=False):
            c = rng.integers(0, 10)
            rows.append((1, f"s{s}", int(e), int(c), float(mag - gray[e] - flat[c] + rng.normal(0, 0.003)), 0.003))
    stars = spark.createDataFrame(rows, STAR)
    nodes = spark.createDataFrame([(e, c) for e in range(20) for c in range(10)], "expnum bigint, ccdnum int")
    anchors = spark.createDataFrame([(e, c, float(gray[e] + flat[c])) for e in range(5) for c in range(10)],
                                    "expnum bigint, ccdnum int, zp_fgcm double")
    mjd = spark.createDataFrame([(e, 56000.0 + e) for e in range(20)], "expnum bigint, mjd double")
    table = spark.createDataFrame([(c, 0, float(flat[c])) for c in range(10)], "ccdnum int, epoch_idx int, flat_correction double")
    bounds = Config().starflat.epoch_boundaries.all_ccds
    system = N.accumulate_gray(stars, nodes.select("expnum").distinct(), mjd, table, bounds, stage)
    assert system.n_self == 0
    zp, _, info = V.solve_gray(system, nodes, anchors, table, mjd, Config(), stage)
    e = errors(zp, {(a, b): gray[a] + flat[b] for a in range(20) for b in range(10)})
    assert info.converged and np.std(e) * 1000 < 1.0


def test_node_columns_of_solution(spark):
    df = spark.range(1).select(F.lit(123 * 1024 + 45).cast("long").alias("i")).select(*node_columns("i"))
    assert tuple(df.first()) == (123, 45)
