"""What-if solves from stored sums, against pairing again; arrival order; several systems in one recurrence."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_solver import synthetic

from lumitie.config import Config
from lumitie.operators import normal as N
from lumitie.operators import relational as R
from lumitie.operators import solver as V
from lumitie.plans import whatif as WI
from lumitie.sources import tables as T


def close(a, b, tol=1e-6):
    """Same node pairs with the same sums; pairs without weight do not count."""
    x = {(r.i, r.j): (r.w, r.wdm) for r in a.collect()}
    y = {(r.i, r.j): (r.w, r.wdm) for r in b.collect()}
    assert x.keys() == y.keys() and len(x) > 10
    for k in x:
        assert x[k] == pytest.approx(y[k], rel=1e-9, abs=tol)


def test_sub_system_equals_pairing_again(spark, stage):
    stars, nodes, *_ = synthetic(spark, 80, 500)
    whole = N.accumulate(stars, nodes, stage)
    keep = nodes.where("expnum % 3 <> 0")
    sub = N.sub_system(whole, keep.select(R.node_id().alias("i")), stage)
    again = N.accumulate(stars.join(keep, ["expnum", "ccdnum"], "left_semi"), keep, stage)
    close(sub.links, again.links)
    assert sub.n_pairs == again.n_pairs and sub.n_self == again.n_self
    assert sorted(r.i for r in sub.unknowns.collect()) == sorted(r.i for r in again.unknowns.collect())


def test_gray_system_equals_pairing_with_the_flat(spark, stage):
    stars, nodes, *_ = synthetic(spark, 80, 500)
    mjds = nodes.select("expnum").distinct().where("expnum <> 103").selectExpr("expnum", "56390.0D + expnum - 100 + 4*(expnum - 100) AS mjd")
    flat = spark.createDataFrame([(c, e, 0.01 * c - 0.02 * e) for c in range(1, 9) for e in range(2)], "ccdnum int, epoch_idx int, flat_correction double")
    system = N.accumulate(stars, nodes, stage)
    mine = N.gray_system(system, flat, mjds, WI.FLAT_BOUNDARY, stage)
    again = N.accumulate_gray(stars, nodes.select("expnum").distinct(), mjds, flat, WI.FLAT_BOUNDARY, stage)
    close(mine.links, again.links)
    assert mine.unknowns.count() == again.unknowns.count()


def test_corrected_system_equals_pairing_of_corrected_magnitudes(spark, stage):
    stars, nodes, *_ = synthetic(spark, 60, 300)
    rows = stars.withColumn("fwhm", 0.8 + (F.xxhash64("objectid", "expnum", "ccdnum") % 100) / 90.0)
    coeffs = [0.3, -0.2, 0.05, 7.0]
    system = WI.aperture_system(rows, nodes, Config(), stage)
    fixed = rows.where("fwhm > 0.5 and fwhm < 3.0").withColumn("m_inst", F.col("m_inst") - (0.3 * F.col("fwhm") ** 3 - 0.2 * F.col("fwhm") ** 2 + 0.05 * F.col("fwhm") + 7.0))
    close(N.corrected(system, WI.centred(coeffs)).links, N.accumulate(fixed, nodes, stage).links)


def chain(spark, n=64):
    """A chain whose links weigh from 1 to 100 along it, held at one end: a correction moves one node a step."""
    w = [100.0 ** (k / n) for k in range(n - 1)]
    links = [(k, k + 1, w[k]) for k in range(n - 1)] + [(k + 1, k, w[k]) for k in range(n - 1)]
    a = np.zeros((n, n))
    for i, j, x in links:
        a[i, i] += x
        a[i, j] -= x
    a[0, 0] += 1.0
    return spark.createDataFrame(links, "i long, j long, w double"), a, np.random.default_rng(1).normal(0, 1, n)


def test_preconditioner_needs_fewer_steps_on_a_long_chain(spark, stage):
    links, a, b = chain(spark)
    vec = stage.write(spark.createDataFrame([(k, float(a[k, k]), float(b[k])) for k in range(len(b))], "i long, d double, b double"), "vec")
    want = np.linalg.solve(a, b)
    steps = {}
    for pre in (False, True):
        x, info = V.conjugate_gradient(links, vec, stage, 1e-7, 2000, precondition=pre)
        got = np.array([r.x for r in x.orderBy("i").collect()])
        assert info.converged and info.relative_residual <= 2e-7 and np.abs(got - want).max() < 1e-4
        steps[pre] = info.iterations
    assert steps[False] > 100 and steps[True] < 0.7 * steps[False], steps


def test_several_systems_in_one_recurrence_and_a_warm_start(spark, stage):
    links, a, b = chain(spark, 24)
    shift = [0.0, 5.0, 1e4]
    rows = [(k, *[v for s in shift for v in (float(a[k, k] + s), float(b[k] + s * k))]) for k in range(len(b))]
    vec = stage.write(spark.createDataFrame(rows, "i long, " + ", ".join(f"d_{k} double, b_{k} double" for k in range(3))), "vec")
    x, infos = V.conjugate_gradient(links, vec, stage, 1e-10, tags=("_0", "_1", "_2"))
    x = stage.write(x, "x")
    for k, s in enumerate(shift):
        got = np.array([r[0] for r in x.orderBy("i").select(f"x_{k}").collect()])
        assert np.abs(got - np.linalg.solve(a + s * np.eye(len(b)), b + s * np.arange(len(b)))).max() < 1e-4
        assert infos[f"_{k}"].converged
    _, again = V.conjugate_gradient(links, vec, stage, 1e-8, tags=("_0", "_1", "_2"), start=x)
    assert all(i.iterations == 0 and i.converged for i in again.values())


def test_a_vector_in_blocks_leaves_the_links_where_they_are(spark, stage, monkeypatch):
    """A long vector is cut into blocks; one iteration moves the vector and its sums, never the links or rows for each of them."""
    links, a, b = chain(spark, 12)
    vec = stage.write(spark.createDataFrame([(k, float(a[k, k]), float(b[k])) for k in range(len(b))], "i long, d double, b double"), "vec")
    for limit in (V.BROADCAST_VALUES, 0):
        monkeypatch.setattr(V, "BROADCAST_VALUES", limit)
        with V.shuffle_partitions(spark, 8):
            held = V._hold(links, len(b), 8).persist()
            held.count()
            one = V._times_matrix(held, vec.withColumn("u", F.col("b")), "u", "w")
            plan = one._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
            got = np.array([r.w for r in one.orderBy("i").collect()])
            held.unpersist()
        assert np.abs(got - a @ b).max() < 1e-9
        steps = plan.splitlines()
        join = max(k for k, line in enumerate(steps) if "Join" in line)
        assert not any("Exchange hashpartitioning" in line for line in steps[join:]), plan
    x, info = V.conjugate_gradient(links, vec, stage, 1e-6)
    assert info.converged and np.abs(np.array([r.x for r in x.orderBy("i").collect()]) - np.linalg.solve(a, b)).max() < 1e-3


def test_zero_right_hand_side(spark, stage):
    vec = spark.createDataFrame([(1, 2.0, 0.0), (2, 2.0, 0.0)], "i long, d double, b double")
    links = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    x, info = V.conjugate_gradient(links, vec, stage)
    assert info.converged and info.iterations == 0 and info.relative_residual == 0.0 and {r.x for r in x.collect()} == {0.0}


def test_arrival_order_does_not_depend_on_the_division(spark, tmp_path):
    rows = [(k % 7 if k % 3 else 0, k) for k in range(500)]
    spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(str(tmp_path / "one"))
    got = []
    for split in ("1m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            scan = T.with_arrival(spark.read.parquet(str(tmp_path / "one")))
            numbered = R.arrival_index(scan.repartition(5), ["k"], chunk_rows=37)
            got.append(sorted((r.k, r.arrival, r.v) for r in numbered.collect()))
            first = sorted((r.k, r.v) for r in R.cap_arrivals(scan.repartition(3), 4, ["k"]).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1]
    for k in range(7):
        mine = [v for key, v in rows if key == k]
        assert [v for key, _, v in got[0] if key == k] == mine and [v for key, v in first if key == k] == mine[:4]
