"""Statistics of a few large groups leave the rows where they are; nodes meet once; components over one edge of each node."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumitie.operators import graph as G
from lumitie.operators import robust as Q
from lumitie.plans import diagnostics as D
from lumitie.plans import starflat as SF


@pytest.fixture()
def unknown_sizes(spark):
    """No table counts as small, as with tables that come out of an aggregation over large inputs."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [(), ("ccdnum",)])
def test_quantiles_of_few_groups_do_not_deal_the_rows_by_group(spark, unknown_sizes, keys):
    rng = random.Random(3)
    data = [(k % 3, rng.random()) for k in range(400)]
    df = spark.createDataFrame(data, "ccdnum int, v double")
    out = Q.quantiles(df, "v", {"m": 0.5}, keys, few=bool(keys), small=10, accuracy=1000)
    assert "BroadcastExchange" in plan(out) and "SortMergeJoin" not in plan(out) and "CartesianProduct" not in plan(out)
    got = {r["ccdnum"] if keys else 0: r.m for r in out.collect()}
    want = {k: statistics.median(v for c, v in data if not keys or c == k) for k in ((0, 1, 2) if keys else (0,))}
    assert got == pytest.approx(want)


def test_clipping_joins_no_rows_by_detector_and_epoch(spark, unknown_sizes):
    rows = [(c, e, 0.001 * ((k * 37) % 101 - 50) + (5.0 if k == 7 else 0.0)) for c in (1, 2) for e in (0, 1) for k in range(101)]
    out = SF.clipped(spark.createDataFrame(rows, "ccdnum int, epoch int, residual double"))
    assert "SortMergeJoin" not in plan(out) and out.count() == 4 * 100


def test_rows_of_a_node_meet_once(spark, unknown_sizes):
    rng = random.Random(4)
    data = [(rng.randrange(4), rng.randrange(3), 0.9 + rng.random(), rng.random()) for _ in range(200)]
    rows = spark.createDataFrame(data, "expnum long, ccdnum int, fwhm double, ac double")
    positions = spark.createDataFrame([(e, c, 50.0 + e) for e in range(4) for c in range(3)], "expnum long, ccdnum int, ra_mean double")
    out = D.correction_by_node(rows, positions)
    assert plan(out).count("Exchange hashpartitioning") <= 2       # the rows, and the positions
    for r in out.collect():
        mine = [(f, a) for e, c, f, a in data if (e, c) == (r.expnum, r.ccdnum)]
        assert r.n_det == len(mine) and r.ra == 50.0 + r.expnum
        assert r.median_fwhm == pytest.approx(statistics.median(f for f, _ in mine)) and r.mean_ac == pytest.approx(statistics.mean(a for _, a in mine))


def test_components_over_one_edge_of_each_node(spark, stage, monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(0, 60), rng.randrange(0, 60)) for _ in range(55)] + [(9, 100 + k) for k in range(4)] + [(5, 100 + k) for k in range(4)]
    edges += [(70, 71), (72, 71), (72, 75), (200, 201)] + [(3, 59 - k) for k in range(20)] * 5
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    sizes, real = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda e, s: sizes.append(e.count()) or real(e, s))
    got = {r.node: r.component for r in G.spanned_components(spark.createDataFrame(edges, "u long, v long"), stage).collect()}
    assert got == {n: find(n) for n in root}
    assert sizes[0] < len(root) < len(edges)


def test_a_node_that_is_nobodys_smallest_neighbour(spark, stage):
    """Node 9 has larger neighbours only, each of which has a smaller one than 9."""
    edges = [(9, 100), (9, 101), (5, 100), (5, 101)]
    got = {r.node: r.component for r in G.spanned_components(spark.createDataFrame(edges, "u long, v long"), stage).collect()}
    assert got == {5: 5, 9: 5, 100: 5, 101: 5}
