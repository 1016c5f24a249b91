import random

import pytest

from lumitie.operators import graph as G
from lumitie.operators import normal as N
from lumitie.operators.relational import node_id


@pytest.fixture()
def stars(spark):
    rng = random.Random(5)
    rows = [(s % 3, s, rng.randrange(30), rng.randrange(1, 4), 18.0 + rng.random(), 0.01 + 0.01 * rng.random())
            for s in range(60) for _ in range(rng.randrange(1, 9))]
    return spark.createDataFrame(rows, "healpix_pixel long, objectid long, expnum long, ccdnum int, m_inst double, m_err double").withColumn(
        "node", node_id())


def table(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and a
    assert all(abs(a[k] - b[k]) <= 1e-9 * max(1.0, abs(b[k])) for k in b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_moved_one_by_one(stars):
    """A detection travels with its partners to the task of its node; sums of pairs need no shuffle of their own."""
    text = plan(N.pair_sums(N.star_pairs(stars, parts=11)))
    assert "hashpartitioning(i#" in text
    assert not any("hashpartitioning(i#" in line and ", j#" in line for line in text.splitlines())


def test_pair_sums_equal_brute_force(stars):
    want = {}
    rows = {}
    for r in stars.collect():
        rows.setdefault((r.healpix_pixel, r.objectid), []).append((r.node, r.m_inst, r.m_err ** 2))
    for d in rows.values():
        for k, a in enumerate(sorted(d)):
            for b in sorted(d)[k + 1:]:
                w = 1.0 / (a[2] + b[2])
                old = want.get((a[0], b[0]), (0.0, 0.0, 0))
                want[a[0], b[0]] = old[0] + w, old[1] + w * (a[1] - b[1]), old[2] + 1
    for parts in (None, 11):
        got = {(r.i, r.j): r for r in N.pair_sums(N.star_pairs(stars, parts=parts)).collect()}
        assert got.keys() == want.keys()
        for k, (w, wdm, n) in want.items():
            assert got[k].n == n and abs(got[k].w - w) < 1e-6 and abs(got[k].wdm - wdm) < 1e-6


def test_matrix_from_stars_equals_matrix_from_links(stars):
    links = N.pair_sums(N.star_pairs(stars)).where("i < j")
    close(table(N.star_matrix(stars)), table(N.matrix_entries(links)))


def test_right_hand_side_needs_no_pairs(stars):
    links = N.pair_sums(N.star_pairs(stars)).where("i < j")
    sums = N.star_sums(stars)
    close(table(sums.select("i", "rhs")), table(N.right_hand_side(links)))
    assert "posexplode" not in plan(sums)


def test_counts_need_no_pairs(stars):
    sums = N.pair_sums(N.star_pairs(stars)).selectExpr(
        "sum(opened) AS n_stars", "sum(n) AS n_pairs", "sum(CASE WHEN i = j THEN n ELSE 0 END) AS n_self").first()
    counts = N.pair_counts(stars)
    assert counts.first() == sums and sums.n_self > 0
    assert "posexplode" not in plan(counts)


def test_edges_are_not_moved_one_by_one(stars):
    text = plan(G.overlap_edges(G.star_nodes(stars), parts=11))
    assert "hashpartitioning(src#" in text
    assert not any("hashpartitioning(src#" in line and ", dst#" in line for line in text.splitlines())


def test_exposure_overlaps_equal_brute_force(spark, stars):
    """Positions are joined to exposures of stars, not to pairs; an exposure without a position gives null."""
    positions = spark.createDataFrame([(e, 50.0 + 0.3 * e) for e in range(0, 29)], "expnum long, exp_ra double")
    seen = {}
    for r in stars.collect():
        seen.setdefault(r.objectid, set()).add(r.expnum)
    want = {}
    for exps in seen.values():
        for a in exps:
            for b in exps:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    out = G.exposure_overlaps(stars, positions)
    got = {(r.exp1, r.exp2): r for r in out.collect()}
    assert {k: r.n_shared for k, r in got.items()} == want
    for (a, b), r in got.items():
        assert (r.dra is None) == (29 in (a, b)) and (r.dra is None or abs(r.dra - 0.3 * (b - a)) < 1e-9)
    assert not any("exp2#" in line and "Exchange" in line for line in plan(out).splitlines())
