import numpy as np
import pytest

from lumitie.operators import graph as G

DET = "healpix_pixel bigint, objectid string, expnum bigint, ccdnum int"


def dets(spark, stars):
    """stars: id -> list of (expnum, ccd)."""
    rows = [(1, s, e, c) for s, nodes in stars.items() for e, c in nodes]
    return spark.createDataFrame(rows, DET)


# Seven stars on nine nodes in three components of 5, 2 and 2.
NINE = {"s1": [(1, 1), (2, 1)], "s2": [(2, 1), (3, 1)], "s3": [(3, 1), (4, 1), (5, 1)], "s4": [(1, 1), (5, 1)],
        "s5": [(10, 1), (11, 1)], "s6": [(20, 2), (21, 2)], "s7": [(20, 2), (21, 2)]}


def build(spark, stage, stars, anchor_exps):
    d = dets(spark, stars)
    mem = G.star_nodes(d)
    comps = G.connected_components(G.spanning_edges(mem), stage)
    anchors = spark.createDataFrame([(e,) for e in anchor_exps], "expnum bigint")
    marked = G.select_component(comps, anchors)
    return d, mem, marked


def test_nine_nodes_three_components(spark, stage):
    d, mem, marked = build(spark, stage, NINE, [1, 2, 3, 4, 5])
    rep = G.connectivity_report(d, marked, G.overlap_edges(mem)).first()
    assert (rep.n_nodes_total, rep.n_components, rep.n_nodes_connected, rep.n_nodes_dropped,
            rep.n_anchor_nodes) == (9, 3, 5, 4, 5)
    assert rep.n_stars == 7 and rep.largest_component == 5


def test_anchor_in_a_small_component_selects_it(spark, stage):
    _, _, marked = build(spark, stage, NINE, [20])
    kept = {(r.expnum, r.ccdnum) for r in marked.where("connected").collect()}
    assert kept == {(20, 2), (21, 2)}


def test_largest_anchored_component_wins(spark, stage):
    _, _, marked = build(spark, stage, NINE, [1, 20])
    assert marked.where("connected").count() == 5


def test_without_anchors_everything_is_kept(spark, stage):
    _, _, marked = build(spark, stage, NINE, [])
    assert marked.where("connected").count() == 9 and marked.where("NOT connected").count() == 0


def test_one_edge_shared_by_three_stars(spark):
    d = dets(spark, {s: [(1, 1), (2, 1)] for s in "abc"})
    st = G.edge_stats(G.overlap_edges(G.star_nodes(d))).first()
    assert (st.n_edges, st.edge_stars_min, st.edge_stars_median, st.edge_stars_max) == (1, 3, 3, 3)
    assert st.edge_stars_mean == 3.0


def test_repeats_on_one_node_make_no_edge(spark):
    d = dets(spark, {"a": [(1, 1), (1, 1)]})
    assert G.star_nodes(d).count() == 0


def test_edge_stats_without_edges(spark):
    st = G.edge_stats(G.overlap_edges(G.star_nodes(dets(spark, {"a": [(1, 1)]})))).first()
    assert (st.n_edges, st.edge_stars_min, st.edge_stars_median, st.edge_stars_mean) == (0, 0, 0, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, stage, seed):
    rng = np.random.default_rng(seed)
    n = 300
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (220, 2)) if a != b]
    edges += [(k, k + 1) for k in range(400, 520)]          # a long chain
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges for x in e}
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in G.connected_components(df, stage).collect()}
    assert got == want
