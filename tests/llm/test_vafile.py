"""Clustering against plain arithmetic with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lumitie.llm import vafile
from lumitie.sources.stage import Stage


def brute(rows):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) per vector, by the definition alone."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i4").tobytes()))[:40]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(5):
        own = [nearest(v)[0] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, sum(e for _, o, e in last if o == k), sum(e for _, _, e in last), sha[k]) for i, k, d in last]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, k1 int, copies int")
    out = vafile.report(df.repartition(3), Stage(spark, "t")).collect()
    return [tuple(r) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(params=["clusters", "flat", "coarse"])
def rows(request):
    rng = np.random.default_rng(3)
    if request.param == "clusters":
        centres = rng.standard_normal((12, 64))
        x = centres[rng.integers(0, 12, 240)] + 0.1 * rng.standard_normal((240, 64))
    elif request.param == "flat":
        x = rng.standard_normal((200, 64)) / 8
    else:  # many equal distances
        x = rng.integers(-1, 2, (220, 64)) * (rng.random((220, 64)) < 0.05) / 256
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def test_equals_brute_force(spark, rows):
    assert order(run(spark, rows)) == order(brute(rows))


def test_edges(spark):
    rng = random.Random(4)
    v = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]
    same = v()
    rows = [(0, None), (1, []), (2, v()[:63]), (3, [*v()[:63], None]), (4, [*v()[:63], math.nan]), (5, [*v()[:63], math.inf]), (6, [0.0] * 64),
            *[(7, same)] * 5, (8, same), (None, v()), (None, same), *[(i, v()) for i in range(9, 30)], *[(i, same) for i in range(30, 90)]]
    assert order(run(spark, rows)) == order(brute(rows))
    assert run(spark, rows[:6]) == []
    assert run(spark, [(6, [0.0] * 64)]) == brute([(6, [0.0] * 64)])


def test_decided_vectors_are_decided_right_and_most_are(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, (40, 64))
    v = centres[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 64))
    cells = vafile.Cells(v[:1000], v.min(0), v.max(0))
    import pyarrow as pa

    own = cells.decode(pa.array([x.tobytes() for x in cells.encode(v)], pa.binary()))
    place = cells.nearest(own, centres, cells.tables(centres))
    best = vafile.exact(v, centres)[0]
    assert (place[place >= 0] == best[place >= 0]).all()
    assert (place >= 0).mean() > 0.9


def test_full_vectors_are_not_shuffled(spark):
    stage = Stage(spark, "t")
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    given = stage.write(vafile._packed(vafile.usable(df)), "given").selectExpr("*", "1L AS copies")
    full = stage.bucketed(given, "full", vafile.KEYS, 8)
    x = rng.integers(-300, 300, (50, 64))
    cells = vafile.Cells(x, x.min(0) - 2000, x.max(0) + 2000)
    approx = stage.bucketed(given.selectExpr("k1", "k2", "v AS cells"), "cells", vafile.KEYS, 8)
    plan = vafile._moves(approx, full, cells, None, x[:40])._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 8 out of 8" in plan
    above = plan[plan.index("Join"):]
    assert above.count("Exchange hashpartitioning(k1") <= 1
    stage.clear()
