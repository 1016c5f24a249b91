import numpy as np
import pytest

from lumitie.llm import neighbours as N


def exact(ids, x, queries, k=10):
    out = {}
    for q in queries:
        own = x[list(ids).index(q)]
        d = np.sqrt(((x - own) ** 2).sum(axis=1))
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def run(spark, stage, rows, every):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    out = {}
    for r in N.nearest(frame, frame.where(f"vec_id % {every} = 0"), stage).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_recall(spark, stage, kind):
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.standard_normal((n, 32))
    if kind == "clusters":
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, n)] * 5 + 0.4 * x
    if kind == "copies":
        x[: n // 2] = x[0] + 0.01 * rng.standard_normal((n // 2, 32))
    ids = np.arange(n)
    got = run(spark, stage, [(int(i), v.tolist(), 1.0) for i, v in zip(ids, x)], 100)
    want = exact(ids, x, [i for i in ids if i % 100 == 0])
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    assert hits >= 0.93
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0])) and q not in [a for a, _ in found]
        assert all(abs(s - np.sqrt(((x[a] - x[q]) ** 2).sum())) < 1e-12 for a, s in found)


def test_edge_rows(spark, stage):
    good = [(i, [float(i + 1), 1.0], 1.0) for i in range(5)]
    rows = good + [good[1], (6, None, 1.0), (7, [0.0, 0.0], 1.0), (8, [1.0, None], 1.0), (9, [1.0, float("nan")], 1.0), (10, [float("inf"), 1.0], 1.0),
                   (None, [1.0, 1.0], 1.0), (11, [], 1.0), (12, [1.0, 2.0, 3.0], 1.0), (13, [2.0, 1.0], 1.0)]
    got = run(spark, stage, rows, 1)
    assert set(got) == {0, 1, 2, 3, 4, 13}
    assert got[0] == [(1, 1.0), (13, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)] and len(got[1]) == 5 and got[1][0] == (13, 0.0)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    assert N.nearest(frame.limit(0), frame, stage).count() == 0 and N.nearest(frame, frame.limit(0), stage).count() == 0


def test_lengths_are_not_limited(spark, stage):
    rows = [(100 * n + i, [float(i + 1)] * n, 1.0) for n in range(1, 71) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = {(r.query_id, r.rank): r.vec_id for r in N.nearest(frame, frame.where("vec_id in (200, 7002)"), stage).collect()}
    assert got == {(200, 1): 201, (200, 2): 202, (7002, 1): 7001, (7002, 2): 7000}
