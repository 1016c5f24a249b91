import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitie.functions.special import correlation_p_value, incomplete_beta, log_gamma
from lumitie.operators import regress as G
from lumitie.operators import robust as Q
from lumitie.operators import skymatch as S
from lumitie.plans import starflat as SF


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups, one with most rows and many ties."""
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(size=20000)]
    rows += [("b", float(v)) for v in np.round(rng.normal(size=3001), 1)] + [("c", 1.5), ("c", None)]
    return spark.createDataFrame(rows, "k string, v double"), rows


@pytest.mark.parametrize("small", [0, None])
def test_quantiles_are_exact(skewed, small):
    df, rows = skewed
    probs = {"q0": 0.0, "q2": 0.02, "q5": 0.5, "q9": 0.9, "q1": 1.0}
    acc = 500 if small == 0 else Q.SKETCH_ACCURACY
    keep = df.where("k <> 'c'") if small == 0 else df
    got = {r.k: r for r in Q.quantiles(keep, "v", probs, ["k"], acc, small).collect()}
    for k in got:
        v = np.array([x for g, x in rows if g == k and x is not None])
        assert got[k].n == len(v)
        for name, q in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), abs=1e-12)


def test_exact_mean_does_not_depend_on_the_order(spark):
    """Values around -30 whose mean is -30: a floating sum lands on either side of it, by the order of the rows."""
    rng = np.random.default_rng(9)
    half = rng.integers(0, 504, 60)
    values = [-35.0 + (m / 100.9) for m in half] + [-35.0 + ((1009 - m) / 100.9) for m in half]
    seen = set()
    for _ in range(8):
        rng.shuffle(values)
        rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(1)
        seen.add(rows.agg(Q.exact_mean("v").alias("m")).first().m)
    assert seen == {-30.0}


def test_scalar_quantiles(skewed):
    df, rows = skewed
    want = np.median([x for _, x in rows if x is not None])
    assert Q.scalar_median(df, "v") == pytest.approx(want)
    assert Q.scalar_median(df.limit(0), "v") is None


def test_robust_sigma_falls_back_to_std(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 1.0, 5.0)]
                               + [("b", v) for v in (1.0, 2.0, 3.0, 4.0, 50.0)], "k string, v double")
    got = {r.k: r for r in Q.robust_stats(df, "v", ["k"]).collect()}
    assert got["a"].sigma == pytest.approx(np.std([1, 1, 1, 1, 5])) and got["b"].sigma == pytest.approx(1.4826)


def test_histograms_and_binned_medians(spark):
    v = np.linspace(0.0, 9.99, 1000)
    df = spark.createDataFrame([(float(x), float(x * x)) for x in v], "x double, y double")
    assert {r.bin: r.n for r in Q.histogram(df, "x", 0.0, 1.0, 10).collect()} == dict(
        enumerate(np.histogram(v, np.arange(11))[0]))
    got = {r.bin: r for r in Q.binned_median(df, "x", "y", 0.0, 1.0, 10).collect()}
    for b, r in got.items():
        y = (v * v)[(v >= b) & (v < b + 1)]
        assert r.median == pytest.approx(np.median(y)) and r.std_err == pytest.approx(np.std(y, ddof=1) / np.sqrt(len(y)))
    h, _, _ = np.histogram2d(v, v * v, [np.arange(11), np.arange(0, 101, 10)])
    got2 = {(r.bin_x, r.bin_y): r.n for r in Q.histogram2d(df, "x", "y", (0.0, 1.0, 10), (0.0, 10.0, 10)).collect()}
    assert got2 == {(i, j): int(h[i, j]) for i in range(10) for j in range(10) if h[i, j]}


def colour_data(spark):
    rng = np.random.default_rng(6)
    c = rng.uniform(0.2, 2.5, 600)
    d = 20 + 30 * c - 12 * c**2 + 3 * c**3 - 0.4 * c**4 + 0.05 * c**5 + rng.normal(0, 2, 600)
    d[::40] += 300
    return c, d, spark.createDataFrame([(float(a), float(b)) for a, b in zip(c, d)], "c double, d double")


def test_linear_colour_term_matches_numpy(spark):
    c, d, df = colour_data(spark)
    keep = np.ones(len(c), bool)
    for _ in range(3):
        b, a = np.polyfit(c[keep], d[keep], 1)
        rms = np.sqrt(np.mean((d - a - b * c)[keep] ** 2))
        keep = np.abs(d - a - b * c) < 3 * rms
    b, a = np.polyfit(c[keep], d[keep], 1)
    fit, _ = G.colour_term(df, "c", "d")
    assert fit.coeffs == pytest.approx([a, b]) and fit.n == keep.sum()
    A = np.vstack([np.ones(keep.sum()), c[keep]]).T
    rms = np.sqrt(np.mean((d - a - b * c)[keep] ** 2))
    assert fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(A.T @ A))) * rms)
    assert G.colour_term(df.limit(5), "c", "d")[0] is None


def test_polynomial_colour_term_matches_numpy(spark):
    c, d, df = colour_data(spark)
    keep = np.ones(len(c), bool)
    for _ in range(3):
        p = np.polyfit(c[keep], d[keep], 5)
        rms = np.sqrt(np.mean((d - np.polyval(p, c))[keep] ** 2))
        keep = np.abs(d - np.polyval(p, c)) < 3 * rms
    p = np.polyfit(c[keep], d[keep], 5)
    fit, _ = G.colour_polynomial(df, "c", "d", 5)
    assert fit.n == keep.sum()
    grid = np.linspace(0.2, 2.5, 50)
    assert np.allclose(np.polyval(fit.coeffs, grid), np.polyval(p, grid), atol=1e-6)
    assert G.colour_polynomial(df.limit(9), "c", "d", 5)[0] is None


def test_p_values_of_correlations(spark):
    """Against the finite sums of Student's t and known points."""
    def exact(r, n):
        dof, s, c = n - 2, abs(r), math.sqrt(1 - r * r)
        if dof % 2:
            terms, term = 0.0, 1.0
            for k in range((dof - 1) // 2):
                terms += term
                term *= (2 * k + 2) / (2 * k + 3) * c * c
            return 1 - 2 / math.pi * (math.asin(s) + s * c * terms)
        terms, term = 0.0, 1.0
        for k in range(dof // 2):
            terms += term
            term *= (2 * k + 1) / (2 * k + 2) * c * c
        return 1 - s * terms

    t = 2.228138852
    rows = [(t / math.sqrt(t * t + 10), 12, 0.05), (0.0, 30, 1.0), (1.0, 9, 0.0), (-1.0, 9, 0.0)]
    rows += [(r, n, exact(r, n)) for n in (3, 4, 5, 8, 31, 200, 5001) for r in (-0.9, -0.2, 0.01, 0.05, 0.3, 0.6)]
    df = spark.createDataFrame([(float(r), n, float(p)) for r, n, p in rows] + [(None, 9, None), (0.5, 2, None), (float("nan"), 9, None)], "r double, n long, p double")
    for row in df.select("*", correlation_p_value(F.col("r"), F.col("n")).alias("got")).collect():
        assert (row.got is None) if row.p is None else row.got == pytest.approx(row.p, abs=1e-8), row


def test_incomplete_beta_and_gamma(spark):
    rows = [(x, a, b) for x in (0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0) for a, b in ((0.5, 0.5), (2.0, 3.0), (40.0, 0.5), (0.5, 40.0), (1e4, 0.5))]
    df = spark.createDataFrame(rows, "x double, a double, b double")
    for r in df.select("*", incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("i"), incomplete_beta(1 - F.col("x"), F.col("b"), F.col("a")).alias("j"),
                       log_gamma(F.col("a")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.a), rel=1e-12, abs=1e-12)
        assert r.i + r.j == pytest.approx(1.0, abs=1e-9) and 0 <= r.i <= 1 + 1e-12
        if (r.a, r.b) == (0.5, 0.5):
            assert r.i == pytest.approx(2 / math.pi * math.asin(math.sqrt(r.x)), abs=1e-9)
        if (r.a, r.b) == (2.0, 3.0):
            assert r.i == pytest.approx(6 * r.x ** 2 - 8 * r.x ** 3 + 3 * r.x ** 4, abs=1e-12)


def plane(spark, n, fn, noise=0.0):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(1, 2048, n), rng.uniform(1, 4096, n)
    u, v = 2 * (x - 1) / 2047 - 1, 2 * (y - 1) / 4095 - 1
    z = fn(u, v) + rng.normal(0, noise, n) if noise else fn(u, v) + 0 * u
    return (x, y, z), spark.createDataFrame(
        [(1, 0, float(a), float(b), float(c)) for a, b, c in zip(x, y, z)],
        "ccdnum int, epoch int, x double, y double, residual double")


@pytest.mark.parametrize("fn, k, want", [(lambda u, v: 0.01 + 0 * u, 0, 0.01), (lambda u, v: u * 0.02, 4, 0.02),
                                         (lambda u, v: u * v * 0.005, 5, 0.005)])
def test_chebyshev_patterns_are_recovered(spark, fn, k, want):
    _, df = plane(spark, 400, fn)
    c = np.array(SF.fit_chebyshev(df, "residual").first().coeffs)
    expected = np.zeros(16)
    expected[k] = want
    assert np.abs(c - expected).max() < 1e-10


def test_chebyshev_fit_matches_dense_least_squares(spark):
    (x, y, z), df = plane(spark, 1000, lambda u, v: 0.02 * u**2 - 0.01 * v**3 + 0.003 * u * v**2, 0.005)
    c = np.array(SF.fit_chebyshev(df, "residual").first().coeffs)
    A = np.polynomial.chebyshev.chebvander2d(2 * (x - 1) / 2047 - 1, 2 * (y - 1) / 4095 - 1, [3, 3])
    assert np.abs(c - np.linalg.lstsq(A, z, rcond=None)[0]).max() < 1e-10


def brute_match(left, right, radius):
    def vec(ra, dec):
        ra, dec = np.radians(ra), np.radians(dec)
        return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)
    a, b = vec(*left.T[1:]), vec(*right.T[1:])
    out = {}
    for k, p in enumerate(a):
        d = np.degrees(2 * np.arcsin(np.minimum(np.linalg.norm(b - p, axis=1) / 2, 1))) * 3600
        j = int(np.argmin(d))
        if d[j] < radius:
            out[int(left[k, 0])] = (int(right[j, 0]), d[j])
    return out


def test_sky_match_equals_brute_force(spark):
    """Dense field, the RA seam and both poles."""
    rng = np.random.default_rng(9)
    pts = [(rng.uniform(10, 10.01), rng.uniform(-30, -29.99)) for _ in range(300)]
    pts += [(rng.choice([0.00005, 359.99995]), rng.uniform(-1, 1) * 0.001) for _ in range(40)]
    pts += [(rng.uniform(0, 360), s * (90 - rng.uniform(0, 0.001))) for s in (1, -1) for _ in range(60)]
    left = np.array([(k, *p) for k, p in enumerate(pts)])
    right = left.copy()
    right[:, 0] += 1000
    right[:, 2] = np.clip(right[:, 2] + rng.normal(0, 0.4 / 3600, len(right)), -90, 90)
    right[:, 1] = (right[:, 1] + rng.normal(0, 0.4 / 3600, len(right))) % 360
    f = lambda m: spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in m], "id bigint, ra double, dec double")
    got = {r.id: (r.rid, r.sep_arcsec) for r in S.nearest_within(
        f(left), f(right).withColumnRenamed("id", "rid"), "id", "rid").collect()}
    want = brute_match(left, right, 1.0)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_piles_of_equal_positions_do_not_multiply(spark):
    left = spark.range(3000).selectExpr("id", "12.0D AS ra", "-30.0D AS dec")
    right = spark.range(3000).selectExpr("id AS rid", "12.0D AS ra", "-30.0D + 0.0001D AS dec")
    out = S.nearest_within(left, right, "id", "rid")
    assert out.count() == 3000 and out.select("rid").distinct().count() == 1


def test_prebuilt_match_filters_box_and_distance(spark):
    obj = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 10.5, 0.0)], "source_id bigint, ra double, dec double")
    x = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5), (3, "c", 1.0)], "id1 bigint, id2 string, distance double")
    out = S.prebuilt_match(obj, x, "source_id", (9.0, 11.0, -1.0, 1.0)).collect()
    assert [(r.source_id, r.nsc_objectid) for r in out] == [(1, "a")]


def test_ties_are_stable(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [("c",)], "k string")
    from lumitie.plans.diagnostics import value_counts

    assert [(r.k, r.n) for r in value_counts(df, "k", 2).collect()] == [("a", 3), ("b", 3)]
    assert df.select(F.count(F.lit(1))).first()[0] == 7
