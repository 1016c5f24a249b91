"""Steps of the catalog that every measurement goes through."""

import re

from pyspark.sql import functions as F

from lumitie.functions import chebyshev as C
from lumitie.operators.relational import cap_detections, min_detections
from lumitie.plans.starflat import flat_offset
from lumitie.plans.workspace import Workspace
from lumitie.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def flat_rows(spark):
    rows = spark.sql("SELECT id AS objectid, CAST(id % 3 AS INT) AS ccdnum, CASE WHEN id % 5 = 0 THEN NULL ELSE 55900.3e0 + id * 9 END AS mjd,"
                     " CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE 1 + (id * 13) % 2047 END AS FLOAT) AS x, CAST(1 + (id * 29) % 4095 AS FLOAT) AS y FROM range(300)")
    coeffs = spark.sql("SELECT CAST(c AS INT) AS ccdnum, e AS epoch, transform(sequence(0, 15), k -> (k * 7 + c * 3 + e) % 11 / 1000.0e0) AS coeffs"
                       " FROM (SELECT explode(sequence(0, 1)) AS c) JOIN (SELECT explode(sequence(0, 5)) AS e)")
    return rows, coeffs


def test_series_of_columns_is_the_same_to_the_last_bit(spark):
    rows, coeffs = flat_rows(spark)
    joined = rows.join(coeffs.where("epoch = 2"), "ccdnum", "left")
    both = C.with_series(joined, "a").withColumn("b", C.evaluate(F.col("x"), F.col("y"), F.col("coeffs"))).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and sum(r["a"] is not None for r in both) > 100


def test_flat_computes_each_polynomial_once_for_a_row(spark):
    rows, coeffs = flat_rows(spark)
    out = flat_offset(rows, coeffs, X.config())
    assert out.columns == ["ccdnum", "objectid", "mjd", "x", "y", "delta_sf"]
    assert len(re.findall(r"/ 4095\.0", plan(out))) == 1 and len(re.findall(r"/ 2047\.0", plan(out))) == 1
    found = {r["objectid"]: r["delta_sf"] for r in out.collect()}
    assert len(found) == 300 and all(found[i] == 0.0 for i in range(0, 300, 5)) and any(found.values())


def test_detections_are_sorted_by_the_star_first(spark):
    rows = spark.sql("SELECT 1L AS healpix_pixel, id % 9 AS objectid, id AS expnum, 1 AS ccdnum, id * 0.5e0 AS mjd, id / 10.0e0 AS m_err FROM range(100)")
    out = min_detections(cap_detections(rows, 5), 2)
    sorts = re.findall(r"Sort \[(\w+)#", out._jdf.queryExecution().executedPlan().toString())
    assert sorts and set(sorts) == {"objectid"}
    assert out.groupBy("objectid").count().where("count = 5").count() == 9


def test_nodes_of_the_measurements_are_found_once(spark):
    w = Workspace(spark, SF)
    assert all("lineitem" not in f and "chip" in f for f in w.chip.inputFiles())
    assert w.chip is w.chip
    ours, theirs = (sorted(map(tuple, df.collect())) for df in (w.chip, X.chip(spark, SF)))
    assert ours == theirs
