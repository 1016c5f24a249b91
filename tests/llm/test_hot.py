"""Joins with a very common key, against a plain join."""

import pytest
from pyspark.sql import functions as F

from lumitie.llm import hot


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_a_plain_join(spark, stage, monkeypatch, how):
    monkeypatch.setattr(hot, "LEAST", 10)
    monkeypatch.setattr(hot, "SHARE", 5)
    many = spark.range(900).select(F.when(F.col("id") < 500, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    many = many.unionByName(spark.createDataFrame([(None, 1000)], "k int, v long"))
    few = stage.write(many.where("k is null or k % 3 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")), "few")
    got = hot.salted_join(many, few, ["k"], "v", how)
    want = many.join(few, ["k"], how)
    assert got.columns == want.columns
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_common_keys_are_dealt_over_parts(spark, stage, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 10)
    many = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    few = stage.write(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "few")
    plan = hot.salted_join(many, few, ["k"], "v")
    assert plan.count() == 4000 and few.count() == 2
