import pytest
from pyspark.sql import functions as F

from lumitie.llm import urlfilter as U
from lumitie.llm.queries import URL_RULES


def universe(spark, n, each):
    return spark.range(n).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % each == 0).alias("listed"))


@pytest.mark.parametrize("limit", [U.MAX_LITERAL_BYTES, 0])
@pytest.mark.parametrize("n,each", [(3000, 7), (40, 1), (500, 1000), (0, 1), (9000, 2)])
def test_cascade_is_exact(spark, stage, n, each, limit):
    if limit == 0 and n == 9000:
        pytest.skip("slow")
    keys = stage.write(universe(spark, n, each), "keys")
    levels = U.build_cascade(keys, stage, limit)
    assert all((x.table is not None) == (limit == 0) for x in levels)
    got = U.member(keys.withColumnRenamed("listed", "want"), "key", levels)
    assert got.where("want <> listed or listed is null").count() == 0
    assert got.count() == n


def test_several_shards(spark, stage):
    keys = stage.write(universe(spark, 60_000, 2), "keys")
    levels = U.build_cascade(keys, stage)
    assert max(x.shards for x in levels) > 1
    assert U.member(keys.withColumnRenamed("listed", "want"), "key", levels).where("want <> listed").count() == 0


URLS = [("http://A.Example.ORG/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2?x=/es/", "example.org", "/en/2", "org/", "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("https://x.example.org", "x.example.org", "", None, "allow"),
        ("https://x.com/fr/1#a", "x.com", "/fr/1", "com/fr/", "allow"),
        ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("ftp://y.net#/z://w", "y.net", "", None, "allow"),
        ("://", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://ÀB.net/\nq?r", "Àb.net", "/\nq", None, "allow"),
        ("http://bad.net/?utm_source=a", "bad.net", "/", None, "block"),
        ("http://bad.net/x", "bad.net", "/x", None, "block")]


def test_judged_urls(spark, stage):
    pages = spark.createDataFrame([(i, u[0], "allow") for i, u in enumerate(URLS)] + [(None, URLS[0][0], "x")],
                                  "page_id long, url string, verdict string")
    got = U.judge(pages, URL_RULES, U.tracking_hosts(pages), stage).collect()
    want = {(i, *u[1:]) for i, u in enumerate(URLS)} | {(None, *URLS[0][1:])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    empty = pages.limit(0)
    assert U.judge(empty, URL_RULES, U.tracking_hosts(empty), stage).count() == 0
