from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumitie.config import Config
from lumitie.operators import relational as R
from lumitie.plans import ingest as I
from lumitie.sources import tables as T

MEAS = ("objectid string, exposure string, ccdnum int, mag_aper4 double, magerr_aper4 double, mjd double, "
        "ra double, dec double, x double, y double, filter string, flags int, class_star double")


def meas(spark, rows):
    return spark.createDataFrame(rows, MEAS)


def good(oid="s1", exposure="e1", ccd=1, mag=18.0, err=0.01, mjd=56000.0, ra=55.0, dec=-30.0,
         band="g", flags=0, cs=0.9):
    return (oid, exposure, ccd, mag, err, mjd, ra, dec, 100.0, 200.0, band, flags, cs)


@pytest.fixture()
def lookups(spark):
    chip = spark.createDataFrame([("e1", 1, 0.1), ("e2", 1, 0.15), ("e3", 1, 0.12)],
                                 "exposure string, ccdnum int, zpterm double")
    exposure = spark.createDataFrame([("e1", 11, "c4d"), ("e2", 12, "c4d"), ("e3", 13, "k4m")],
                                     "exposure string, expnum bigint, instrument string")
    return chip, exposure


def test_zpterm_is_subtracted_and_other_cameras_removed(spark, lookups):
    rows = meas(spark, [good(), good(exposure="e2", mag=18.2), good(exposure="e3")])
    out = {r.expnum: r for r in I.local_joins(rows, *lookups, "g", Config()).collect()}
    assert set(out) == {11, 12}
    assert out[11].m_inst == pytest.approx(17.9) and out[12].m_inst == pytest.approx(18.05)
    assert out[11].band == "g"


@pytest.mark.parametrize("bad", [dict(flags=1), dict(cs=0.8), dict(err=0.05), dict(mag=17.0),
                                 dict(mag=20.0), dict(ccd=61), dict(band="r")])
def test_quality_cuts_are_strict(spark, bad):
    assert T.quality_scan(meas(spark, [good(), good(**bad)]), "g", Config().quality_cuts).count() == 1


def test_cuts_reach_the_scan(spark, tmp_path, capsys):
    p = str(tmp_path / "m")
    meas(spark, [good()]).write.parquet(p)
    T.quality_scan(spark.read.parquet(p), "g", Config().quality_cuts).explain("formatted")
    pushed = capsys.readouterr().out.split("PushedFilters")[1]
    for piece in ("GreaterThan(mag_aper4,17.0)", "LessThanOrEqual(flags,0)", "GreaterThan(class_star,0.8)"):
        assert piece in pushed


def capped(spark, rows, k):
    df = spark.createDataFrame(rows, "objectid string, m_err double, val int").withColumn(
        "healpix_pixel", F.lit(1).cast("long"))
    return R.cap_detections(df, k, tiebreak=("val",)).collect()


def test_cap_keeps_the_smallest_errors(spark):
    rows = [("a", 0.001 * (k + 1), k) for k in range(100)]
    assert sorted(r.val for r in capped(spark, rows, 25)) == list(range(25))


def test_cap_leaves_small_stars_alone(spark):
    rows = [("a", 0.01, k) for k in range(15)] + [("b", 0.01, k) for k in range(80)]
    got = capped(spark, rows, 25)
    assert sum(r.objectid == "a" for r in got) == 15 and sum(r.objectid == "b" for r in got) == 25


def test_cap_is_deterministic_on_ties(spark):
    rows = [("a", 0.01, k) for k in range(50)]
    assert {r.val for r in capped(spark, rows, 25)} == set(range(25))


def test_cap_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 AS objectid", "id * 0.001 AS m_err", "1L AS healpix_pixel")
    plan = R.cap_detections(df, 25)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_single_detections_are_removed(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "objectid string").withColumn("healpix_pixel", F.lit(1))
    assert {r.objectid for r in R.min_detections(df, 2).collect()} == {"a"}


def test_cap_and_count_are_scoped_to_the_pixel(spark, lookups):
    """A star straddling a pixel edge with one row on each side is dropped."""
    rows = meas(spark, [good(), good(exposure="e2", ra=59.0)])
    assert I.detections(rows, *lookups, "g", Config()).count() == 0
    rows = meas(spark, [good(), good(exposure="e2")])
    assert I.detections(rows, *lookups, "g", Config()).count() == 2


def test_rows_without_position_drop_out(spark, lookups):
    rows = meas(spark, [good(), good(exposure="e2"), good(exposure="e2", ra=float("nan"))])
    assert I.detections(rows, *lookups, "g", Config()).count() == 2


def test_pixel_list_restricts(spark, lookups):
    rows = meas(spark, [good(), good(exposure="e2")])
    pix = I.detections(rows, *lookups, "g", Config()).first().healpix_pixel
    assert I.detections(rows, *lookups, "g", Config(), [pix]).count() == 2
    assert I.detections(rows, *lookups, "g", Config(), [pix + 1]).count() == 0
    only = spark.createDataFrame([(pix,)], "healpix_pixel bigint")
    assert I.missing_pixels(only, I.detections(rows, *lookups, "g", Config())).count() == 0


def test_node_position_is_mean_of_pixel_means(spark):
    df = spark.createDataFrame([(1, 5, 1, 10.0, 0.0), (1, 5, 1, 12.0, 0.0), (2, 5, 1, 20.0, 3.0)],
                               "healpix_pixel int, expnum bigint, ccdnum int, ra double, dec double")
    row = I.node_positions(df).first()
    assert (row.ra_mean, row.dec_mean) == (15.5, 1.5)


def test_anchor_keeps_fgcm_rows_of_the_band_once(spark):
    a = spark.createDataFrame([(1, 1, "g", 31.0, "FGCM"), (1, 1, "g", 31.2, "FGCM"), (1, 1, "r", 30.0, "FGCM"),
                               (2, 1, "g", 31.0, "other")], "expnum bigint, ccdnum int, band string, mag_zero double, source string")
    got = T.anchors(a, "g").collect()
    assert [(r.expnum, r.zp_fgcm) for r in got] == [(1, 31.2)]


def test_dense_index_counts_in_order(spark, stage):
    df = spark.range(5000).selectExpr("id % 173 AS expnum", "CAST(id % 11 AS INT) AS ccdnum")
    got = R.dense_index(df, ["expnum", "ccdnum"], stage).orderBy("expnum", "ccdnum").collect()
    assert [r.idx for r in got] == list(range(len(got)))


def test_padding_adds_typed_nulls(spark):
    from lumitie import schema as S

    out = T.pad_columns(spark.createDataFrame([(1, 3)], "expnum bigint, ccdnum int"), S.ZEROPOINTS)
    assert out.columns == [f.name for f in S.ZEROPOINTS] and out.first().zp_solved is None


def test_node_key_round_trip(spark):
    df = spark.createDataFrame([(987654, 62), (0, 1)], "expnum bigint, ccdnum int")
    back = df.select("expnum", "ccdnum", R.node_id().alias("node")).select(
        F.col("expnum").alias("e"), F.col("ccdnum").alias("c"), *R.node_columns())
    assert back.where("e <> expnum OR c <> ccdnum").count() == 0


def test_magnitude_cut_can_be_configured(spark):
    cuts = replace(Config().quality_cuts, mag_max=25.0)
    assert T.quality_scan(meas(spark, [good(mag=22.0)]), "g", cuts).count() == 1
