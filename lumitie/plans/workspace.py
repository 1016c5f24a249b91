"""Staged phase outputs of one dataset, built on first use and shared by the queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitie.operators import graph as G
from lumitie.operators import normal as N
from lumitie.operators.solver import zeropoint_table
from lumitie.plans import catalog as K
from lumitie.plans import ingest as I
from lumitie.sources import fixtures as X
from lumitie.sources import tables as T
from lumitie.session import tune
from lumitie.sources.stage import Stage

_OPEN: dict = {}


def workspace(spark: SparkSession, sf_dir: str, band: str = "g") -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir, band)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir, band)
    return _OPEN[key]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, band: str = "g"):
        self.spark, self.sf_dir, self.band = tune(spark), sf_dir, band
        self.cfg = X.config()
        self.stage = Stage(spark, f"work-{band}")

    # Source relations, read lazily.
    @property
    def meas(self):
        return X.meas(self.spark, self.sf_dir, self.band)

    @cached_property
    def chip(self):
        # The nodes of all measurements: found once, and with a known size lookups are broadcast while they are small.
        return self.stage.write(X.chip(self.spark, self.sf_dir, self.band), "chip")

    @property
    def exposure(self):
        return X.exposure(self.spark, self.sf_dir, self.band)

    @property
    def anchor_raw(self):
        return X.anchor(self.spark, self.sf_dir, self.band)

    @property
    def exptime(self):
        return X.exptime(self.spark, self.sf_dir)

    @property
    def stars(self):
        return X.stars(self.spark, self.sf_dir)

    # Phase outputs, staged once.
    @cached_property
    def dets(self) -> DataFrame:
        return self.stage.write(
            I.detections(self.meas, self.chip, self.exposure, self.band, self.cfg), "dets")

    @property
    def star_lists(self) -> DataFrame:
        return I.star_lists(self.dets)

    @cached_property
    def members(self) -> DataFrame:
        return self.stage.write(G.star_nodes(self.dets), "members")

    @cached_property
    def edges(self) -> DataFrame:
        return self.stage.write(G.overlap_edges(self.members, parts=N.tasks_for(self.members)), "edges")

    @cached_property
    def marked(self) -> DataFrame:
        comps = G.spanned_components(G.spanning_edges(self.members), self.stage)
        return self.stage.write(
            G.select_component(comps, T.anchor_exposures(self.anchor_raw, self.band)), "marked")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.stage.write(self.marked.where("connected").select("expnum", "ccdnum"), "nodes")

    @cached_property
    def anchors(self) -> DataFrame:
        return self.stage.write(T.anchors(self.anchor_raw, self.band, self.exptime), "anchors")

    @cached_property
    def zpterm(self) -> DataFrame:
        return self.stage.write(
            T.zpterms(T.band_lookup(self.chip, self.band, self.cfg.quality_cuts.exclude_ccdnums),
                      self.exposure), "zpterm")

    @cached_property
    def mjds(self) -> DataFrame:
        return self.stage.write(T.exposure_mjds(self.exposure), "mjds")

    @cached_property
    def positions(self) -> DataFrame:
        return self.stage.write(I.node_positions(self.dets), "positions")

    @cached_property
    def system(self) -> N.System:
        return N.accumulate(self.star_lists, self.nodes, self.stage,
                            cap=self.cfg.quality_cuts.max_detections_per_star)

    # A trial solution: the true zero-points plus a known error pattern, a sky tilt and
    # a few empty nodes, so every report has a reference that SQL can state.
    @cached_property
    def trial_zp(self) -> DataFrame:
        # Spark derives it from the nodes that survived the cuts.
        return self.stage.write(self.dets.select("expnum", "ccdnum").distinct().selectExpr(
            "expnum", "ccdnum",
            "CASE WHEN (expnum*3 + ccdnum) % 37 = 0 THEN 0.0e0 ELSE"
            " 31.4e0 + ((expnum*7 + ccdnum*3) % 41 - 20)/1000.0e0"
            " + ((expnum*13 + ccdnum*5) % 7 - 3)/2000.0e0"
            " + CASE WHEN expnum % 23 = 5 THEN 0.4e0 ELSE 0.0e0 END END AS zp_solved"), "trial-zp")

    @cached_property
    def trial_table(self) -> DataFrame:
        return self.stage.write(zeropoint_table(self.trial_zp, self.anchors, self.band), "trial-table")

    @cached_property
    def trial_flat(self) -> DataFrame:
        ccds = self.dets.select("ccdnum").distinct()
        return self.stage.write(
            ccds.withColumn("epoch_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .selectExpr("ccdnum", "epoch_idx",
                        "((ccdnum*3 + epoch_idx*2) % 5 - 2)/1000.0e0 AS flat_correction"), "trial-flat")

    @cached_property
    def trial_coeffs(self) -> DataFrame:
        terms = ", ".join(f"((ccdnum*{k + 3} + epoch*{k + 1}) % 9 - 4)/20000.0e0" for k in range(16))
        ccds = self.dets.select("ccdnum").distinct()
        return self.stage.write(
            ccds.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(5))))
            .selectExpr("ccdnum", "epoch", f"array({terms}) AS coeffs"), "trial-coeffs")

    @cached_property
    def trial_magzero(self) -> float:
        return K.magzero(self.anchors, self.zpterm)

    @cached_property
    def trial_catalog(self) -> DataFrame:
        """Catalog of the trial solution with the reddening of each star."""
        rows = K.calibrated_rows(self.dets, self.trial_zp, self.zpterm, self.trial_magzero, self.cfg,
                                 self.trial_coeffs, self.trial_flat)
        cat = K.star_catalog(rows, self.band).join(
            self.stars.select("objectid", F.col("ebv").alias("ebv_sfd")), "objectid")
        return self.stage.write(cat, "catalog")

    @cached_property
    def gaia(self) -> DataFrame:
        from lumitie.operators.skymatch import prebuilt_match

        return self.stage.write(
            prebuilt_match(X.gaia(self.spark, self.sf_dir), X.xmatch(self.spark, self.sf_dir),
                           "source_id"), "gaia")
