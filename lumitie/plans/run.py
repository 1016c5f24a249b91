"""All phases over stored tables, and the command line.

Tables under ``<input>``: meas, chip, exposure, anchor and optionally exptime, gaia,
gaia_xmatch, ebv.  Results go to ``<output>/<relation>/band=<b>``.  Phases 0-3 run for
every band before 3b-6, since the gradient fit needs both g and r.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession

from lumitie import schema as S
from lumitie.config import Config, load_config
from lumitie.functions.healpix import footprint_pixels, named_region_pixels
from lumitie.operators import graph as G
from lumitie.operators import normal as N
from lumitie.operators import solver as V
from lumitie.operators.skymatch import prebuilt_match
from lumitie.plans import catalog as K
from lumitie.plans import detrend as D
from lumitie.plans import ingest as I
from lumitie.plans import outliers as O
from lumitie.plans import starflat as SF
from lumitie.plans import validate as VA
from lumitie.plans.manifest import Manifest, fingerprint, ingest
from lumitie.session import build_session
from lumitie.sources import references as R
from lumitie.sources import tables as T
from lumitie.sources.stage import Stage

log = logging.getLogger("lumitie")
FIRST = ("0", "1", "2", "3")
SECOND = ("3b", "4", "5", "6")


class Run:
    """One calibration run: input and output roots, configuration, pixel selection."""

    def __init__(self, spark: SparkSession, source: str, output: str, cfg: Config,
                 pixels: DataFrame | None = None, mode: str = "both", pixel_group: int | None = None):
        self.spark, self.source, self.output = spark, source.rstrip("/"), output.rstrip("/")
        self.cfg, self.pixels, self.mode = cfg, pixels, mode
        self.pixel_group = pixel_group      # pixels of one commit of phase 0; all that are missing if None
        self.stage = Stage(spark, "run")

    def path(self, relation: str, band: str) -> str:
        return f"{self.output}/{relation}/band={band}"

    def table(self, relation: str, band: str, struct) -> DataFrame:
        return T.read(self.spark, self.path(relation, band), struct)

    def given(self, name: str, struct) -> DataFrame | None:
        p = f"{self.source}/{name}"
        return T.read(self.spark, p, struct) if T.exists(self.spark, p) else None

    def optional(self, relation: str, band: str, struct) -> DataFrame | None:
        p = self.path(relation, band)
        return T.read(self.spark, p, struct) if T.exists(self.spark, p) else None

    def dust(self) -> DataFrame | None:
        """The dust map, of one resolution or, with a column ``nside``, of several."""
        p = f"{self.source}/ebv"
        if not T.exists(self.spark, p):
            return None
        return T.read(self.spark, p, S.EBV_LEVELS if "nside" in self.spark.read.parquet(p).columns else S.EBV)

    def anchors(self, band: str) -> DataFrame:
        return T.anchors(self.given("anchor", S.ANCHOR), band, self.given("exptime", S.EXPTIME))

    def mjds(self, band: str) -> DataFrame:
        return T.exposure_mjds(T.band_lookup(self.given("exposure", S.EXPOSURE), band),
                               self.cfg.quality_cuts.instrument)

    def zpterm(self, band: str) -> DataFrame:
        return T.zpterms(T.band_lookup(self.given("chip", S.CHIP), band, self.cfg.quality_cuts.exclude_ccdnums),
                         T.band_lookup(self.given("exposure", S.EXPOSURE), band))

    def detections(self, band: str) -> DataFrame:
        return T.read_pixels(self.spark, self.path("detections", band), S.DETECTIONS, self.pixels)

    def solution(self, band: str, mode: str, raw: bool = False) -> DataFrame:
        """Detrended, else final, else first solution of a mode."""
        names = [f"zeropoints_{mode}", f"first_{mode}"]
        if not raw:
            names.insert(0, f"detrended_{mode}")
        found = T.first_existing(self.spark, *[self.path(n, band) for n in names])
        if found is None:
            raise FileNotFoundError(f"no {mode} solution for band {band}")
        return T.read(self.spark, found, S.ZEROPOINTS)

    # Phases -------------------------------------------------------------------------

    def manifest(self, band: str) -> Manifest:
        inputs = [f"{self.source}/{name}" for name in ("meas", "chip", "exposure")]
        return Manifest(self.spark, self.path("manifest", band), fingerprint(self.spark, inputs, (self.cfg.quality_cuts, self.cfg.survey)))

    def phase_0(self, band: str) -> None:
        """Ingest the selected pixels that no earlier run has committed from the same inputs."""
        def detections(pixels: DataFrame | None) -> DataFrame:
            return I.detections(self.given("meas", S.MEAS), self.given("chip", S.CHIP), self.given("exposure", S.EXPOSURE), band, self.cfg, pixels)

        if self.pixels is None:
            T.write_pixels(T.pad_columns(detections(None), S.DETECTIONS), self.path("detections", band))
            return
        manifest = self.manifest(band)
        done = ingest(manifest, self.pixels, detections, S.DETECTIONS, self.path("detections", band), self.pixel_group)
        empty = manifest.committed().join(self.pixels.select("healpix_pixel"), "healpix_pixel", "left_semi").where("n_detections = 0").count()
        log.info("band %s: %d pixels ingested, %d selected pixels hold no detections", band, done, empty)

    def phase_1(self, band: str) -> None:
        dets = self.detections(band)
        members = self.stage.write(G.star_nodes(dets), "members")
        edges = self.stage.write(G.overlap_edges(members), "edges")
        comps = G.spanned_components(G.spanning_edges(members), self.stage)
        marked = self.stage.write(
            G.select_component(comps, T.anchor_exposures(self.given("anchor", S.ANCHOR), band)), "marked")
        for relation, cond in (("connected_nodes", "connected"), ("dropped_nodes", "NOT connected"),
                               ("des_nodes", "connected AND is_anchor")):
            T.write(marked.where(cond).select("expnum", "ccdnum"), self.path(relation, band))
        T.write_report(G.connectivity_report(dets, marked, edges), self.path("connectivity", band))

    def phase_2(self, band: str) -> None:
        nodes, anchors = self.table("connected_nodes", band, S.NODES), self.stage.write(self.anchors(band), "anchors")
        system = N.accumulate(I.star_lists(self.detections(band)), nodes, self.stage,
                              cap=self.cfg.quality_cuts.max_detections_per_star)
        for mode, solve in (("unanchored", V.solve_unanchored), ("anchored", V.solve_anchored)):
            if self.mode in (mode, "both"):
                zp, info = solve(system, nodes, anchors, self.cfg, self.stage)
                log.info("band %s %s: %s", band, mode, info)
                T.write(V.zeropoint_table(zp, anchors, band), self.path(f"first_{mode}", band))

    def phase_3(self, band: str) -> None:
        nodes, anchors = self.table("connected_nodes", band, S.NODES), self.stage.write(self.anchors(band), "anchors")
        mjds = self.stage.write(self.mjds(band), "mjds")
        start = self.optional("first_anchored", band, S.ZEROPOINTS)
        start = start.select("expnum", "ccdnum", "zp_solved") if start is not None else None
        state = O.reject(I.star_lists(self.detections(band)), nodes, anchors, mjds, self.cfg, self.stage, start)
        modes = ("unanchored", "anchored") if self.mode == "both" else (self.mode,)
        state = O.final_solutions(state, nodes, anchors, mjds, band, self.cfg, self.stage, modes)
        for mode, table in state.table.items():
            T.write(table, self.path(f"zeropoints_{mode}", band))
        for name, df in (("flagged_stars", state.flagged_stars), ("flagged_exposures", state.flagged_exposures),
                         ("flagged_nodes", state.flagged_nodes), ("clean_star_lists", state.star_lists),
                         ("iteration_stats", O.iteration_table(self.spark, state.stats))):
            T.write(df, self.path(name, band))
        if state.flat is not None:
            T.write(state.flat, self.path("star_flat", band))

    def phase_3b(self, band: str) -> None:
        method = self.cfg.solve.gradient_detrend
        if method not in ("gaia", "fgcm"):
            return
        if method == "fgcm":
            self.anchor_detrend(band)
            return
        other = "r" if band == "g" else "g"
        gaia = self.given("gaia", S.GAIA)
        if gaia is None or self.optional("zeropoints_unanchored", other, S.ZEROPOINTS) is None:
            log.info("band %s: no gradient fit without Gaia and both bands", band)
            return
        matched = prebuilt_match(gaia, self.given("gaia_xmatch", S.XMATCH), "source_id")
        table = self.solution(band, "unanchored", raw=True)
        positions = self.stage.write(I.node_positions(self.detections(band)), "positions")
        anchors = self.stage.write(self.anchors(band), "anchors")
        zp, g = D.gaia_detrend(
            table.select("expnum", "ccdnum", "zp_solved"), I.star_lists(self.detections(band)),
            I.star_lists(self.detections(other)), self.solution(other, "unanchored", raw=True),
            matched, positions, anchors, band, self.stage)
        self.keep_detrended(zp, anchors, g, band)

    def anchor_detrend(self, band: str) -> None:
        """Plane fitted to the anchors instead of Gaia."""
        zp = self.solution(band, "unanchored", raw=True).select("expnum", "ccdnum", "zp_solved")
        positions = self.stage.write(I.node_positions(self.detections(band)), "positions")
        anchors = self.stage.write(self.anchors(band), "anchors")
        g = D.anchor_plane(zp, positions, anchors)
        self.keep_detrended(D.subtract_plane(zp, positions, g, anchors), anchors, g, band)

    def keep_detrended(self, zp: DataFrame, anchors: DataFrame, g: D.Gradient, band: str) -> None:
        log.info("band %s: %s", band, g)
        # The raw solution stays beside the detrended one, so a rerun starts from it.
        T.write(V.zeropoint_table(zp, anchors, band), self.path("detrended_unanchored", band))
        T.write_report(self.spark.createDataFrame(
            [(g.ra_slope, g.dec_slope, g.ra_center, g.dec_center, int(g.n_stars), g.color_source, g.source)],
            "ra_slope double, dec_slope double, ra_center double, dec_center double, n_stars bigint, "
            "color_source string, source string"), self.path("gradient_info", band))

    def phase_4(self, band: str) -> None:
        zp = self.solution(band, "unanchored").select("expnum", "ccdnum", "zp_solved")
        nodes = self.table("connected_nodes", band, S.NODES)
        coeffs, good = SF.corrections(self.detections(band), zp.join(nodes, ["expnum", "ccdnum"], "left_semi"),
                                      self.cfg, self.stage)
        T.write(coeffs, self.path("starflat_coeffs", band))
        T.write(SF.correction_stats(good, coeffs, self.cfg.starflat.polynomial_order),
                self.path("starflat_stats", band))

    def phase_5(self, band: str) -> None:
        zp = self.solution(band, "unanchored").select("expnum", "ccdnum", "zp_solved")
        stars = T.flagged(self.spark, self.path("flagged_stars", band), S.STAR_FLAGS)
        zpterm = self.stage.write(self.zpterm(band), "zpterm")
        offset = K.magzero(self.anchors(band), zpterm)
        rows = K.calibrated_rows(
            self.detections(band), zp.where("zp_solved > 1.0"), zpterm, offset, self.cfg,
            self.optional("starflat_coeffs", band, S.STARFLAT_COEFFS),
            self.optional("star_flat", band, S.STAR_FLAT), stars)
        catalog = K.star_catalog(rows, band)
        catalog = K.deredden_catalog(T.attach_ebv(catalog, self.dust()), band)
        T.write(catalog, self.path("star_catalog", band))
        nodes = self.table("connected_nodes", band, S.NODES)
        T.write(K.zeropoint_list(zp.where("zp_solved > 1.0"), nodes, band), self.path("zeropoint_table", band))

    def phase_6(self, band: str) -> None:
        zp = self.solution(band, "unanchored").select("expnum", "ccdnum", "zp_solved")
        stars = T.flagged(self.spark, self.path("flagged_stars", band), S.STAR_FLAGS)
        anchors, zpterm = self.anchors(band), self.zpterm(band)
        offset = K.magzero(anchors, zpterm)
        catalog = T.read(self.spark, self.path("star_catalog", band), S.catalog(band))
        level = VA.star_level(self.detections(band), zp, anchors, zpterm, offset, self.cfg,
                              self.optional("star_flat", band, S.STAR_FLAT), self.mjds(band), stars)
        checks = [VA.fgcm_comparison(level), VA.repeatability(catalog, band), VA.stellar_locus(self.spark)]
        anchored = self.optional("zeropoints_anchored", band, S.ZEROPOINTS)
        if anchored is not None:
            checks += [VA.anchored_difference(anchored), VA.boundary(
                anchored, self.optional("flagged_nodes", band, S.NODES),
                T.flagged(self.spark, self.path("flagged_exposures", band), S.EXPOSURE_FLAGS))]
        gaia = self.given("gaia", S.GAIA)
        if gaia is not None:
            matched = R.gaia(gaia, self.given("gaia_xmatch", S.XMATCH), catalog)
            both = {b: self.path("star_catalog", b) for b in ("g", "r")}
            colours = (VA.good_colours(*[T.read(self.spark, p, S.catalog(b)) for b, p in both.items()])
                       if all(T.exists(self.spark, p) for p in both.values()) else None)
            checks.append(VA.gaia_comparison(catalog, matched, band, self.stage, colours))
        ps1 = self.given("ps1", S.PS1)
        if ps1 is not None:
            checks.append(VA.ps1_comparison(catalog, R.ps1(ps1, catalog, band), band, self.stage))
        report = VA.melt(checks[0])
        for c in checks[1:]:
            report = report.unionByName(VA.melt(c))
        T.write_report(report, self.path("validation", band))

    def phases(self, bands, start: str = "0") -> None:
        """Phases 0-3 of every band, then 3b-6; resumes at ``start``.

        Starting at phase 1 needs every selected pixel committed, so an unfinished ingest is finished first.  Staged tables go
        with the run, also when it fails.
        """
        order = FIRST + SECOND
        wanted = order[order.index(start):]
        try:
            for block in (FIRST, SECOND):
                for band in bands:
                    if block is FIRST and start == "1" and self.pixels is not None and not self.manifest(band).missing(self.pixels).isEmpty():
                        log.info("band %s: the ingest is unfinished", band)
                        self.phase_0(band)
                    for phase in (p for p in block if p in wanted):
                        began = time.time()
                        getattr(self, f"phase_{phase}")(band)
                        log.info("phase %s band %s took %.1f s", phase, band, time.time() - began)
        finally:
            self.stage.clear()


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lumitie")
    ap.add_argument("input")
    ap.add_argument("output")
    ap.add_argument("--band", action="append", help="repeatable; default: all configured bands")
    ap.add_argument("--mode", choices=("unanchored", "anchored", "both"), default="both")
    ap.add_argument("--config")
    ap.add_argument("--start-phase", default="0", choices=FIRST + SECOND)
    ap.add_argument("--test-region", action="store_true")
    ap.add_argument("--test-patch", action="store_true")
    ap.add_argument("--pixels", help="comma separated pixel list")
    ap.add_argument("--max-pixels", type=int)
    ap.add_argument("--pixel-group", type=int, help="pixels committed together in phase 0; default: all that are missing")
    ap.add_argument("--dec-max", type=float, default=35.0)
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    cfg = load_config(a.config)
    spark = build_session(a.master)
    nside = cfg.survey.nside_chunk
    if a.pixels:
        pixels = spark.createDataFrame([(int(p),) for p in a.pixels.split(",")], "healpix_pixel bigint")
    elif a.test_patch:
        pixels = named_region_pixels(spark, nside, "test-patch")
    elif a.test_region:
        pixels = named_region_pixels(spark, nside, "test-region")
    else:
        pixels = footprint_pixels(spark, nside, a.dec_max).select("healpix_pixel")
    if a.max_pixels:
        pixels = pixels.orderBy("healpix_pixel").limit(a.max_pixels)
    Run(spark, a.input, a.output, cfg, pixels, a.mode, a.pixel_group).phases(a.band or cfg.survey.bands, a.start_phase)


if __name__ == "__main__":
    main()
