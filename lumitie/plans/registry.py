"""Named queries over the test mapping, one or more per operator of the blueprint.

Each takes (spark, sf_dir), runs over whole tables and returns a DataFrame.  Doubles are
rounded after aggregation, since summation order differs between engines.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.functions import epochs as E
from lumitie.functions import healpix as H
from lumitie.functions import photometry as P
from lumitie.operators import graph as G
from lumitie.operators import normal as N
from lumitie.operators import relational as R
from lumitie.operators import robust as Q
from lumitie.operators import skymatch as S
from lumitie.operators import solver as V
from lumitie.plans import catalog as K
from lumitie.plans import detrend as T3
from lumitie.plans import diagnostics as D
from lumitie.plans import ingest as I
from lumitie.plans import outliers as O
from lumitie.plans import starflat as SF
from lumitie.plans import validate as VA
from lumitie.plans import whatif as WI
from lumitie.plans.workspace import workspace
from lumitie.sources import dust as DU
from lumitie.sources import fixtures as X
from lumitie.sources import references as REF
from lumitie.sources import tables as T

QUERIES: dict = {}


def query(fn):
    """Register ``fn(workspace)`` under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(workspace(spark, sf_dir)))
    QUERIES[fn.__name__].__doc__ = fn.__doc__
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
        for f in df.schema])


# --- ingest -------------------------------------------------------------------------

@query
def f1_quality_cuts(w):
    return T.quality_scan(w.meas, "g", w.cfg.quality_cuts).select(
        "objectid", "exposure", "ccdnum", "mag_aper4", "magerr_aper4", "mjd", "ra", "dec")


@query
def j1_j2_local_joins(w):
    cuts = w.cfg.quality_cuts
    rows = I.local_joins(T.quality_scan(w.meas, "g", cuts),
                         T.band_lookup(w.chip, "g", cuts.exclude_ccdnums), w.exposure, "g", w.cfg)
    return rows.select("objectid", "expnum", "ccdnum", "band", "m_inst", "m_err", "x", "y")


@query
def j4_zpterms(w):
    return T.zpterms(w.chip, w.exposure)


@query
def x1_healpix(w):
    """Stars spread over the whole sky per RING pixel, caps included."""
    sky = w.stars.selectExpr("objectid", "((objectid*7919) % 36000)/100.0e0 + 0.00317e0 AS ra",
                             "((objectid*1047) % 17990)/100.0e0 - 89.94937e0 AS dec")
    return H.with_pixel(sky, 32).select("objectid", "healpix_pixel")


@query
def x3_pixel_box(w):
    """Centre and query box of every pixel hit by the all-sky stars."""
    pix = x1_healpix(w).select("healpix_pixel").distinct()
    ra, dec = H.pixel_center(32, "healpix_pixel")
    box = H.pixel_box(32, "healpix_pixel")
    return pix.select("healpix_pixel", ra.alias("ra_center"), dec.alias("dec_center"),
                      *[b.alias(n) for b, n in zip(box, ("ra_min", "ra_max", "dec_min", "dec_max"))])


@query
def x4_region_stars(w):
    """Stars per pixel of the test patch, empty pixels included."""
    pix = H.named_region_pixels(w.spark, 32, "test-patch")
    stars = H.with_pixel(w.stars, 32).select("healpix_pixel", "objectid")
    return pix.join(stars, "healpix_pixel", "left").groupBy("healpix_pixel").agg(
        F.count("objectid").alias("n_stars"))


@query
def w1_detection_cap(w):
    rows = _joined(w)
    return R.cap_detections(rows, 25).select(*_DET)


@query
def w1_detection_cap15(w):
    return R.cap_detections(_joined(w), 15).select(*_DET)


@query
def f5_min_detections(w):
    return R.min_detections(R.cap_detections(_joined(w), 15), 13).select(*_DET)


_DET = ("healpix_pixel", "objectid", "expnum", "ccdnum", "m_inst", "m_err")


def _joined(w):
    cuts = w.cfg.quality_cuts
    rows = I.local_joins(T.quality_scan(w.meas, "g", cuts),
                         T.band_lookup(w.chip, "g", cuts.exclude_ccdnums), w.exposure, "g", w.cfg)
    return H.with_pixel(rows, 32)


def _arriving(w):
    cuts = w.cfg.quality_cuts
    meas = T.quality_scan(X.arriving_meas(w.spark, w.sf_dir), "g", cuts)
    return H.with_pixel(I.local_joins(meas, T.band_lookup(w.chip, "g", cuts.exclude_ccdnums), w.exposure, "g", w.cfg), 32)


@query
def w3_arrival_index(w):
    """Running number of each measurement of a star in the order of the source."""
    return R.arrival_index(_arriving(w)).select(*_DET, "arrival")


@query
def s8_arrival_cap(w):
    """Detections of requeried pixels, capped by order of arrival."""
    cfg = replace(w.cfg, quality_cuts=replace(w.cfg.quality_cuts, max_detections_per_star=15))
    return I.requeried_detections(X.arriving_meas(w.spark, w.sf_dir), w.chip, w.exposure, "g", cfg).select(*_DET, "star_id")


@query
def k1_detections(w):
    """Phase 0 end to end."""
    return I.detections(w.meas, w.chip, w.exposure, "g", w.cfg).select(
        *_DET, "mjd", "ra", "dec", "x", "y", "band")


@query
def a1_star_means(w):
    """Inverse-variance weighted mean per star straight from the raw tables."""
    rows = I.detections(w.meas, w.chip, w.exposure, "g", w.cfg)
    wt = P.weight(F.col("m_err"))
    return rows.groupBy("objectid").agg(
        (F.sum(wt * F.col("m_inst")) / F.sum(wt)).alias("mag_mean"),
        (F.lit(1.0) / F.sqrt(F.sum(wt))).alias("mag_err"), F.count(F.lit(1)).alias("n_det"))


@query
def a10_ingest_stats(w):
    return I.ingest_stats(w.dets)


@query
def u3_missing_pixels(w):
    """Pixels of the larger test region without any detection."""
    return I.missing_pixels(H.named_region_pixels(w.spark, 32, "test-region"), w.dets)


@query
def t15_node_positions(w):
    return I.node_positions(w.dets)


@query
def w6_dense_index(w):
    return R.dense_index(w.dets, ["expnum", "ccdnum"], w.stage)


@query
def u2_keep_first(w):
    """First row of every repeated (star, node) by time and error."""
    rows = w.dets.select("objectid", "expnum", "ccdnum", "m_inst", "m_err")
    return R.keep_first(rows, ["objectid", "expnum", "ccdnum"], ["m_err", "m_inst"])


# --- epochs, classes, references ----------------------------------------------------

@query
def x2a_epoch(w):
    b = w.cfg.starflat.epoch_boundaries.all_ccds
    return w.exposure.select("expnum", "mjd", E.epoch_index(F.col("mjd"), b).alias("epoch"),
                             E.night(F.col("mjd")).alias("night"))


@query
def x2b_epoch_ccd(w):
    """Epoch per detector, with detector numbers moved so that 2 and 41 occur."""
    b = w.cfg.starflat.epoch_boundaries
    ccd = F.when(F.col("ccdnum") == 7, 41).otherwise(F.col("ccdnum"))
    nodes = X.node_grid(w.spark, w.sf_dir).join(w.exposure.select("expnum", "mjd"), "expnum")
    return nodes.select("expnum", "ccdnum", E.epoch_for_ccd(F.col("mjd"), ccd, b).alias("epoch"))


@query
def p4_exptime_norm(w):
    return T.anchors(w.anchor_raw, "g", w.exptime)


@query
def p13_program_class(w):
    return D.program_breakdown(w.dets, w.exposure, w.exptime)


@query
def w4_consecutive(w):
    return N.consecutive_exposures(T.exposure_mjds(w.exposure))


# --- graph --------------------------------------------------------------------------

@query
def a11_edges(w):
    return G.overlap_edges(G.star_nodes(w.dets)).select(
        *_pair("src", "1"), *_pair("dst", "2"), "n_shared")


def _pair(key, tag):
    e, c = R.node_columns(key)
    return e.alias(f"exp{tag}"), c.alias(f"ccd{tag}")


@query
def a12_edge_stats(w):
    return G.edge_stats(w.edges)


def _split_components(w):
    keys = (*R.STAR, "part")
    mem = G.star_nodes(w.dets.withColumn("part", F.col("expnum") % 3), keys)
    return G.spanned_components(G.spanning_edges(mem, keys), w.stage)


@query
def g1_components(w):
    """Components of the graph in which a star ties only exposures of one residue class."""
    comps = _split_components(w)
    return comps.select(*_pair("node", ""), F.shiftright("component", 10).alias("root_exp"),
                        F.col("component").bitwiseAND(F.lit(1023)).cast("int").alias("root_ccd"))


@query
def g4_des_component(w):
    return G.select_component(_split_components(w), T.anchor_exposures(w.anchor_raw, "g")).select(
        "expnum", "ccdnum", "is_anchor", "connected")


@query
def g6_connectivity(w):
    return G.connectivity_report(w.dets, w.marked, w.edges)


@query
def g7_exposure_overlaps(w):
    return G.exposure_overlaps(w.dets, D.exposure_right_ascensions(w.dets))


@query
def g7_reach(w):
    pos = w.positions.groupBy("expnum").agg(((F.max("ra_mean") - F.lit(50.0)) * 40.0).alias("exp_ra"))
    return D.graph_reach(G.exposure_overlaps(w.dets, pos))


@query
def a25_exposure_degree(w):
    pairs = G.overlap_edges(w.dets.select("objectid", "expnum").distinct(), ("objectid",), "expnum")
    return G.exposure_degree(pairs.select(F.col("src").alias("exp1"), F.col("dst").alias("exp2")))


# --- normal equations and solves -----------------------------------------------------

@query
def l1_normal_matrix(w):
    rows = w.star_lists.withColumn("node", R.node_id())
    return rounded(N.star_matrix(rows, parts=N.tasks_for(w.star_lists)), 3)


def _connected(w):
    """Star lists of the connected nodes, with the node's key."""
    return w.star_lists.join(w.nodes.select("expnum", "ccdnum", R.node_id().alias("node")), ["expnum", "ccdnum"])


@query
def l1_rhs(w):
    return rounded(N.star_sums(_connected(w), cap=w.cfg.quality_cuts.max_detections_per_star).select("i", "rhs"), 3)


@query
def l1_counts(w):
    none = F.lit(0).cast("long")
    return N.pair_counts(_connected(w)).select(*[F.coalesce(c, none).alias(c) for c in ("n_stars", "n_pairs", "n_self")])


def _gray_rows(w):
    return N.apply_flat(w.star_lists, w.mjds, w.trial_flat, w.cfg.starflat.epoch_boundaries.all_ccds)


@query
def l2_gray_matrix(w):
    return rounded(N.star_matrix(_gray_rows(w), node="expnum", mag="m_flat", parts=N.tasks_for(w.star_lists)), 3)


@query
def l2_gray_rhs(w):
    return rounded(N.star_sums(_gray_rows(w), node="expnum", mag="m_flat").select("i", "rhs"), 3)


@query
def l2_gray_counts(w):
    """Pairs between exposures and inside one; null where there is none."""
    some = lambda c: F.when(c > 0, c)
    return N.pair_counts(_gray_rows(w), node="expnum").select(
        some(F.col("n_pairs") - F.col("n_self")).alias("n_pairs"), some(F.col("n_self")).alias("n_intra"))


@query
def l3_exposure_reg(w):
    return N.matrix_entries(N.exposure_links(w.nodes, 100.0))


@query
def l5_temporal_links(w):
    exps = w.dets.select("expnum").distinct()
    return N.smoothness_links(exps, w.mjds, 0.01).select("i", "j", "w")


@query
def l6_anchor_terms(w):
    return N.anchor_terms(w.nodes, w.anchors, 1.0e6)


@query
def l7_prior_terms(w):
    return N.prior_terms(w.nodes, w.zpterm, 300.0, D.PRIOR_OFFSET, 31.4)


@query
def l10_unanchored(w):
    return V.solve_unanchored(w.system, w.nodes, w.anchors, w.cfg, w.stage)[0]


@query
def l6_anchored(w):
    return V.solve_anchored(w.system, w.nodes, w.anchors, w.cfg, w.stage)[0]


@query
def l7_prior_solve(w):
    return V.solve_with_prior(w.system, w.nodes, w.anchors, w.zpterm, 300.0, D.PRIOR_OFFSET, None,
                              w.cfg, w.stage)[0]


@query
def l9_solve_outcomes(w):
    """Iterations, convergence and true residual of the unanchored and the anchored solve."""
    infos = [solve(w.system, w.nodes, w.anchors, w.cfg, w.stage)[1] for solve in (V.solve_unanchored, V.solve_anchored)]
    return V.outcome_table(w.spark, infos)


@query
def l11_gray_solve(w):
    """Gray solve with the trial flat, expanded to node zero-points."""
    exps = w.nodes.select("expnum").distinct()
    b = w.cfg.starflat.epoch_boundaries.all_ccds
    system = N.accumulate_gray(w.star_lists, exps, w.mjds, w.trial_flat, b, w.stage)
    zp, _, info = V.solve_gray(system, w.nodes, w.anchors, w.trial_flat, w.mjds, w.cfg, w.stage)
    if not info.converged:
        raise RuntimeError(f"gray solve stopped at relative residual {info.relative_residual:.3g}")
    return zp


@query
def l12_diagnostics(w):
    return V.diagnostics(w.trial_table)


@query
def p10_zeropoint_table(w):
    return V.zeropoint_table(w.trial_zp, w.anchors, "g")


# --- residuals and flags --------------------------------------------------------------

def _trial_residuals(w):
    return O.residuals(w.star_lists, w.trial_zp.where("zp_solved > 1.0"))


@query
def i1_residuals(w):
    return _trial_residuals(w).select("objectid", "expnum", "ccdnum", "m_cal", "m_star_mean",
                                      "residual", "n_det")


@query
def i2_variable_stars(w):
    return O.variable_stars(_trial_residuals(w), 3.0)


@query
def i2_outlier_dets(w):
    return _trial_residuals(w).where(O.is_outlier(4.0)).select("objectid", "expnum", "ccdnum", "residual")


@query
def i2_bad_exposures(w):
    return O.bad_exposures(w.trial_zp, w.mjds, 0.3)


@query
def i2_bad_ccds(w):
    """Detectors that scatter more than half a robust sigma above the median."""
    return O.bad_ccds(_trial_residuals(w), 0.5, 0.001).select("expnum", "ccdnum", "scatter", "n", "threshold")


@query
def i3_unusable_stars(w):
    return O.unusable_stars(_trial_residuals(w), 3.0, 0.5)


def _trial_flags(w):
    r = _trial_residuals(w)
    dets = r.where(O.is_outlier(4.0)).select("objectid", "expnum", "ccdnum").distinct()
    exps = O.bad_exposures(w.trial_zp, w.mjds, 0.3).select("expnum")
    stars = O.variable_stars(r, 300.0).select("objectid")
    nodes = w.trial_zp.where("(expnum + ccdnum) % 29 = 0").select("expnum", "ccdnum")
    return stars, dets, exps, nodes


@query
def i4_apply_flags(w):
    return R.remove_flagged(w.star_lists, *_trial_flags(w)).select(*_DET)


@query
def a14_star_flat(w):
    b = w.cfg.starflat.epoch_boundaries.all_ccds
    return O.star_flat(w.trial_zp.where("zp_solved > 1.0"), w.mjds, b)


@query
def i5_outlier_loop(w):
    """Statistics of the whole rejection loop, from the anchored solve on."""
    state = O.reject(w.star_lists, w.nodes, w.anchors, w.mjds, w.cfg, w.stage)
    return O.iteration_table(w.spark, state.stats)


@query
def i6_final_zeropoints(w):
    """Zero-points after rejection: star flat + gray, and anchored."""
    state = O.reject(w.star_lists, w.nodes, w.anchors, w.mjds, w.cfg, w.stage)
    state = O.final_solutions(state, w.nodes, w.anchors, w.mjds, "g", w.cfg, w.stage)
    a = state.table["unanchored"].withColumn("mode", F.lit("unanchored"))
    return a.unionByName(state.table["anchored"].withColumn("mode", F.lit("anchored")))


# --- star flat and gradients ----------------------------------------------------------

@query
def a6_robust_stats(w):
    """Median, MAD and robust sigma of the plane residuals per detector and epoch."""
    r = SF.plane_residuals(w.dets, w.trial_zp.where("zp_solved > 1.0"), w.cfg)
    return Q.robust_stats(w.stage.write(r.select("ccdnum", "epoch", "residual"), "plane-values"), "residual", ["ccdnum", "epoch"], few=True)


@query
def m6_clipped_counts(w):
    r = SF.plane_residuals(w.dets, w.trial_zp.where("zp_solved > 1.0"), w.cfg)
    r = w.stage.write(r.select("ccdnum", "epoch", "residual"), "plane-values")
    return SF.clipped(r).groupBy("ccdnum", "epoch").agg(
        F.count(F.lit(1)).alias("n_good"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms"))


@query
def m6_starflat_fit(w):
    """Fitted coefficients per detector and epoch with the residual RMS they remove."""
    coeffs, good = SF.corrections(w.dets, w.trial_zp, w.cfg, w.stage)
    return rounded(SF.correction_stats(good, coeffs), 4)


@query
def x7_chebyshev_eval(w):
    return SF.flat_offset(w.dets, w.trial_coeffs, w.cfg).select(
        "objectid", "expnum", "ccdnum", "m_inst", "delta_sf")


@query
def m7_apply_starflat(w):
    return SF.apply_flat(w.dets, w.trial_coeffs, w.cfg).select("objectid", "expnum", "ccdnum", "m_inst")


@query
def m1_plane_fit(w):
    """Plane through the anchor differences, subtracted and re-shifted."""
    zp = w.trial_zp.where("zp_solved > 1.0")
    g = T3.anchor_plane(zp, w.positions, w.anchors)
    return T3.subtract_plane(zp, w.positions, g, w.anchors)


@query
def m2_gaia_detrend(w):
    """Colour + sky gradient fit against Gaia using both bands, taken out of the solution."""
    zp, other = w.trial_zp.where("zp_solved > 1.0"), workspace(w.spark, w.sf_dir, "r")
    out, g = T3.gaia_detrend(zp, w.star_lists, other.star_lists, other.trial_zp.where("zp_solved > 1.0"),
                             w.gaia, w.positions, w.anchors, "g", w.stage)
    return out.withColumn("applied", F.lit(g.applied))


@query
def m2_gradient_sample(w):
    """Stars entering the Gaia gradient fit."""
    zp, other = w.trial_zp.where("zp_solved > 1.0"), workspace(w.spark, w.sf_dir, "r")
    return T3.gradient_sample(w.star_lists, zp, other.star_lists,
                              other.trial_zp.where("zp_solved > 1.0"), w.gaia, "g")


@query
def m3_polynomial_detrend(w):
    out, info = T3.polynomial_detrend(w.trial_zp, w.positions, w.anchors)
    return out.withColumn("applied", F.lit(info["n_nodes_fit"] > 0))


# --- catalog --------------------------------------------------------------------------

@query
def a21_magzero(w):
    return w.anchors.agg(F.lit(K.magzero(w.anchors, w.zpterm)).alias("magzero"),
                         F.count(F.lit(1)).alias("n_anchors"))


@query
def i9_catalog(w):
    rows = K.calibrated_rows(w.dets, w.trial_zp, w.zpterm, w.trial_magzero, w.cfg, w.trial_coeffs,
                             w.trial_flat, w.stars.where("objectid % 211 = 0"))
    return K.star_catalog(rows, "g")


@query
def p9_dered(w):
    return K.deredden_catalog(w.trial_catalog, "g").select("objectid", "ebv_sfd", "mag_dered_g")


@query
def t21_zeropoint_list(w):
    return K.zeropoint_list(w.trial_zp, w.nodes, "g")


@query
def i9_catalog_summary(w):
    return K.catalog_summary(w.trial_catalog, "g")


@query
def s17_dust_lookup(w):
    """Extinction of every star, interpolated on a map of two resolutions."""
    return DU.lookup(w.stars, X.dust(w.spark, w.sf_dir))


@query
def x5_footprint(w):
    """Pixels of the whole sky below a declination with the stars they hold."""
    counts = H.with_pixel(w.stars, 32).groupBy("healpix_pixel").agg(F.count(F.lit(1)).alias("n_stars"))
    return H.footprint_pixels(w.spark, 32, -29.5).join(counts, "healpix_pixel", "left").na.fill(0, ["n_stars"])


# --- matches and validation -----------------------------------------------------------

@query
def j9_sky_match(w):
    return S.nearest_within(w.stars, X.second_catalog(w.spark, w.sf_dir), "objectid", "objid",
                            right_ra="ra_mean", right_dec="dec_mean")


@query
def j10_prebuilt_match(w):
    return REF.gaia(X.gaia(w.spark, w.sf_dir), X.xmatch(w.spark, w.sf_dir), w.trial_catalog).select("source_id", "nsc_objectid", "xmatch_dist", "bp_rp")


@query
def v0_fgcm_rms(w):
    stars = VA.star_level(w.dets, w.trial_zp, w.anchors, w.zpterm, w.trial_magzero, w.cfg,
                          w.trial_flat, w.mjds)
    return VA.fgcm_comparison(stars)


@query
def v1_repeatability(w):
    return VA.repeatability(w.trial_catalog, "g")


@query
def v1_repeatability_bins(w):
    return VA.repeatability_bins(w.trial_catalog, "g").select("bin", "center", "n", "median")


@query
def v2_anchored_rms(w):
    return VA.anchored_difference(w.trial_table)


@query
def v3_ls_comparison(w):
    return VA.ls_comparison(w.trial_catalog, _ls(w), "g", w.stage)


def _ls(w):
    matches = X.xmatch(w.spark, w.sf_dir, 9000000)
    return REF.legacy_survey(X.legacy(w.spark, w.sf_dir), matches, w.trial_catalog, "g")


@query
def v4_gaia_comparison(w):
    return rounded(_test_4(w), 4)


def _test_4(w):
    cat_r = workspace(w.spark, w.sf_dir, "r").trial_catalog
    return VA.gaia_comparison(w.trial_catalog, w.gaia, "g", w.stage, VA.good_colours(w.trial_catalog, cat_r))


@query
def v4_gaia_rows(w):
    cat_r = workspace(w.spark, w.sf_dir, "r").trial_catalog
    return VA.gaia_rows(w.trial_catalog, w.gaia, "g", VA.good_colours(w.trial_catalog, cat_r), True)


@query
def v6_boundary(w):
    bad = w.trial_table.where("(expnum + ccdnum) % 29 = 0").select("expnum", "ccdnum")
    return VA.boundary(w.trial_table, bad)


def _ps1(w):
    """PS1 from its zones, stored once."""
    objects, path = X.ps1(w.spark, w.sf_dir), f"{w.stage.root}/ps1-zones"
    if not T.exists(w.spark, path):
        REF.write_zones(objects, path)
    north = w.trial_catalog.where(F.col("dec") > REF.PS1_SOUTH)
    return REF.ps1(REF.read_zones(w.spark, path, objects.schema, north), w.trial_catalog, "g")


@query
def v7_ps1_comparison(w):
    """Sky match north of -30 with every object of the second catalog, then the clipped linear colour term."""
    north = w.trial_catalog.where(F.col("dec") > REF.PS1_SOUTH).select("objectid", "ra", "dec")
    objects = X.second_catalog(w.spark, w.sf_dir)
    match = S.nearest_within(north, objects, "objectid", "objid", right_ra="ra_mean", right_dec="dec_mean")
    named = objects.selectExpr("objid", "g_mag AS ps1_gMeanPSFMag", "i_mag AS ps1_iMeanPSFMag")
    return VA.ps1_comparison(w.trial_catalog, match.join(named, "objid"), "g", w.stage)


@query
def v7_ps1_selected(w):
    """The same with the survey's own selection: detections, quality, magnitude and coverage of the PS1 objects."""
    return VA.ps1_comparison(w.trial_catalog, _ps1(w), "g", w.stage)


@query
def v8_tally(w):
    stars = VA.star_level(w.dets, w.trial_zp, w.anchors, w.zpterm, w.trial_magzero, w.cfg)
    return VA.tally([VA.fgcm_comparison(stars), VA.repeatability(w.trial_catalog, "g"),
                     VA.anchored_difference(w.trial_table), VA.ps1_comparison(w.trial_catalog, _ps1(w), "g", w.stage),
                     _test_4(w), VA.stellar_locus(w.spark), VA.boundary(w.trial_table)])


# --- reports --------------------------------------------------------------------------

@query
def a15_histogram(w):
    return Q.histogram(w.dets, "ra", 49.0, 0.5, keys=["ccdnum"]).select("ccdnum", "bin", "n")


@query
def a16_binned_median(w):
    return Q.binned_median(w.dets, "dec", "m_inst", -35.0, 0.5, least=11)


@query
def a17_hist2d(w):
    return Q.histogram2d(w.dets, "ra", "dec", (50.0, 0.5), (-35.0, 0.5))


@query
def a18_value_counts(w):
    return D.value_counts(w.dets, "expnum")


@query
def o4_topk(w):
    return D.value_counts(w.dets, "expnum", 10)


@query
def o5_sample(w):
    """Seeded sample of 5000 detections."""
    return D.sample_rows(w.dets.select("objectid", "expnum", "ccdnum", "m_inst"), 5000, ["objectid", "expnum", "ccdnum"])


@query
def a20_quantiles(w):
    return Q.quantiles(w.dets, "m_inst", {"q05": 0.05, "q20": 0.2, "q40": 0.4, "q50": 0.5, "q95": 0.95},
                       ["ccdnum"])


@query
def a24_scatter(w):
    return D.scatter_floor(w.star_lists, w.trial_zp.where("zp_solved > 1.0"))


@query
def a24_floor(w):
    """Repeatability floor: the least median scatter over bins of half a magnitude."""
    floor = D.repeatability_floor(w.star_lists, w.trial_zp.where("zp_solved > 1.0"))
    return w.trial_zp.agg(F.lit(floor).cast("double").alias("floor_mag"), F.count(F.lit(1)).alias("n_nodes"))


@query
def d1_gradient_by_depth(w):
    pos = D.exposure_positions(w.dets)
    diffs = D.reference_differences(w.trial_table, pos, w.exptime)
    return D.gradient_by_depth(diffs).select("sample", "bin", "n", "median")


@query
def d1_difference_by_exptime(w):
    pos = D.exposure_positions(w.dets)
    return D.difference_by_exptime(D.reference_differences(w.trial_table, pos, w.exptime))


@query
def d1_deep_fraction(w):
    pos = w.positions.groupBy("expnum").agg(((F.max("ra_mean") - F.lit(50.0)) * 2.0 + F.lit(45.0)).alias("exp_ra"))
    return D.deep_fraction(D.exposure_classes(w.exptime, pos))


@query
def d1_deep_minus_normal(w):
    return D.deep_minus_normal(w.dets, w.exptime)


@query
def d1_seeing_by_exposure(w):
    return D.seeing_by_exposure(w.dets, w.exptime)


@query
def d1_seeing_residuals(w):
    r = D.seeing_residuals(w.dets)
    return Q.binned_median(r, "fwhm", "resid", *D.FWHM_FINE, least=51)


@query
def m8_seeing_bins(w):
    return D.seeing_bins(w.dets)


@query
def m8_aperture_correction(w):
    """Aperture correction fitted to the bins and applied to every detection."""
    return _correction_by_node(w)


def _aperture_coeffs(w):
    return D.aperture_correction(w.stage.write(D.seeing_bins(w.dets), "seeing-bins"))


def _correction_by_node(w):
    return D.correction_by_node(D.corrected_magnitudes(w.dets, _aperture_coeffs(w)), w.positions)


def _aperture_rows(w):
    system = WI.aperture_system(w.dets, w.nodes, w.cfg, w.stage)
    zp, _ = WI.aperture_what_if(system, _aperture_coeffs(w), w.nodes, w.anchors, w.cfg, w.stage)
    return WI.reference_rows(zp, w.anchors, w.positions)


@query
def d3_aperture_what_if(w):
    """Gradient of the solution before and after the aperture correction."""
    return rounded(WI.gradient_table(_aperture_rows(w)), 3)


@query
def d3_gradient_bins(w):
    return rounded(WI.gradient_bins(_aperture_rows(w)), 3)


@query
def d3b_seeing_by_ra(w):
    return WI.seeing_by_right_ascension(w.dets)


@query
def d3b_correction_by_ra(w):
    return WI.correction_by_right_ascension(_correction_by_node(w))


def _stretched(w):
    """RA of the exposures, drawn out over several bins of a degree."""
    return w.positions.groupBy("expnum").agg(((F.max("ra_mean") - F.lit(50.0)) * 2.0 + F.lit(45.0)).alias("exp_ra"))


def _without_deep(w):
    return WI.without_deep(w.system, w.trial_table, w.exptime, w.anchors, w.mjds, _stretched(w), w.cfg, w.stage)


@query
def d1_without_deep(w):
    """Node by node: the solve without deep exposures beside the full solution."""
    return rounded(_without_deep(w), 3)


@query
def d1_without_deep_by_ra(w):
    return rounded(WI.by_right_ascension(_without_deep(w)), 3)


@query
def d1_without_deep_verdict(w):
    compared = _without_deep(w)
    return rounded(WI.depth_verdict(compared, WI.by_right_ascension(compared)), 3)


@query
def d5_gradient_table(w):
    return D.gradient_table(w.trial_table, w.zpterm, w.positions, w.trial_magzero)


@query
def d5_gradient_summary(w):
    return D.gradient_summary(D.gradient_table(w.trial_table, w.zpterm, w.positions, w.trial_magzero))


@query
def d5_per_exposure(w):
    return D.per_exposure_gradients(
        D.gradient_table(w.trial_table, w.zpterm, w.positions, w.trial_magzero))


@query
def d6_dec_step(w):
    return D.dec_step(w.trial_table, D.node_medians(w.dets))


@query
def d6_binned_dec(w):
    return D.binned_along(w.trial_table, D.node_medians(w.dets), "dec_median", D.DEC_HALF_DEGREE).select(
        "bin", "n", "median")


@query
def d6_binned_ra_split(w):
    """Median difference along RA on both sides of declination -30."""
    return D.binned_along(w.trial_table, D.node_medians(w.dets), "ra_median", D.RA_TWO_DEGREES, split=True).select(
        "side", "bin", "n", "median")


@query
def d8_pixel_counts(w):
    """Detections and stars per pixel."""
    return w.dets.groupBy("healpix_pixel").agg(F.count(F.lit(1)).alias("n_detections"),
                                               F.countDistinct("objectid").alias("n_stars"))


@query
def o2_first_pixels(w):
    """The first five pixels that hold detections."""
    return w.dets.select("healpix_pixel").distinct().orderBy("healpix_pixel").limit(5)


@query
def m10_ra_gradient(w):
    slope, scatter = D.ra_gradient(w.trial_table.where("zp_solved > 1.0"), w.positions)
    return w.trial_table.agg(F.lit(slope).alias("slope_mmag_per_deg"), F.lit(scatter).alias("rms_mmag"))


@query
def a19_reference_rms(w):
    bad = w.trial_table.where("(expnum + ccdnum) % 29 = 0").select("expnum", "ccdnum")
    return D.reference_rms(w.trial_table.where("zp_solved > 1.0"), bad)


@query
def d7_star_level(w):
    return D.star_level_reference(w.dets, w.trial_table)


@query
def d2_prior_sweep(w):
    """Every prior strength with gradient, RMS and repeatability."""
    return D.prior_sweep(w.star_lists, w.nodes, w.anchors, w.zpterm, w.positions, w.cfg, w.stage)


@query
def d4_flat_closure(w):
    out = D.flat_closure(w.star_lists, w.nodes, w.anchors, w.positions, w.cfg, w.stage)
    return w.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), *[F.lit(v).alias(k) for k, v in out.items()])
