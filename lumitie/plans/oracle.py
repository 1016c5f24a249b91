"""SQL statements of the same results, for checking the registry on another engine.

Each statement is a list of named steps followed by a final SELECT; ``statement`` adds
the steps it needs.
"""

from __future__ import annotations

import re
from math import comb

from lumitie.config import EXTINCTION, EpochBoundaries
from lumitie.sources.fixtures import MEAS_EXPR

BOUNDS = EpochBoundaries()
# Median, MAD and standard deviation of the detectors' scatter.
SCATTER_SPREAD = ("(SELECT any_value(m) AS m, median(abs(scatter - m)) AS mad, stddev_samp(scatter) AS s FROM scatter, scatter_mid)")


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def cols(*items, digits: int = 6) -> str:
    """Rounded columns: a plain name, or ``name=expr``."""
    out = []
    for it in items:
        name, _, expr = it.partition("=")
        out.append(f"{r(expr or name, digits)} AS {name}")
    return ", ".join(out)


def ang2pix(ns: int, ra: str, dec: str) -> str:
    """RING pixel in SQL, written from the published formulas."""
    z = f"cos(radians(90.0e0 - ({dec})))"
    tt = f"(radians({ra}) / (pi()/2.0))"
    jp = f"floor({ns}*(0.5e0 + {tt}) - 0.75e0*{ns}*{z})"
    jm = f"floor({ns}*(0.5e0 + {tt}) + 0.75e0*{ns}*{z})"
    ir = f"({ns} + 1 + {jp} - {jm})"
    ks = f"(1 - ({ir} - 2*floor({ir}/2)))"
    ip0 = f"floor(({jp} + {jm} - {ns} + {ks} + 1)/2)"
    ip = f"({ip0} - {4*ns}*floor({ip0}/{4*ns}))"
    belt = f"({2*ns*(ns-1)} + ({ir} - 1)*{4*ns} + {ip})"
    tp = f"({tt} - floor({tt}))"
    t = f"({ns}*sqrt(3.0e0*(1.0e0 - abs({z}))))"
    cr = f"(floor({tp}*{t}) + floor((1.0e0 - {tp})*{t}) + 1)"
    ci = f"(floor({tt}*{cr}) - 4*{cr}*floor(floor({tt}*{cr})/(4*{cr})))"
    north = f"(2*{cr}*({cr} - 1) + {ci})"
    south = f"({12*ns*ns} - 2*{cr}*({cr} + 1) + {ci})"
    return (f"CAST(CASE WHEN abs({z}) <= 2.0e0/3.0e0 THEN {belt} WHEN {z} > 0 THEN {north} "
            f"ELSE {south} END AS BIGINT)")


def count_bounds(op: str, bounds) -> str:
    return "(" + " + ".join(f"CAST(mjd {op} {b} AS INT)" for b in sorted(bounds)) + ")"


EPOCH_SHARED = count_bounds(">=", BOUNDS.all_ccds)


def epoch_ccd(ccd: str) -> str:
    out = "CASE"
    for c, extra in BOUNDS.per_ccd.items():
        out += f" WHEN {ccd} = {c} THEN {count_bounds('>', set(BOUNDS.all_ccds) | set(extra))}"
    return out + f" ELSE {count_bounds('>', BOUNDS.all_ccds)} END"


def cheb(u: str) -> list:
    return ["1.0e0", u, f"(2*{u}*{u} - 1)", f"(4*{u}*{u}*{u} - 3*{u})"]


def cheb_sum() -> str:
    tx, ty = cheb("ux"), cheb("uy")
    terms = []
    for k in range(16):
        i, j = divmod(k, 4)
        coef = f"(((ccdnum*{k + 3} + epoch*{k + 1}) % 9 - 4)/20000.0e0)"
        terms.append(f"{coef}*{tx[i]}*{ty[j]}")
    return " + ".join(terms)


MEAS_COLS = ", ".join(f"{e} AS {'expnum' if n == 'expnum_src' else n}" for n, e in MEAS_EXPR.items()
                      if n != "exposure")
QUALITY = ("flags <= 0 AND class_star > 0.8e0 AND magerr_aper4 < 0.05e0 AND mag_aper4 > 17.0e0 "
           "AND mag_aper4 < 20.0e0 AND ccdnum NOT IN (6)")
TRUE_ZP = "31.4e0 + ((expnum*7 + ccdnum*3) % 41 - 20)/1000.0e0"
KEY = "(expnum*1024 + ccdnum)"

STEPS = {
    "fx_meas": f"SELECT {MEAS_COLS} FROM lineitem",
    "fx_nodes": "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS expnum, CAST(l_linenumber AS INT) AS ccdnum FROM lineitem",
    "fx_chip": "SELECT expnum, ccdnum, ((expnum*11 + ccdnum*5) % 61 - 30)/1000.0e0 AS zpterm FROM fx_nodes",
    "fx_exposure": ("SELECT CAST(s_suppkey AS BIGINT) AS expnum, CASE WHEN s_suppkey % 10 = 9 THEN 'k4m' ELSE 'c4d' END AS instrument, "
                    "55900.3e0 + ((s_suppkey - s_suppkey % 5)/5e0*127) % 2600 + (s_suppkey % 5)*0.015e0 AS mjd FROM supplier"),
    "fx_exptime": ("SELECT CAST(s_suppkey AS BIGINT) AS expnum, CASE WHEN s_suppkey % 6 = 0 THEN 200.0e0 ELSE 90.0e0 END AS exptime "
                   "FROM supplier WHERE s_suppkey % 3 <> 2"),
    "fx_anchor": (f"SELECT expnum, ccdnum, CASE WHEN (expnum + ccdnum) % 50 = 0 THEN -9999.0e0 ELSE {TRUE_ZP}"
                  " + CASE WHEN expnum % 6 = 0 THEN 2.5e0*log10(200.0e0/90.0e0) ELSE 0.0e0 END END AS mag_zero"
                  " FROM fx_nodes WHERE expnum % 4 = 0"),
    "fx_stars": ("SELECT CAST(p_partkey AS BIGINT) AS objectid, 50.0e0 + (p_partkey % 997)/99.7e0 AS ra, "
                 "-35.0e0 + ((p_partkey*31) % 1009)/100.9e0 AS dec, 17.0e0 + (p_partkey % 300)/100.0e0 AS mag_true, "
                 "0.3e0 + (p_partkey % 20)/10.0e0 AS color, 0.02e0 + (p_partkey % 7)/100.0e0 AS ebv FROM part"),
    "anchors": ("SELECT a.expnum, a.ccdnum, a.mag_zero - 2.5e0*log10(coalesce(t.exptime, 90.0e0)/90.0e0) AS zp_fgcm "
                "FROM fx_anchor a LEFT JOIN fx_exptime t USING (expnum)"),
    "good_anchors": "SELECT * FROM anchors WHERE zp_fgcm > 25 AND zp_fgcm < 35",
    "zpterms": "SELECT c.expnum, c.ccdnum, c.zpterm FROM fx_chip c JOIN fx_exposure USING (expnum) WHERE c.ccdnum NOT IN (6)",
    "mjds": "SELECT expnum, mjd FROM fx_exposure WHERE instrument = 'c4d'",
    "cleaned": f"SELECT * FROM fx_meas WHERE {QUALITY}",
    "joined": ("SELECT m.objectid, m.expnum, m.ccdnum, m.mag_aper4 - c.zpterm AS m_inst, m.magerr_aper4 AS m_err, m.mjd, m.ra, m.dec, "
               "m.x, m.y, m.fwhm FROM cleaned m JOIN fx_exposure e USING (expnum) JOIN fx_chip c USING (expnum, ccdnum) "
               "WHERE e.instrument = 'c4d'"),
    "placed": f"SELECT *, {ang2pix(32, 'ra', 'dec')} AS healpix_pixel FROM joined",
    "ranked": ("SELECT *, row_number() OVER (PARTITION BY healpix_pixel, objectid ORDER BY m_err, expnum, ccdnum, mjd) AS rk FROM placed"),
    "cap15": "SELECT * FROM ranked WHERE rk <= 15",
    "counted": "SELECT *, count(*) OVER (PARTITION BY healpix_pixel, objectid) AS nd FROM ranked WHERE rk <= 25",
    "det": "SELECT * EXCLUDE (rk, nd) FROM counted WHERE nd >= 2",
    "member_all": f"SELECT DISTINCT healpix_pixel, objectid, {KEY} AS node FROM det",
    "members": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY healpix_pixel, objectid) AS nn FROM member_all) WHERE nn >= 2",
    "edges": ("SELECT a.node AS src, b.node AS dst, count(*) AS n_shared FROM members a JOIN members b "
              "USING (healpix_pixel, objectid) WHERE a.node < b.node GROUP BY 1, 2"),
    "nodes": "SELECT DISTINCT node // 1024 AS expnum, CAST(node % 1024 AS INT) AS ccdnum FROM members",
    "positions": ("SELECT expnum, ccdnum, avg(ra) AS ra_mean, avg(dec) AS dec_mean FROM (SELECT healpix_pixel, expnum, ccdnum, "
                  "avg(ra) AS ra, avg(dec) AS dec FROM det GROUP BY ALL) GROUP BY ALL"),
    "trial_zp": ("SELECT expnum, ccdnum, CASE WHEN (expnum*3 + ccdnum) % 37 = 0 THEN 0.0e0 ELSE "
                 f"{TRUE_ZP} + ((expnum*13 + ccdnum*5) % 7 - 3)/2000.0e0 + CASE WHEN expnum % 23 = 5 THEN 0.4e0 ELSE 0.0e0 END END AS zp_solved "
                 "FROM (SELECT DISTINCT expnum, ccdnum FROM det)"),
    "live_zp": "SELECT * FROM trial_zp WHERE zp_solved > 1.0",
    "usable_zp": "SELECT * FROM trial_zp WHERE zp_solved > (SELECT median(zp_solved) FROM live_zp) - 5.0",
    "trial_table": ("SELECT z.expnum, z.ccdnum, 'g' AS band, z.zp_solved, a.zp_fgcm, z.zp_solved - a.zp_fgcm AS delta_zp "
                    "FROM trial_zp z LEFT JOIN anchors a USING (expnum, ccdnum)"),
    "ref_table": "SELECT * FROM trial_table WHERE zp_solved > 1.0 AND zp_fgcm > 25 AND zp_fgcm < 35",
    "valid_table": "SELECT * FROM trial_table WHERE zp_fgcm > 25 AND zp_fgcm < 35",
    # pairs and matrices
    "numbered": f"SELECT *, {KEY} AS node, row_number() OVER (PARTITION BY healpix_pixel, objectid ORDER BY expnum, ccdnum, m_inst, m_err) AS sq FROM det",
    "pairs": ("SELECT a.node AS i, b.node AS j, 1.0e0/(a.m_err*a.m_err + b.m_err*b.m_err) AS w, "
              "(a.m_inst - b.m_inst)/(a.m_err*a.m_err + b.m_err*b.m_err) AS wdm FROM numbered a JOIN numbered b "
              "USING (healpix_pixel, objectid) WHERE a.sq < b.sq"),
    "links": "SELECT i, j, sum(w) AS w, sum(wdm) AS wdm FROM pairs WHERE i < j GROUP BY ALL",
    "twoway": "SELECT i, j, w, wdm FROM links UNION ALL SELECT j, i, w, -wdm FROM links",
    "flat": ("SELECT ccdnum, e AS epoch_idx, ((ccdnum*3 + e*2) % 5 - 2)/1000.0e0 AS flat_correction FROM "
             "(SELECT DISTINCT ccdnum FROM det), (SELECT unnest([0, 1, 2, 3]) AS e)"),
    "gray_rows": ("SELECT d.healpix_pixel, d.objectid, d.expnum, d.ccdnum, d.m_inst + coalesce(f.flat_correction, 0.0e0) AS m, d.m_err, "
                  "row_number() OVER (PARTITION BY d.healpix_pixel, d.objectid ORDER BY d.expnum, d.ccdnum, d.m_inst, d.m_err) AS sq "
                  f"FROM (SELECT d.* EXCLUDE (mjd), t.mjd, {EPOCH_SHARED.replace('mjd', 't.mjd')} AS epoch_idx FROM det d JOIN mjds t USING (expnum)) d "
                  "LEFT JOIN flat f USING (ccdnum, epoch_idx)"),
    "gray_pairs": ("SELECT a.expnum AS i, b.expnum AS j, 1.0e0/(a.m_err*a.m_err + b.m_err*b.m_err) AS w, "
                   "(a.m - b.m)/(a.m_err*a.m_err + b.m_err*b.m_err) AS wdm FROM gray_rows a JOIN gray_rows b "
                   "USING (healpix_pixel, objectid) WHERE a.sq < b.sq"),
    "gray_links": "SELECT i, j, sum(w) AS w, sum(wdm) AS wdm FROM gray_pairs WHERE i < j GROUP BY ALL",
    "gray_twoway": "SELECT i, j, w, wdm FROM gray_links UNION ALL SELECT j, i, w, -wdm FROM gray_links",
    "sized": "SELECT expnum, ccdnum, count(*) OVER (PARTITION BY expnum) AS n FROM nodes",
    "reg_links": ("SELECT a.expnum*1024 + a.ccdnum AS i, b.expnum*1024 + b.ccdnum AS j, 100.0e0/a.n AS w FROM sized a JOIN sized b "
                  "USING (expnum) WHERE a.ccdnum <> b.ccdnum"),
    "lagged": "SELECT *, lead(expnum) OVER (ORDER BY mjd, expnum) AS nx, lead(mjd) OVER (ORDER BY mjd, expnum) AS nm FROM mjds",
    # residuals and flags
    "cal": "SELECT d.*, z.zp_solved, d.m_inst + z.zp_solved AS m_cal, 1.0e0/(d.m_err*d.m_err) AS w FROM det d JOIN live_zp z USING (expnum, ccdnum)",
    "resid": ("SELECT *, m_cal - m_star_mean AS residual FROM (SELECT *, sum(w*m_cal) OVER (PARTITION BY objectid) / "
              "sum(w) OVER (PARTITION BY objectid) AS m_star_mean, count(*) OVER (PARTITION BY objectid) AS n_det FROM cal)"),
    "star_chi2": ("SELECT objectid, sum((residual/m_err)*(residual/m_err)) AS chi2, count(*) - 1 AS dof, "
                  "count(*) FILTER (abs(residual) > 4.0e0*m_err) AS n_bad, "
                  "count(*) FILTER (abs(residual) > 0.5e0*m_err) AS n_half FROM resid GROUP BY objectid"),
    "exp_med": "SELECT expnum, median(zp_solved) AS zp_exp_median FROM trial_zp GROUP BY expnum",
    "bad_exps": ("SELECT * FROM (SELECT *, abs(zp_exp_median - median(zp_exp_median) OVER (PARTITION BY night)) AS zp_deviation FROM "
                 "(SELECT expnum, zp_exp_median, mjd, CAST(floor(mjd) AS BIGINT) AS night FROM exp_med JOIN mjds USING (expnum))) WHERE zp_deviation > 0.3e0"),
    "scatter": "SELECT expnum, ccdnum, stddev_samp(residual) AS scatter, count(*) AS n FROM resid GROUP BY ALL HAVING count(*) >= 3",
    "scatter_mid": "SELECT median(scatter) AS m FROM scatter",
    "scatter_cut": ("SELECT greatest(m + 3.0e0*(CASE WHEN mad > 0 THEN 1.4826e0*mad ELSE s END), 0.05e0) AS threshold FROM (SELECT any_value(m) AS m, "
                    "median(abs(scatter - m)) AS mad, stddev_samp(scatter) AS s FROM scatter, scatter_mid)"),
    "plane": ("SELECT r.*, " + epoch_ccd("ccdnum") + " AS epoch FROM resid r"),
    "plane_med": "SELECT ccdnum, epoch, median(residual) AS med, stddev_pop(residual) AS sd FROM plane GROUP BY ALL",
    "plane_stats": ("SELECT ccdnum, epoch, count(*) AS n, any_value(med) AS median, median(abs(residual - med)) AS mad, any_value(sd) AS sd "
                    "FROM plane JOIN plane_med USING (ccdnum, epoch) GROUP BY ALL"),
    # catalog
    "det_units": ("SELECT *, " + epoch_ccd("ccdnum") + f" AS epoch, {EPOCH_SHARED} AS epoch_idx, "
                  "2.0e0*(x - 1.0e0)/2047.0e0 - 1.0e0 AS ux, 2.0e0*(y - 1.0e0)/4095.0e0 - 1.0e0 AS uy FROM det"),
    "det_sf": f"SELECT *, {cheb_sum()} AS delta_sf FROM det_units",
    "magzero": ("SELECT median(a.zp_fgcm - z.zpterm) AS mz FROM good_anchors a JOIN zpterms z USING (expnum, ccdnum) WHERE abs(z.zpterm) < 2.0e0"),
    "cat_all": ("SELECT d.objectid, d.healpix_pixel, d.expnum, d.ccdnum, d.mjd, d.ra, d.dec, 1.0e0/(d.m_err*d.m_err) AS w, "
                "d.m_inst + z.zp_solved - (SELECT mz FROM magzero) - d.delta_sf AS m_cal, d.m_inst + coalesce(t.zpterm, 0.0e0) AS m_before, "
                "d.m_inst + coalesce(t.zpterm, 0.0e0) + coalesce(f.flat_correction, 0.0e0) AS m_flat "
                "FROM det_sf d JOIN usable_zp z USING (expnum, ccdnum) LEFT JOIN zpterms t USING (expnum, ccdnum) "
                "LEFT JOIN flat f USING (ccdnum, epoch_idx)"),
    "cat_mean": "SELECT objectid, sum(w*m_cal)/sum(w) AS mag FROM cat_all GROUP BY objectid",
    "catalog": ("SELECT objectid, any_value(ra) AS ra, any_value(dec) AS dec, any_value(mag) AS mag_cal_g, sum(w*m_flat)/sum(w) AS mag_starflat_g, "
                "sum(w*m_before)/sum(w) AS mag_before_g, 1.0e0/sqrt(sum(w)) AS magerr_cal_g, count(*) AS nobs_g, "
                "sum(w*(m_cal - mag)*(m_cal - mag))/greatest(count(*) - 1, 1) AS chi2_g FROM cat_all JOIN cat_mean USING (objectid) GROUP BY objectid"),
    "cat": "SELECT c.*, s.ebv AS ebv_sfd, s.color FROM catalog c JOIN fx_stars s USING (objectid)",
    "multi": "SELECT *, magerr_cal_g*sqrt(nobs_g)*1000.0e0 AS scatter_mmag FROM cat WHERE nobs_g >= 3",
    # matches
    "second": ("SELECT objectid + 5000000 AS objid, ra + 0.3e0/3600 AS ra_mean, dec - 0.2e0/3600 AS dec_mean, "
               "mag_true + 0.1e0 AS g_mag, mag_true + 0.1e0 - 1.3e0*color AS i_mag FROM fx_stars WHERE objectid % 7 <> 0"),
    "near": ("SELECT s.objectid, o.objid, degrees(2*asin(least(sqrt(pow(sin(radians(o.dec_mean - s.dec)/2), 2) + cos(radians(s.dec))*cos(radians(o.dec_mean))*"
             "pow(sin(radians(o.ra_mean - s.ra)/2), 2)), 1.0)))*3600.0e0 AS sep_arcsec FROM fx_stars s JOIN second o "
             "ON o.dec_mean BETWEEN s.dec - 0.001e0 AND s.dec + 0.001e0 AND o.ra_mean BETWEEN s.ra - 0.001e0 AND s.ra + 0.001e0"),
    "matched": "SELECT objectid, objid, sep_arcsec FROM near WHERE sep_arcsec < 1.0e0 QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY sep_arcsec, objid) = 1",
    "gaia": ("SELECT objectid + 7000000 AS source_id, objectid, ra, dec, "
             "mag_true - (0.05e0 + 0.02e0*color + 0.01e0*color*color) - (0.004e0*(ra - 55.0e0) - 0.002e0*(dec + 30.0e0)) + CASE WHEN objectid % 83 = 0 THEN 0.4e0 ELSE 0.0e0 END AS bp, "
             "0.4e0 + 1.1e0*color AS bp_rp, CASE WHEN objectid % 41 = 0 THEN 20.0e0 ELSE 300.0e0 END AS snr, "
             "0.1e0 + (objectid % 12)/10.0e0 AS xmatch_dist FROM fx_stars"),
    "des_rows": ("SELECT d.objectid, d.m_inst, 1.0e0/(d.m_err*d.m_err) AS w, a.zp_fgcm, z.zp_solved, t.zpterm, coalesce(f.flat_correction, 0.0e0) AS fc "
                 f"FROM (SELECT det.* EXCLUDE (mjd), mjds.mjd, {EPOCH_SHARED.replace('mjd', 'mjds.mjd')} AS epoch_idx FROM det LEFT JOIN mjds USING (expnum)) d JOIN good_anchors a USING (expnum, ccdnum) "
                 "JOIN live_zp z USING (expnum, ccdnum) JOIN zpterms t USING (expnum, ccdnum) LEFT JOIN flat f USING (ccdnum, epoch_idx)"),
    "des_stars": ("SELECT objectid, sum(w*(m_inst + zp_fgcm))/sum(w) AS mf, sum(w*(m_inst + zp_solved))/sum(w) AS ms, "
                  "sum(w*(m_inst + zpterm + mz))/sum(w) AS mb, sum(w*(m_inst + zpterm + mz + fc))/sum(w) AS mc FROM des_rows, magzero GROUP BY objectid HAVING count(*) >= 2"),
    "t0": ("SELECT stddev_pop((ms - mf)*1000) AS rms_solved_mmag, stddev_pop((mc - mf)*1000) AS rms_starflat_mmag, "
           "stddev_pop((mb - mf)*1000) AS rms_before_mmag, count(*) AS n_stars FROM des_stars"),
    "q1": "SELECT quantile_cont(mag_cal_g, 0.2) AS q20, quantile_cont(mag_cal_g, 0.4) AS q40 FROM multi",
    "t1": ("SELECT (SELECT median(scatter_mmag) FROM multi, q1 WHERE mag_cal_g >= q20 AND mag_cal_g < q40) AS floor_mmag, "
           "(SELECT count(*) FROM multi) AS n_stars"),
    "t2": "SELECT sqrt(avg(delta_zp*1000*delta_zp*1000)) AS rms_mmag, count(*) AS n_nodes, median(delta_zp*1000) AS median_mmag FROM ref_table",
    "exp_pos": "SELECT expnum, median(ra) AS exp_ra, median(dec) AS exp_dec FROM det GROUP BY expnum",
    "diffs": ("SELECT t.expnum, t.ccdnum, p.exp_ra, coalesce(e.exptime, -1.0e0) AS exptime, t.delta_zp*1000 AS diff_mmag FROM valid_table t LEFT JOIN exp_pos p USING (expnum) "
              "LEFT JOIN fx_exptime e USING (expnum) WHERE t.zp_solved > 25 AND t.zp_solved < 35"),
    "exp_sets": "SELECT DISTINCT objectid, expnum FROM det",
    "exp_pairs": "SELECT a.expnum AS exp1, b.expnum AS exp2, count(*) AS n_shared FROM exp_sets a JOIN exp_sets b USING (objectid) WHERE a.expnum < b.expnum GROUP BY ALL",
    "fwhm": "SELECT objectid, expnum, ccdnum, min(fwhm) AS fwhm FROM fx_meas JOIN fx_exposure USING (expnum) GROUP BY ALL",
    "seen": "SELECT d.* EXCLUDE (fwhm), f.fwhm FROM det d JOIN fwhm f USING (objectid, expnum, ccdnum)",
    "grad": ("SELECT t.expnum, t.ccdnum, p.ra_mean AS ra, p.dec_mean AS dec, t.delta_zp*1000 AS a, (z.zpterm + mz - t.zp_fgcm)*1000 AS b, "
             "(t.zp_solved - (z.zpterm + mz))*1000 AS c, (t.zp_fgcm - z.zpterm)*1000 AS d FROM valid_table t JOIN zpterms z USING (expnum, ccdnum) "
             "JOIN positions p USING (expnum, ccdnum), magzero WHERE t.zp_solved BETWEEN 25 AND 35"),
    "medpos": ("SELECT expnum, ccdnum, avg(ra) AS ra_median, avg(dec) AS dec_median FROM (SELECT healpix_pixel, expnum, ccdnum, median(ra) AS ra, median(dec) AS dec "
               "FROM det GROUP BY ALL) GROUP BY ALL"),
    "dec_rows": "SELECT m.dec_median AS x, t.delta_zp*1000 AS y FROM valid_table t JOIN medpos m USING (expnum, ccdnum)",
}


def statement(final: str, extra: dict | None = None, recursive: bool = False) -> str:
    """The final SELECT preceded by every step it mentions, in dependency order."""
    steps = {**STEPS, **(extra or {})}
    order, seen = [], set()

    def visit(text):
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in steps and word not in seen:
                seen.add(word)
                visit(steps[word])
                order.append(word)

    visit(final)
    if not order:
        return final
    body = ",\n".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"


def clip_line(source: str, rounds: int, centred: bool) -> dict:
    """Steps of a straight-line fit y on x with sigma clipping on ``source`` (x, y)."""
    steps, keep = {}, "TRUE"
    for k in range(rounds):
        fit, sig = f"clipfit{k}", f"clipsig{k}"
        prev = f"{source}, clipsig{k-1}" if k else source
        steps[fit] = f"SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {prev} WHERE {keep}"
        spread = ("stddev_pop(y - a - b*x)" if centred else "sqrt(avg((y - a - b*x)*(y - a - b*x)))")
        joined = f"{source}, {fit}" + (f", (SELECT a AS pa, b AS pb, s AS ps FROM clipsig{k-1}) pv" if k else "")
        cond = f"abs(y - pa - pb*x) < 3.0e0*ps" if k else "TRUE"
        steps[sig] = f"SELECT any_value(a) AS a, any_value(b) AS b, {spread} AS s FROM {joined} WHERE {cond}"
        keep = "abs(y - a - b*x) < 3.0e0*s"
    last = rounds - 1
    steps["kept"] = f"SELECT {source}.* FROM {source}, clipsig{last} WHERE {keep}"
    steps["clipfin"] = "SELECT regr_slope(y, x) AS fb, regr_intercept(y, x) AS fa, count(*) AS fn FROM kept"
    return steps


def conjugate_gradients(links: str, vec: str, iterations: int, rtol: float = 1e-5, cg: str = "cg") -> dict:
    """Steps of textbook conjugate gradients, named after ``cg``; they stand still once converged."""
    steps = {f"{cg}x0": f"SELECT i, d, b, 0.0e0 AS x, b AS res, b AS p FROM {vec}",
             f"{cg}n0": f"SELECT sum(b*b) AS bb, sum(res*res) AS rr FROM {cg}x0"}
    for k in range(iterations):
        steps[f"{cg}q{k}"] = (f"SELECT v.i, any_value(v.d*v.p) - coalesce(sum(l.w*o.p), 0.0e0) AS q FROM {cg}x{k} v LEFT JOIN {links} l ON l.i = v.i "
                              f"LEFT JOIN {cg}x{k} o ON o.i = l.j GROUP BY v.i")
        steps[f"{cg}a{k}"] = (f"SELECT CASE WHEN any_value(n.rr) > {rtol}*{rtol}*any_value(n.bb) THEN any_value(n.rr)/sum(v.p*q.q) ELSE 0.0e0 END AS alpha "
                              f"FROM {cg}x{k} v JOIN {cg}q{k} q USING (i), {cg}n{k} n")
        steps[f"{cg}r{k}"] = (f"SELECT v.i, v.d, v.b, v.x + alpha*v.p AS x, v.res - alpha*q.q AS res, v.p FROM {cg}x{k} v JOIN {cg}q{k} q USING (i), {cg}a{k}")
        steps[f"{cg}n{k+1}"] = f"SELECT sum(b*b) AS bb, sum(res*res) AS rr FROM {cg}r{k}"
        steps[f"{cg}x{k+1}"] = (f"SELECT i, d, b, x, res, res + (n1.rr/n0.rr)*p AS p FROM {cg}r{k}, (SELECT rr FROM {cg}n{k+1}) n1, (SELECT rr FROM {cg}n{k}) n0")
    steps[f"{cg}end"] = f"SELECT i, x FROM {cg}x{iterations}"
    return steps


def elimination(name: str, source: str, features: list, target: str, keys: str = "", where: str = "TRUE") -> dict:
    """Steps of least squares by Gaussian elimination over sums: ``name`` has the keys, n and coefficients c0, c1, ..."""
    k, lead = len(features), f"{keys}, " if keys else ""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"sum(({features[i]})*({features[j]})) AS g{i}_{j}" for i, j in pairs] + [f"sum(({f})*({target})) AS b{i}" for i, f in enumerate(features)]
    steps = {f"{name}s0": f"SELECT {lead}count(*) AS n, {', '.join(sums)} FROM {source} WHERE {where}" + (f" GROUP BY {keys}" if keys else "")}
    for p in range(k):
        out = [f"g{i}_{j}" + (f" - g{p}_{i}*g{p}_{j}/g{p}_{p} AS g{i}_{j}" if i > p else "") for i, j in pairs]
        out += [f"b{i}" + (f" - g{p}_{i}*b{p}/g{p}_{p} AS b{i}" if i > p else "") for i in range(k)]
        steps[f"{name}s{p+1}"] = f"SELECT {lead}n, {', '.join(out)} FROM {name}s{p}"
    back = [f"(b{i}" + "".join(f" - g{i}_{j}*c{j}" for j in range(i + 1, k)) + f")/g{i}_{i} AS c{i}" for i in range(k - 1, -1, -1)]
    steps[name] = f"SELECT {lead}n, {', '.join(back)} FROM {name}s{k}"
    return steps


def weighted(features: list, first: int = 0) -> str:
    """The fitted value from the coefficients of ``elimination``; ``first`` leaves out leading terms."""
    return " + ".join(f"c{i}*({f})" for i, f in enumerate(features) if i >= first)


def clip_fit(name: str, source: str, features: list, target: str, rounds: int, centred: bool) -> dict:
    """Steps of a fit with 3 sigma clipping over all rows: ``{name}k`` has the rows with ``keep``, ``{name}fit`` the last coefficients."""
    steps = {f"{name}k0": f"SELECT *, TRUE AS keep FROM {source}"}
    for k in range(rounds):
        steps |= elimination(f"{name}f{k}", f"{name}k{k}", features, target, where="keep")
        spread = "stddev_pop(e)" if centred else "sqrt(avg(e*e))"
        steps[f"{name}e{k}"] = f"SELECT s.*, ({target}) - ({weighted(features)}) AS e FROM {name}k{k} s, {name}f{k}"
        steps[f"{name}k{k+1}"] = (f"SELECT * EXCLUDE (keep, e), abs(e) < 3.0e0*(SELECT {spread} FROM {name}e{k} WHERE keep) AS keep FROM {name}e{k}")
    steps[f"{name}k"] = f"SELECT * FROM {name}k{rounds}"
    return steps | elimination(f"{name}fit", f"{name}k", features, target, where="keep")


#: Two-sided p of a correlation r over n rows, by the finite sums of Student's t for whole degrees of freedom.
T_TEST = ("CASE WHEN n > 2 THEN 1.0e0 - (CASE WHEN (n - 2) % 2 = 1 THEN 2.0e0/pi()*(asin(abs(r)) + abs(r)*sqrt(1 - r*r)*coalesce((SELECT "
          "sum(exp(k*ln(4.0e0) + 2*lgamma(k + 1.0e0) - lgamma(2*k + 2.0e0) + k*ln(1 - r*r))) FROM range(0, CAST((n - 3)//2 AS BIGINT)) t(k)), 0)) "
          "ELSE abs(r)*(SELECT sum(exp(lgamma(2*k + 1.0e0) - k*ln(4.0e0) - 2*lgamma(k + 1.0e0) + k*ln(1 - r*r))) FROM range(0, CAST((n - 2)//2 AS BIGINT)) t(k)) END) END")


def node_of(key: str) -> str:
    return f"{key} // 1024 AS expnum, CAST({key} % 1024 AS INT) AS ccdnum"


def _build() -> dict:
    o = {}
    det_cols = "healpix_pixel, objectid, expnum, ccdnum"
    o["f1_quality_cuts"] = statement(
        f"SELECT objectid, concat('c4d_', expnum) AS exposure, ccdnum, {cols('mag_aper4', 'magerr_aper4', 'mjd', 'ra', 'dec')} FROM cleaned")
    o["j1_j2_local_joins"] = statement(
        f"SELECT objectid, expnum, ccdnum, 'g' AS band, {cols('m_inst', 'm_err', 'x', 'y')} FROM joined")
    o["j4_zpterms"] = statement(
        f"SELECT c.expnum, c.ccdnum, {cols('zpterm')} FROM fx_chip c JOIN fx_exposure USING (expnum)")
    sky = ("SELECT objectid, ((objectid*7919) % 36000)/100.0e0 + 0.00317e0 AS sra, ((objectid*1047) % 17990)/100.0e0 - 89.94937e0 AS sdec FROM fx_stars")
    pix = {"skypts": sky, "skypix": f"SELECT objectid, {ang2pix(32, 'sra', 'sdec')} AS healpix_pixel FROM skypts"}
    o["x1_healpix"] = statement("SELECT objectid, healpix_pixel FROM skypix", pix)
    ns, total, ncap = 32, 12288, 1984
    pix["ringed"] = (
        f"SELECT p, CASE WHEN p < {ncap} THEN rn WHEN p >= {total-ncap} THEN rs ELSE (p - {ncap}) // 128 + 32 END AS ring, rn, rs FROM "
        f"(SELECT p, (SELECT max(k) FROM range(1, 130) t(k) WHERE 2*k*(k-1) <= p) AS rn, (SELECT max(k) FROM range(1, 130) t(k) WHERE 2*k*(k-1) <= {total-1} - p) AS rs "
        "FROM (SELECT DISTINCT healpix_pixel AS p FROM skypix))")
    pix["centers"] = (
        f"SELECT p, CASE WHEN p < {ncap} THEN 1.0e0 - rn*rn/{3.0*ns*ns} WHEN p >= {total-ncap} THEN -(1.0e0 - rs*rs/{3.0*ns*ns}) ELSE ({2*ns} - ring)*{2.0/(3.0*ns)!r} END AS z, "
        f"CASE WHEN p < {ncap} THEN (p - 2*rn*(rn-1) + 0.5e0)*90.0e0/rn WHEN p >= {total-ncap} THEN (4*rs - 1 - ({total-1} - p - 2*rs*(rs-1)) + 0.5e0)*90.0e0/rs "
        f"ELSE ((p - {ncap}) % 128 + 0.5e0 - ((ring - 32) % 2)/2.0e0)*{90.0/ns} END AS ra FROM ringed")
    pix["boxed"] = "SELECT p, ra, degrees(asin(z)) AS dec, sqrt(4*pi()*pow(180/pi(), 2)/12288/pi())*1.5 AS rad FROM centers"
    o["x3_pixel_box"] = statement(
        "SELECT p AS healpix_pixel, " + cols("ra_center=ra", "dec_center=dec", "ra_min=ra - rad/greatest(cos(radians(dec)), 0.1)",
                                             "ra_max=ra + rad/greatest(cos(radians(dec)), 0.1)", "dec_min=dec - rad", "dec_max=dec + rad") + " FROM boxed", pix)
    patch = {"patch": f"SELECT DISTINCT {ang2pix(32, '50.0e0 + (k % 100)*(10.0e0/99)', '-35.0e0 + (k // 100)*(10.0e0/99)')} AS healpix_pixel FROM range(10000) t(k)",
             "starpix": f"SELECT objectid, {ang2pix(32, 'ra', 'dec')} AS healpix_pixel FROM fx_stars"}
    o["x4_region_stars"] = statement(
        "SELECT healpix_pixel, count(objectid) AS n_stars FROM patch LEFT JOIN starpix USING (healpix_pixel) GROUP BY ALL", patch)
    # the patch lies in the belt, where every ring has 4 nside cells
    def around(ns: int, where: str) -> str:
        upper = f"floor({ns}*(2.0e0 - 1.5e0*cos(radians(90.0e0 - dec))))"
        parts = []
        for ring, share in (("up", "1.0e0 - down"), ("up + 1", "down")):
            off = f"(CASE WHEN ({ring} - {ns}) % 2 = 0 THEN 0.5e0 ELSE 0.0e0 END)"
            x = f"(ra/360.0e0*{4*ns} - {off})"
            for k, along in ((0, f"(1.0e0 - {x} + floor({x}))"), (1, f"({x} - floor({x}))")):
                parts.append(f"SELECT objectid, {ns} AS ns, CAST({2*ns*(ns-1)} + ({ring} - {ns})*{4*ns} + ((floor({x}) + {k}) % {4*ns}) AS BIGINT) AS pixel, {along}*({share}) AS wt FROM u{ns}")
        theta = lambda r: f"acos(({2*ns} - ({r}))*{2.0/(3*ns)!r})"
        return {f"u{ns}": (f"SELECT *, (radians(90.0e0 - dec) - {theta('up')})/({theta('up + 1')} - {theta('up')}) AS down FROM "
                           f"(SELECT objectid, ra, dec, {upper} AS up FROM fx_stars WHERE {where})"),
                f"a{ns}": " UNION ALL ".join(parts)}

    dust = {**around(16, "TRUE"), **around(64, "TRUE"),
            "dustmap": ("SELECT ns, pixel, 0.02e0 + ((pixel*37) % 101)/1000.0e0 + ns/10000.0e0 AS ebv FROM (SELECT DISTINCT ns, pixel FROM a16 "
                        "UNION SELECT DISTINCT ns, pixel FROM a64 JOIN fx_stars USING (objectid) WHERE ra > 54)"),
            "dusted": ("SELECT objectid, ns, sum(wt*ebv)/sum(wt) AS ebv_sfd, sum(wt) AS known FROM (SELECT * FROM a16 UNION ALL SELECT * FROM a64) JOIN dustmap USING (ns, pixel) GROUP BY ALL")}
    o["s17_dust_lookup"] = statement(
        f"SELECT objectid, CAST(ns AS INT) AS nside, {cols('ebv_sfd')} FROM dusted WHERE known > 0 QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY known >= 1 - 1.0e-9 DESC, ns DESC) = 1", dust)
    every = {"allpix": "SELECT k AS p, k AS healpix_pixel FROM range(12288) t(k)", **{k: pix[k].replace("(SELECT DISTINCT healpix_pixel AS p FROM skypix)", "(SELECT p FROM allpix)")
                                                                                    for k in ("ringed", "centers")},
             "starpix": f"SELECT objectid, {ang2pix(32, 'ra', 'dec')} AS healpix_pixel FROM fx_stars"}
    o["x5_footprint"] = statement(
        f"SELECT p AS healpix_pixel, {cols('ra_center=ra', 'dec_center=degrees(asin(z))')}, coalesce(n, 0) AS n_stars FROM centers LEFT JOIN "
        "(SELECT healpix_pixel AS p, count(*) AS n FROM starpix GROUP BY 1) USING (p) WHERE degrees(asin(z)) < -29.5", every)
    o["w1_detection_cap"] = statement(f"SELECT {det_cols}, {cols('m_inst', 'm_err')} FROM ranked WHERE rk <= 25")
    o["w1_detection_cap15"] = statement(f"SELECT {det_cols}, {cols('m_inst', 'm_err')} FROM cap15")
    o["f5_min_detections"] = statement(
        f"SELECT {det_cols}, {cols('m_inst', 'm_err')} FROM cap15 QUALIFY count(*) OVER (PARTITION BY healpix_pixel, objectid) >= 13")
    arriving = {"arrived": f"SELECT {MEAS_COLS}, row_number() OVER () AS arrival_row FROM lineitem",
                "arrived_good": f"SELECT *, {ang2pix(32, 'ra', 'dec')} AS healpix_pixel FROM arrived WHERE {QUALITY}",
                "arrived_det": ("SELECT m.objectid, m.healpix_pixel, m.expnum, m.ccdnum, m.mag_aper4 - c.zpterm AS m_inst, m.magerr_aper4 AS m_err, "
                                "row_number() OVER (PARTITION BY m.healpix_pixel, m.objectid ORDER BY m.arrival_row) AS arrival_rank FROM arrived_good m "
                                "JOIN fx_exposure e USING (expnum) JOIN fx_chip c USING (expnum, ccdnum) WHERE e.instrument = 'c4d'")}
    o["w3_arrival_index"] = statement(f"SELECT {det_cols}, arrival_rank - 1 AS arrival, {cols('m_inst', 'm_err')} FROM arrived_det", arriving)
    o["s8_arrival_cap"] = statement(f"SELECT {det_cols}, objectid AS star_id, {cols('m_inst', 'm_err')} FROM arrived_det WHERE arrival_rank <= 15", arriving)
    o["k1_detections"] = statement(
        f"SELECT {det_cols}, 'g' AS band, {cols('m_inst', 'm_err', 'mjd', 'ra', 'dec', 'x', 'y')} FROM det")
    o["a1_star_means"] = statement(
        "SELECT objectid, " + cols("mag_mean=sum(m_inst/(m_err*m_err))/sum(1.0e0/(m_err*m_err))", "mag_err=1.0e0/sqrt(sum(1.0e0/(m_err*m_err)))")
        + ", count(*) AS n_det FROM det GROUP BY objectid")
    o["a10_ingest_stats"] = statement(
        "SELECT count(*) AS n_detections, count(DISTINCT objectid) AS n_stars, count(DISTINCT expnum) AS n_exposures, "
        f"count(DISTINCT {KEY}) AS n_ccd_exposures, count(DISTINCT healpix_pixel) AS n_pixels FROM det")
    o["u3_missing_pixels"] = statement(
        "SELECT healpix_pixel FROM region EXCEPT SELECT healpix_pixel FROM det",
        {"region": f"SELECT DISTINCT {ang2pix(32, '50.0e0 + (k % 150)*(20.0e0/149)', '-40.0e0 + (k // 150)*(15.0e0/149)')} AS healpix_pixel FROM range(22500) t(k)"})
    o["t15_node_positions"] = statement(f"SELECT expnum, ccdnum, {cols('ra_mean', 'dec_mean')} FROM positions")
    o["w6_dense_index"] = statement(
        "SELECT expnum, ccdnum, row_number() OVER (ORDER BY expnum, ccdnum) - 1 AS idx FROM (SELECT DISTINCT expnum, ccdnum FROM det)")
    o["u2_keep_first"] = statement(
        f"SELECT objectid, expnum, ccdnum, {cols('m_inst', 'm_err')} FROM det QUALIFY row_number() OVER (PARTITION BY objectid, expnum, ccdnum ORDER BY m_err, m_inst) = 1")

    o["x2a_epoch"] = statement(
        f"SELECT expnum, {cols('mjd')}, {EPOCH_SHARED} AS epoch, CAST(floor(mjd) AS BIGINT) AS night FROM fx_exposure")
    o["x2b_epoch_ccd"] = statement(
        f"SELECT expnum, ccdnum, {epoch_ccd('CASE WHEN ccdnum = 7 THEN 41 ELSE ccdnum END')} AS epoch FROM fx_nodes JOIN fx_exposure USING (expnum)")
    o["p4_exptime_norm"] = statement(f"SELECT expnum, ccdnum, {cols('zp_fgcm')} FROM anchors")
    o["p13_program_class"] = statement(
        "SELECT CASE WHEN instrument <> 'c4d' THEN 'non-DES' WHEN exptime IS NULL THEN 'DECam_no_DES_ZP' WHEN exptime = 90 THEN 'DES_survey_90s' "
        "WHEN exptime IN (175, 200) THEN 'DES_SN_deep' ELSE 'DES_other' END AS program, count(*) AS n_exposures, CAST(sum(n_det) AS BIGINT) AS n_detections "
        "FROM (SELECT expnum, count(*) AS n_det FROM det GROUP BY expnum) JOIN fx_exposure USING (expnum) LEFT JOIN fx_exptime USING (expnum) GROUP BY ALL")
    o["w4_consecutive"] = statement(
        f"SELECT expnum, nx AS next_expnum, {cols('mjd', 'gap=nm - mjd')} FROM lagged WHERE nm - mjd < 0.02e0")

    o["a11_edges"] = statement(
        "SELECT src // 1024 AS exp1, CAST(src % 1024 AS INT) AS ccd1, dst // 1024 AS exp2, CAST(dst % 1024 AS INT) AS ccd2, n_shared FROM edges")
    stats = ("count(*) AS n_edges, min(n_shared) AS edge_stars_min, CAST(trunc(median(n_shared)) AS INT) AS edge_stars_median, "
             + cols("edge_stars_mean=avg(n_shared)") + ", max(n_shared) AS edge_stars_max")
    o["a12_edge_stats"] = statement(f"SELECT {stats} FROM edges")
    comp = {"split_all": f"SELECT DISTINCT healpix_pixel, objectid, expnum % 3 AS part, {KEY} AS node FROM det",
            "split_mem": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY healpix_pixel, objectid, part) AS nn FROM split_all) WHERE nn >= 2",
            "hubs": "SELECT healpix_pixel, objectid, part, min(node) AS hub FROM split_mem GROUP BY ALL",
            "ties": "SELECT DISTINCT node AS u, hub AS v FROM split_mem JOIN hubs USING (healpix_pixel, objectid, part) WHERE node <> hub",
            "ties2": "SELECT u, v FROM ties UNION SELECT v, u FROM ties",
            "reach": "SELECT DISTINCT node, node AS label FROM split_mem UNION SELECT t.v, r.label FROM reach r JOIN ties2 t ON t.u = r.node WHERE r.label < t.v",
            "comps": "SELECT node, min(label) AS root FROM reach GROUP BY node",
            "sizes": "SELECT root, count(*) AS sz, max(CAST((node // 1024) % 4 = 0 AS INT)) AS has FROM comps GROUP BY root",
            "picked": "SELECT root FROM sizes WHERE has = 1 ORDER BY sz DESC, root LIMIT 1"}
    o["g1_components"] = statement(
        f"SELECT {node_of('node')}, root // 1024 AS root_exp, CAST(root % 1024 AS INT) AS root_ccd FROM comps"
        .replace("AS expnum", "AS exp").replace("AS ccdnum", "AS ccd"), comp, recursive=True)
    o["g4_des_component"] = statement(
        f"SELECT {node_of('node')}, (node // 1024) % 4 = 0 AS is_anchor, root = (SELECT root FROM picked) AS connected FROM comps", comp, recursive=True)
    full = {k: v.replace("expnum % 3 AS part", "0 AS part") for k, v in comp.items()}
    o["g6_connectivity"] = statement(
        "SELECT * FROM (SELECT count(*) AS n_nodes_total, count(*) FILTER (root = (SELECT root FROM picked)) AS n_nodes_connected, "
        "count(*) FILTER (root <> (SELECT root FROM picked)) AS n_nodes_dropped, count(*) FILTER (root = (SELECT root FROM picked) AND (node // 1024) % 4 = 0) AS n_anchor_nodes, "
        + cols("pct_connected=100.0*count(*) FILTER (root = (SELECT root FROM picked))/count(*)") + " FROM comps), "
        "(SELECT count(*) AS n_components, max(sz) AS largest_component FROM sizes), "
        "(SELECT count(*) AS n_stars, CAST(sum(c) AS BIGINT) AS n_detections FROM (SELECT count(*) AS c FROM det GROUP BY healpix_pixel, objectid)), "
        f"(SELECT {stats} FROM edges)", full, recursive=True)
    o["g7_exposure_overlaps"] = statement(
        f"SELECT exp1, exp2, n_shared, {cols('dra=abs(a.exp_ra - b.exp_ra)')} FROM exp_pairs LEFT JOIN exp_pos a ON a.expnum = exp1 LEFT JOIN exp_pos b ON b.expnum = exp2")
    spread = {"spread": "SELECT expnum, (max(ra_mean) - 50.0e0)*40.0e0 AS sra FROM positions GROUP BY expnum",
              "dist": "SELECT abs(a.sra - b.sra) AS dra FROM exp_pairs JOIN spread a ON a.expnum = exp1 JOIN spread b ON b.expnum = exp2"}
    o["g7_reach"] = statement(
        "SELECT count(*) AS n_pairs, count(*) FILTER (dra > 2) AS n_beyond_2deg, count(*) FILTER (dra > 5) AS n_beyond_5deg, "
        "count(*) FILTER (dra > 8) AS n_beyond_8deg FROM dist", spread)
    o["a25_exposure_degree"] = statement(
        "SELECT expnum, count(*) AS n_overlaps FROM (SELECT exp1 AS expnum FROM exp_pairs UNION ALL SELECT exp2 FROM exp_pairs) GROUP BY expnum")

    for name, two in (("l1_normal_matrix", "twoway"), ("l2_gray_matrix", "gray_twoway")):
        o[name] = statement(f"SELECT i, j, {cols('v=-w', digits=3)} FROM {two} UNION ALL SELECT i, i, {cols('v=sum(w)', digits=3)} FROM {two} GROUP BY i")
    for name, two in (("l1_rhs", "twoway"), ("l2_gray_rhs", "gray_twoway")):
        o[name] = statement(f"SELECT i, {cols('rhs=-sum(wdm)', digits=3)} FROM {two} GROUP BY i")
    o["l1_counts"] = statement(
        "SELECT (SELECT count(DISTINCT (healpix_pixel, objectid)) FROM det) AS n_stars, count(*) AS n_pairs, count(*) FILTER (i = j) AS n_self FROM pairs")
    o["l2_gray_counts"] = statement("SELECT count(*) FILTER (i < j) AS n_pairs, count(*) FILTER (i = j) AS n_intra FROM gray_pairs")
    o["l3_exposure_reg"] = statement(
        f"SELECT i, j, {cols('v=-w')} FROM reg_links UNION ALL SELECT i, i, {cols('v=sum(w)')} FROM reg_links GROUP BY i")
    o["l5_temporal_links"] = statement(
        f"SELECT least(expnum, nx) AS i, greatest(expnum, nx) AS j, {cols('w=10000.0e0')} FROM lagged2 WHERE nm - mjd < 0.02e0",
        {"timed": "SELECT expnum, mjd FROM mjds WHERE expnum IN (SELECT expnum FROM det)",
         "lagged2": "SELECT *, lead(expnum) OVER (ORDER BY mjd, expnum) AS nx, lead(mjd) OVER (ORDER BY mjd, expnum) AS nm FROM timed"})
    o["l6_anchor_terms"] = statement(
        f"SELECT {KEY} AS i, {cols('d=1.0e6', 'b=1.0e6*zp_fgcm')} FROM nodes JOIN good_anchors USING (expnum, ccdnum)")
    o["l7_prior_terms"] = statement(
        f"SELECT {KEY} AS i, {cols('d=300.0e0', 'b=300.0e0*coalesce(zpterm + 31.4389e0, 31.4e0)')} FROM nodes LEFT JOIN zpterms USING (expnum, ccdnum)")

    base = {"diag": "SELECT i, sum(w) AS d, -sum(wdm) AS b FROM twoway GROUP BY i",
            "keyed": f"SELECT {KEY} AS i, expnum, ccdnum FROM nodes"}
    tik = "1.0e-10"
    systems = {
        "l10_unanchored": f"SELECT k.i, coalesce(d, 0) + {tik} AS d, coalesce(b, 0) AS b FROM keyed k LEFT JOIN diag USING (i)",
        "l6_anchored": ("SELECT k.i, coalesce(d, 0) + CASE WHEN zp_fgcm IS NULL THEN 0 ELSE 1.0e6 END AS d, coalesce(b, 0) + coalesce(1.0e6*zp_fgcm, 0) AS b "
                        "FROM keyed k LEFT JOIN diag USING (i) LEFT JOIN good_anchors USING (expnum, ccdnum)"),
        "l7_prior_solve": (f"SELECT k.i, coalesce(d, 0) + 300.0e0 + {tik} AS d, coalesce(b, 0) + 300.0e0*coalesce(zpterm + 31.4389e0, (SELECT median(zpterm + 31.4389e0) FROM nodes JOIN zpterms USING (expnum, ccdnum))) AS b "
                           "FROM keyed k LEFT JOIN diag USING (i) LEFT JOIN zpterms USING (expnum, ccdnum)"),
    }
    for name, vec in systems.items():
        steps = {**base, "system": vec, **conjugate_gradients("twoway", "system", 24),
                 "raw": f"SELECT {node_of('i')}, x FROM cgend",
                 "shift": "SELECT coalesce(median(x - zp_fgcm), 0) AS off FROM raw JOIN good_anchors USING (expnum, ccdnum)"}
        final = (f"SELECT expnum, ccdnum, {cols('zp_solved=x')} FROM raw" if name == "l6_anchored"
                 else f"SELECT expnum, ccdnum, {cols('zp_solved=x - off')} FROM raw, shift")
        o[name] = statement(final, steps)
    gray = {"gdiag": "SELECT i, sum(w) AS d, -sum(wdm) AS b FROM gray_twoway GROUP BY i",
            "gsys": f"SELECT e.expnum AS i, coalesce(d, 0) + {tik} AS d, coalesce(b, 0) AS b FROM (SELECT DISTINCT expnum FROM nodes) e LEFT JOIN gdiag ON gdiag.i = e.expnum",
            **conjugate_gradients("gray_twoway", "gsys", 24),
            "glevel": "SELECT expnum, median(zp_fgcm) AS lv FROM nodes JOIN good_anchors USING (expnum, ccdnum) GROUP BY expnum",
            "goff": "SELECT coalesce(median(x - lv), 0) AS off FROM cgend JOIN glevel ON glevel.expnum = cgend.i",
            "gplaced": f"SELECT n.expnum, n.ccdnum, coalesce({EPOCH_SHARED}, 0) AS epoch_idx FROM nodes n LEFT JOIN mjds USING (expnum)"}
    o["l11_gray_solve"] = statement(
        f"SELECT p.expnum, p.ccdnum, {cols('zp_solved=x - off + coalesce(flat_correction, 0)')} FROM gplaced p JOIN cgend ON cgend.i = p.expnum "
        "LEFT JOIN flat USING (ccdnum, epoch_idx), goff", gray)
    # without deep exposures: node solve, flat over two epochs, gray solve
    deep = {"shallow": "SELECT expnum FROM (SELECT DISTINCT expnum FROM nodes) WHERE expnum NOT IN (SELECT expnum FROM fx_exptime WHERE exptime > 100)",
            "sub_pairs": ("SELECT i, j, w, wdm FROM pairs WHERE i // 1024 IN (SELECT expnum FROM shallow) AND j // 1024 IN (SELECT expnum FROM shallow) "
                          f"AND i IN (SELECT {KEY} FROM nodes) AND j IN (SELECT {KEY} FROM nodes)"),
            "sub_nodes": "SELECT i FROM sub_pairs UNION SELECT j FROM sub_pairs",
            "sub_links": "SELECT i, j, sum(w) AS w, sum(wdm) AS wdm FROM sub_pairs WHERE i < j GROUP BY ALL",
            "sub_twoway": "SELECT i, j, w, wdm FROM sub_links UNION ALL SELECT j, i, w, -wdm FROM sub_links",
            "sub_diag": "SELECT i, sum(w) AS d, -sum(wdm) AS b FROM sub_twoway GROUP BY i",
            "sub_vec": "SELECT n.i, coalesce(d, 0) + 1.0e-6 AS d, coalesce(b, 0) AS b FROM sub_nodes n LEFT JOIN sub_diag USING (i)",
            **conjugate_gradients("sub_twoway", "sub_vec", 24, cg="na"),
            "sub_zp": f"SELECT {node_of('i')}, i, x, mjd, CASE WHEN mjd IS NULL THEN 0 ELSE CAST(mjd >= 56404 AS INT) END AS ep FROM naend LEFT JOIN mjds ON mjds.expnum = i // 1024",
            "sub_delta": "SELECT ccdnum, ep, x - median(x) OVER (PARTITION BY expnum) AS dz, mjd FROM sub_zp",
            "sub_flat": "SELECT ccdnum, ep, CASE WHEN count(*) >= 3 THEN median(dz) ELSE 0 END AS f FROM sub_delta WHERE mjd IS NOT NULL GROUP BY ALL",
            "sub_shift": "SELECT z.*, coalesce(f, 0) AS f FROM sub_zp z LEFT JOIN sub_flat USING (ccdnum, ep)",
            "sg_links": ("SELECT a.expnum AS i, b.expnum AS j, sum(l.w) AS w, sum(l.wdm + l.w*(a.f - b.f)) AS wdm FROM sub_links l JOIN sub_shift a ON a.i = l.i "
                         "JOIN sub_shift b ON b.i = l.j WHERE a.expnum <> b.expnum AND a.mjd IS NOT NULL AND b.mjd IS NOT NULL GROUP BY ALL"),
            "sg_twoway": "SELECT i, j, w, wdm FROM sg_links UNION ALL SELECT j, i, w, -wdm FROM sg_links",
            "sg_diag": "SELECT i, sum(w) AS d, -sum(wdm) AS b FROM sg_twoway GROUP BY i",
            "sg_vec": ("SELECT n.i, coalesce(d, 0) + 1.0e-6 AS d, coalesce(b, 0) AS b FROM (SELECT DISTINCT expnum AS i FROM sub_zp) n LEFT JOIN sg_diag USING (i)"),
            **conjugate_gradients("sg_twoway", "sg_vec", 24, cg="nb"),
            "sub_whole": "SELECT s.expnum, s.ccdnum, g.x + s.f AS zp FROM sub_shift s JOIN nbend g ON g.i = s.expnum",
            "sub_off": "SELECT coalesce(median(zp_fgcm - zp), 0) AS off FROM sub_whole JOIN good_anchors USING (expnum, ccdnum)",
            "stretched": "SELECT expnum, (max(ra_mean) - 50.0e0)*2.0e0 + 45.0e0 AS exp_ra FROM positions GROUP BY expnum",
            "compared": ("SELECT s.expnum, s.ccdnum, e.exp_ra, (zp + off - zp_fgcm)*1000 AS normal_mmag, (zp_solved - zp_fgcm)*1000 AS full_mmag, (zp + off - zp_solved)*1000 AS change_mmag "
                         "FROM sub_whole s CROSS JOIN sub_off JOIN trial_table t USING (expnum, ccdnum) LEFT JOIN stretched e USING (expnum) "
                         "WHERE zp + off > 25 AND zp + off < 35 AND zp_solved > 25 AND zp_solved < 35 AND zp_fgcm > 25 AND zp_fgcm < 35"),
            "by_ra": ("SELECT CAST(floor(exp_ra - 49.0e0) AS INT) AS bin, count(*) AS n, median(normal_mmag) AS normal_mmag, median(full_mmag) AS full_mmag, "
                      "median(change_mmag) AS change_mmag FROM compared WHERE exp_ra IS NOT NULL GROUP BY 1 HAVING count(*) >= 11")}
    o["d1_without_deep"] = statement(f"SELECT expnum, ccdnum, {cols('exp_ra', 'normal_mmag', 'full_mmag', 'change_mmag', digits=3)} FROM compared", deep)
    o["d1_without_deep_by_ra"] = statement(f"SELECT bin, n, {cols('normal_mmag', 'full_mmag', 'change_mmag', digits=3)} FROM by_ra", deep)
    o["d1_without_deep_verdict"] = statement(
        f"SELECT n_nodes, {cols('rms_normal_mmag', 'rms_full_mmag', 'range_normal_mmag', 'range_full_mmag', digits=3)}, n_bins, CASE WHEN range_normal_mmag < 0.5*range_full_mmag "
        "THEN 'removed' WHEN range_normal_mmag > 0.8*range_full_mmag THEN 'kept' WHEN range_normal_mmag IS NOT NULL THEN 'reduced' END AS gradient FROM "
        "(SELECT count(*) AS n_nodes, stddev_samp(normal_mmag) AS rms_normal_mmag, stddev_samp(full_mmag) AS rms_full_mmag FROM compared), "
        "(SELECT count(*) AS n_bins, max(normal_mmag) - min(normal_mmag) AS range_normal_mmag, max(full_mmag) - min(full_mmag) AS range_full_mmag FROM by_ra)", deep)
    o["l12_diagnostics"] = statement(
        "SELECT * FROM (SELECT count(*) AS n_params, count(*) FILTER (zp_fgcm > 25 AND zp_fgcm < 35) AS n_des, "
        + cols("zp_std=stddev_pop(zp_solved)", "zp_median=median(zp_solved)") + " FROM trial_table), (SELECT "
        + cols("des_diff_rms=sqrt(avg(delta_zp*delta_zp))", "des_diff_max=max(abs(delta_zp))", "des_diff_median=median(delta_zp)") + " FROM valid_table)")
    o["p10_zeropoint_table"] = statement(f"SELECT expnum, ccdnum, band, {cols('zp_solved', 'zp_fgcm', 'delta_zp')} FROM trial_table")

    o["i1_residuals"] = statement(
        f"SELECT objectid, expnum, ccdnum, {cols('m_cal', 'm_star_mean', 'residual')}, n_det FROM resid")
    o["i2_variable_stars"] = statement(
        f"SELECT objectid, {cols('chi2')}, dof, {cols('chi2_dof=chi2/dof')} FROM star_chi2 WHERE dof >= 1 AND chi2/dof > 3.0")
    o["i2_outlier_dets"] = statement(
        f"SELECT objectid, expnum, ccdnum, {cols('residual')} FROM resid WHERE abs(residual) > 4.0e0*m_err")
    o["i2_bad_exposures"] = statement(
        f"SELECT expnum, {cols('zp_exp_median', 'mjd')}, night, {cols('zp_deviation')} FROM bad_exps")
    o["i2_bad_ccds"] = statement(
        f"SELECT expnum, ccdnum, {cols('scatter')}, n, {cols('threshold')} FROM scatter, scatter_half WHERE scatter > threshold",
        {"scatter_half": f"SELECT greatest(m + 0.5e0*(CASE WHEN mad > 0 THEN 1.4826e0*mad ELSE s END), 0.001e0) AS threshold FROM {SCATTER_SPREAD}"})
    o["i3_unusable_stars"] = statement(
        "SELECT objectid FROM star_chi2 WHERE dof >= 1 AND chi2/dof > 3.0 AND dof + 1 - n_half < 2")
    o["i4_apply_flags"] = statement(
        f"SELECT {det_cols}, {cols('m_inst', 'm_err')} FROM det WHERE objectid NOT IN (SELECT objectid FROM star_chi2 WHERE dof >= 1 AND chi2/dof > 300.0) "
        "AND (objectid, expnum, ccdnum) NOT IN (SELECT (objectid, expnum, ccdnum) FROM resid WHERE abs(residual) > 4.0e0*m_err) "
        "AND expnum NOT IN (SELECT expnum FROM bad_exps) AND (expnum + ccdnum) % 29 <> 0 "
        "QUALIFY count(*) OVER (PARTITION BY healpix_pixel, objectid) >= 2")
    o["a14_star_flat"] = statement(
        f"SELECT ccdnum, epoch_idx, {cols('flat_correction=CASE WHEN count(*) >= 3 THEN median(dz) ELSE 0.0 END')} FROM (SELECT ccdnum, zp_solved - gm AS dz, {EPOCH_SHARED} AS epoch_idx "
        "FROM (SELECT *, median(zp_solved) OVER (PARTITION BY expnum) AS gm FROM live_zp) JOIN mjds USING (expnum)) GROUP BY ALL")
    o["a6_robust_stats"] = statement(
        f"SELECT ccdnum, epoch, n, {cols('median', 'mad', 'sigma=CASE WHEN mad > 0 THEN 1.4826e0*mad ELSE sd END')} FROM plane_stats")
    o["m6_clipped_counts"] = statement(
        f"SELECT ccdnum, epoch, count(*) AS n_good, {cols('rms=sqrt(avg(residual*residual))')} FROM plane JOIN plane_stats USING (ccdnum, epoch) "
        "WHERE abs(residual - median) < 3.0e0*(CASE WHEN mad > 0 THEN 1.4826e0*mad ELSE sd END) GROUP BY ALL")
    o["x7_chebyshev_eval"] = statement(f"SELECT objectid, expnum, ccdnum, {cols('m_inst', 'delta_sf')} FROM det_sf")
    o["m7_apply_starflat"] = statement(f"SELECT objectid, expnum, ccdnum, {cols('m_inst=m_inst - delta_sf')} FROM det_sf")
    plane = {"prow": ("SELECT ra_mean AS u, dec_mean AS v, (zp_solved - zp_fgcm)*1000 AS y FROM live_zp JOIN good_anchors USING (expnum, ccdnum) JOIN positions USING (expnum, ccdnum) "
                      "WHERE abs((zp_solved - zp_fgcm)*1000) < 200"),
             "pmom": ("SELECT avg(u) AS u0, avg(v) AS v0, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM prow"),
             "pfit": "SELECT u0, v0, (uy*vv - vy*uv)/(uu*vv - uv*uv) AS sa, (vy*uu - uy*uv)/(uu*vv - uv*uv) AS sb FROM pmom",
             "pout": ("SELECT z.expnum, z.ccdnum, z.zp_solved - (sa*(p.ra_mean - u0) + sb*(p.dec_mean - v0))/1000 AS x FROM live_zp z JOIN positions p USING (expnum, ccdnum), pfit"),
             "poff": "SELECT median(x - zp_fgcm) AS off FROM pout JOIN good_anchors USING (expnum, ccdnum)"}
    o["m1_plane_fit"] = statement(f"SELECT expnum, ccdnum, {cols('zp_solved=x - off')} FROM pout, poff", plane)
    # The r band shares rows, errors and zero-points; only the magnitude cut sees its colour.
    band_r = {}
    for name in ("cleaned", "joined", "placed", "ranked", "counted", "det"):
        text = STEPS[name]
        for other in ("cleaned", "joined", "placed", "ranked", "counted"):
            text = re.sub(rf"\b{other}\b", f"{other}_r", text)
        band_r[name + "_r"] = text.replace("FROM fx_meas", "FROM fx_meas_r")
    band_r["fx_meas_r"] = "SELECT * REPLACE (mag_aper4 - (0.3e0 + (objectid % 20)/10.0e0) AS mag_aper4) FROM fx_meas"
    soft = lambda d: (f"SELECT objectid, sum((m_inst + zp_solved)/(m_err*m_err + 1.0e-6))/sum(1.0e0/(m_err*m_err + 1.0e-6)) AS m, count(*) AS n "  # noqa: E731
                      f"FROM {d} JOIN zps USING (expnum, ccdnum) GROUP BY objectid")
    band_r["zps"] = "SELECT * FROM live_zp"
    band_r["zps_r"] = STEPS["trial_zp"].replace("FROM det)", "FROM det_r)")
    band_r["sg"] = soft("det")
    band_r["sr"] = soft("det_r").replace("JOIN zps USING", "JOIN (SELECT * FROM zps_r WHERE zp_solved > 1.0) USING")
    o["m2_gradient_sample"] = statement(
        f"SELECT a.objectid, {cols('ra', 'dec', 'gr=a.m - b.m', 'resid_mmag=(a.m - g.bp)*1000')} FROM sg a JOIN sr b USING (objectid) JOIN gaia g USING (objectid) "
        "WHERE a.n >= 2 AND g.xmatch_dist < 1.0e0 AND g.bp BETWEEN 10 AND 25 AND g.bp_rp BETWEEN 0.3 AND 3.5 AND g.snr > 50", band_r)

    # gradient against Gaia: a cubic in colour and a plane, refitted once after a clip
    terms = ["dc", "dc*dc", "dc*dc*dc", "dx", "dy", "1.0e0"]
    tilt = {**band_r, "gsample": ("SELECT g.ra, g.dec, a.m - b.m AS gr, (a.m - g.bp)*1000 AS y FROM sg a JOIN sr b USING (objectid) JOIN gaia g USING (objectid) "
                                  "WHERE a.n >= 2 AND g.xmatch_dist < 1.0e0 AND g.bp BETWEEN 10 AND 25 AND g.bp_rp BETWEEN 0.3 AND 3.5 AND g.snr > 50"),
            "gcut": "SELECT * FROM gsample WHERE abs(y - (SELECT median(y) FROM gsample)) <= 500 AND gr BETWEEN -0.5 AND 2.5",
            "gmid": "SELECT avg(ra) AS ra0, avg(dec) AS dec0, median(gr) AS gr0 FROM gcut",
            "gset": "SELECT y, gr - gr0 AS dc, ra - ra0 AS dx, dec - dec0 AS dy FROM gcut, gmid",
            **clip_fit("gt", "gset", terms, "y", 1, True),
            "gzp": ("SELECT z.expnum, z.ccdnum, z.zp_solved - (c3*(p.ra_mean - ra0) + c4*(p.dec_mean - dec0))/1000 AS x FROM live_zp z "
                    "JOIN positions p USING (expnum, ccdnum), gtfit, gmid"),
            "gzoff": "SELECT median(x - zp_fgcm) AS off FROM gzp JOIN good_anchors USING (expnum, ccdnum)"}
    o["m2_gaia_detrend"] = statement(f"SELECT expnum, ccdnum, {cols('zp_solved=x - off')}, (SELECT count(*) FROM gcut) >= 100 AS applied FROM gzp, gzoff", tilt)
    # surface linear in RA and cubic in declination fitted to the anchors with three clips
    cubic = ["1.0e0", "dx", "dy", "dy*dy", "dy*dy*dy", "dx*dy"]
    bowl = {"sall": "SELECT p.ra_mean, p.dec_mean, z.zp_solved - a.zp_fgcm AS y FROM live_zp z JOIN good_anchors a USING (expnum, ccdnum) JOIN positions p USING (expnum, ccdnum)",
            "smid": "SELECT avg(ra_mean) AS ra0, avg(dec_mean) AS dec0 FROM sall",
            "sset": "SELECT y, ra_mean - ra0 AS dx, dec_mean - dec0 AS dy FROM sall, smid",
            **clip_fit("sf", "sset", cubic, "y", 3, True),
            "splace": "SELECT z.expnum, z.ccdnum, z.zp_solved, p.ra_mean - ra0 AS dx, p.dec_mean - dec0 AS dy FROM trial_zp z LEFT JOIN positions p USING (expnum, ccdnum), smid",
            "sout": f"SELECT expnum, ccdnum, zp_solved - coalesce({weighted(cubic, 1)}, 0) AS x FROM splace, sffit",
            "soff": "SELECT median(x - zp_fgcm) AS off FROM sout JOIN good_anchors USING (expnum, ccdnum)"}
    o["m3_polynomial_detrend"] = statement(f"SELECT expnum, ccdnum, {cols('zp_solved=x - off')}, (SELECT count(*) FROM sall) >= 10 AS applied FROM sout, soff", bowl)
    # flat over the detector: products of Chebyshev polynomials per detector and epoch
    tx, ty = cheb("ux"), cheb("uy")
    waves = [f"({tx[k // 4]})*({ty[k % 4]})" for k in range(16)]
    chip = {"cgroups": "SELECT ccdnum, epoch FROM plane GROUP BY ALL HAVING count(*) >= 50",
            "cgood": ("SELECT p.ccdnum, p.epoch, p.residual, 2.0e0*(x - 1.0e0)/2047.0e0 - 1.0e0 AS ux, 2.0e0*(y - 1.0e0)/4095.0e0 - 1.0e0 AS uy FROM plane p JOIN cgroups USING (ccdnum, epoch) "
                      "JOIN plane_stats USING (ccdnum, epoch) WHERE abs(residual - median) < 3.0e0*(CASE WHEN mad > 0 THEN 1.4826e0*mad ELSE sd END)"),
            "cwaves": "SELECT ccdnum, epoch, residual, " + ", ".join(f"{f} AS w{k}" for k, f in enumerate(waves)) + " FROM cgood",
            **elimination("cfit", "cwaves", [f"w{k}" for k in range(16)], "residual", keys="ccdnum, epoch"),
            "cmodel": f"SELECT g.ccdnum, g.epoch, residual, {weighted([f'w{k}' for k in range(16)])} AS m FROM cwaves g JOIN cfit c ON c.ccdnum = g.ccdnum AND c.epoch = g.epoch WHERE c.n >= 50"}
    o["m6_starflat_fit"] = statement(
        "SELECT ccdnum, epoch, count(*) AS n_stars, " + cols("correction_rms_mmag=sqrt(avg(m*m))*1000", "rms_before_mmag=sqrt(avg(residual*residual))*1000",
                                                           "rms_after_mmag=sqrt(avg((residual - m)*(residual - m)))*1000", digits=4) + " FROM cmodel GROUP BY ALL", chip)

    o["a21_magzero"] = statement(f"SELECT {cols('magzero=mz')}, (SELECT count(*) FROM anchors) AS n_anchors FROM magzero")
    cat_cols = cols("ra", "dec", "mag_cal_g", "mag_starflat_g", "mag_before_g", "magerr_cal_g", "chi2_g")
    o["i9_catalog"] = statement(f"SELECT objectid, {cat_cols}, nobs_g FROM catalog WHERE objectid % 211 <> 0")
    o["p9_dered"] = statement(f"SELECT objectid, {cols('ebv_sfd', f'''mag_dered_g=mag_cal_g - {EXTINCTION['decam_g']}e0*ebv_sfd''')} FROM cat")
    o["t21_zeropoint_list"] = statement(
        f"SELECT expnum, ccdnum, 'g' AS band, {cols('zp_solved')} FROM usable_zp WHERE (expnum, ccdnum) IN (SELECT (expnum, ccdnum) FROM nodes)")
    o["i9_catalog_summary"] = statement(
        "SELECT count(*) AS n_stars, " + cols("mag_std=stddev_samp(mag_cal_g)", "mag_min=min(mag_cal_g)", "mag_max=max(mag_cal_g)",
        "correction_rms_mmag=sqrt(avg((mag_cal_g - mag_before_g)*1000*(mag_cal_g - mag_before_g)*1000))", "mag_median=median(mag_cal_g)",
        "nobs_median=median(nobs_g)", "correction_median_mmag=median((mag_cal_g - mag_before_g)*1000)")
        + ", max(nobs_g) AS nobs_max, count(*) FILTER (NOT isfinite(mag_cal_g)) AS n_not_finite FROM cat")

    o["j9_sky_match"] = statement(f"SELECT objectid, objid, {cols('sep_arcsec')} FROM matched")
    o["j10_prebuilt_match"] = statement(
        f"SELECT source_id, objectid AS nsc_objectid, {cols('xmatch_dist', 'bp_rp')} FROM gaia WHERE xmatch_dist < 1.0e0 AND snr > 50 AND "
        "ra BETWEEN (SELECT min(ra) - 0.1 FROM cat) AND (SELECT max(ra) + 0.1 FROM cat) AND dec BETWEEN (SELECT min(dec) - 0.1 FROM cat) AND (SELECT max(dec) + 0.1 FROM cat)")

    def verdict(test, ok, enough="TRUE"):
        return (f"'{test}' AS test, CASE WHEN NOT ({enough}) THEN 'SKIP' WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, "
                f"CASE WHEN {enough} THEN {ok} END AS passed")

    t0 = verdict("Test 0: FGCM comparison", "rms_solved_mmag < rms_before_mmag", "n_stars >= 50")
    o["v0_fgcm_rms"] = statement(
        f"SELECT {t0}, {cols('rms_solved_mmag', 'rms_starflat_mmag', 'rms_before_mmag', 'improvement_mmag=rms_before_mmag - rms_solved_mmag')}, n_stars FROM t0")
    t1 = verdict("Test 1: Repeatability", "floor_mmag < 10.0", "n_stars > 0")
    o["v1_repeatability"] = statement(f"SELECT {t1}, {cols('floor_mmag')}, n_stars FROM t1")
    bins = {"span": "SELECT quantile_cont(mag_cal_g, 0.05) AS lo, (quantile_cont(mag_cal_g, 0.95) - quantile_cont(mag_cal_g, 0.05))/15.0e0 AS wd, quantile_cont(mag_cal_g, 0.95) AS hi FROM multi",
            "bmulti": "SELECT CAST(least(floor((mag_cal_g - lo)/wd), 14) AS INT) AS bin, scatter_mmag, lo, wd FROM multi, span WHERE mag_cal_g >= lo AND mag_cal_g <= hi"}
    o["v1_repeatability_bins"] = statement(
        f"SELECT bin, {cols('center=any_value(lo) + (bin + 0.5e0)*any_value(wd)')}, count(*) AS n, {cols('median=median(scatter_mmag)')} FROM bmulti "
        "GROUP BY bin HAVING count(*) >= 6", bins)
    t2 = verdict("Test 2: DR2 comparison", "rms_mmag < 15.0", "n_nodes > 0")
    o["v2_anchored_rms"] = statement(f"SELECT {t2}, {cols('rms_mmag', 'median_mmag')}, n_nodes FROM t2")
    side = "SELECT {f} FROM {t} WHERE (expnum + ccdnum) % 29 <> 0"
    t6 = {"inside": side.format(f="median(zp_solved) AS des_median, count(*) AS n_des", t="ref_table"),
          "outside": side.format(f="median(zp_solved) AS non_des_median, count(*) AS n_non_des", t="trial_table") + " AND zp_fgcm IS NULL AND zp_solved > 1.0",
          "t6": "SELECT *, abs(des_median - non_des_median)*1000 AS off FROM inside, outside"}
    v6 = verdict("Test 6: DES boundary", "off < 10.0", "n_des > 0 AND n_non_des > 0")
    o["v6_boundary"] = statement(
        f"SELECT {v6}, {cols('des_median', 'non_des_median', 'boundary_offset_mmag=off')}, n_des, n_non_des FROM t6", t6)
    plain = {"t0p": STEPS["t0"], "t6all": t6["t6"].replace("inside, outside", "inside0, outside0"),
             "inside0": "SELECT median(zp_solved) AS des_median, count(*) AS n_des FROM ref_table",
             "outside0": "SELECT median(zp_solved) AS non_des_median, count(*) AS n_non_des FROM trial_table WHERE zp_fgcm IS NULL AND zp_solved > 1.0"}
    ls = {"ct": ("SELECT mag_true - 0.03e0*s.color + CASE WHEN s.objectid % 83 = 0 THEN 0.4e0 ELSE 0.0e0 END AS lg, mag_true - 1.4e0*s.color AS li, mag_cal_g "
                 "FROM multi JOIN fx_stars s USING (objectid) WHERE objectid % 17 <> 3 AND objectid % 19 <> 5 AND 0.1e0 + (objectid % 12)/10.0e0 < 1.0e0"),
          "ctrows": "SELECT lg - li AS x, (mag_cal_g - lg)*1000 AS y FROM ct", **clip_line("ctrows", 3, False)}
    ct_out = cols("rms_before_ct_mmag=sqrt(avg(y*y))", "rms_after_ct_mmag=sqrt(avg((y - fa - fb*x)*(y - fa - fb*x)))")
    o["v3_ls_comparison"] = statement(
        f"SELECT {verdict('Test 3: LS DR10 comparison', 'ra < 30.0')}, n_common, n_stars, {cols('rms_before_ct_mmag=rb', 'rms_after_ct_mmag=ra', 'color_term_offset=fa', 'color_term_slope=fb')} FROM "
        "(SELECT count(*) AS n_common, any_value(fn) AS n_stars, any_value(fa) AS fa, any_value(fb) AS fb, sqrt(avg(y*y)) AS rb, sqrt(avg((y - fa - fb*x)*(y - fa - fb*x))) AS ra FROM kept, clipfin)", ls)
    e = EXTINCTION
    ps = {"psrow": ("SELECT g_mag, i_mag, c.ebv_sfd AS ebv, c.mag_cal_g, c.mag_before_g FROM multi c JOIN matched USING (objectid) JOIN second USING (objid) "
                    "WHERE c.dec > -30.0 AND dec_mean >= -30.0 AND objid % 23 <> 7 AND objid % 29 <> 3 AND g_mag < 22 AND mag_cal_g > 15 AND mag_cal_g < 22 AND g_mag > 10 AND g_mag < 25 AND i_mag > 10 AND i_mag < 25"),
          "psrows": (f"SELECT g_mag - i_mag - ({e['ps1_g']}e0 - {e['ps1_i']}e0)*ebv AS x, (mag_cal_g - {e['decam_g']}e0*ebv - (g_mag - {e['ps1_g']}e0*ebv))*1000 AS y, "
                     f"(mag_before_g - {e['decam_g']}e0*ebv - (g_mag - {e['ps1_g']}e0*ebv))*1000 AS yb FROM psrow"), **clip_line("psrows", 3, False)}
    whole = {**ps, "psrow": ps["psrow"].replace("AND dec_mean >= -30.0 AND objid % 23 <> 7 AND objid % 29 <> 3 AND g_mag < 22 ", "")}
    ps1 = (
        f"SELECT {verdict('Test 7: PS1 DR2 comparison', 'ra < 30.0 AND ra <= rs')}, n_common, n_stars, "
        f"{cols('rms_before_ct_mmag=rb', 'rms_after_ct_mmag=ra', 'rms_before_solve_mmag=rs', 'color_term_offset=fa', 'color_term_slope=fb')} FROM "
        "(SELECT count(*) AS n_common, any_value(fn) AS n_stars, any_value(fa) AS fa, any_value(fb) AS fb, sqrt(avg(y*y)) AS rb, sqrt(avg((y - fa - fb*x)*(y - fa - fb*x))) AS ra, "
        "sqrt(avg((yb - fa - fb*x)*(yb - fa - fb*x))) AS rs FROM kept, clipfin)")
    o["v7_ps1_comparison"], o["v7_ps1_selected"] = statement(ps1, whole), statement(ps1, ps)

    o["a15_histogram"] = statement(
        "SELECT ccdnum, CAST(floor((ra - 49.0e0)/0.5e0) AS INT) AS bin, count(*) AS n FROM det GROUP BY ALL")
    o["a16_binned_median"] = statement(
        f"SELECT bin, {cols('center=-35.0e0 + (bin + 0.5e0)*0.5e0')}, count(*) AS n, {cols('median=median(m_inst)', 'std=stddev_samp(m_inst)', 'std_err=stddev_samp(m_inst)/sqrt(count(*))')} "
        "FROM (SELECT CAST(floor((dec + 35.0e0)/0.5e0) AS INT) AS bin, m_inst FROM det) GROUP BY bin HAVING count(*) >= 11")
    o["a17_hist2d"] = statement(
        "SELECT CAST(floor((ra - 50.0e0)/0.5e0) AS INT) AS bin_x, CAST(floor((dec + 35.0e0)/0.5e0) AS INT) AS bin_y, count(*) AS n FROM det GROUP BY ALL")
    mixed = "42"
    for key in ("objectid", "expnum", "ccdnum"):
        mixed = f"(({mixed}*69069 + {key}*7919) % 1000003)"
    o["o5_sample"] = statement(
        f"SELECT objectid, expnum, ccdnum, {cols('m_inst')} FROM det ORDER BY (CAST({mixed} AS BIGINT)*7907 + 13) % 1000003, objectid, expnum, ccdnum, m_inst LIMIT 5000")
    o["a18_value_counts"] = statement("SELECT expnum, count(*) AS n FROM det GROUP BY expnum")
    o["o4_topk"] = statement("SELECT expnum, count(*) AS n FROM det GROUP BY expnum ORDER BY n DESC, expnum LIMIT 10")
    qs = {"q05": 0.05, "q20": 0.2, "q40": 0.4, "q50": 0.5, "q95": 0.95}
    o["a20_quantiles"] = statement(
        "SELECT ccdnum, count(*) AS n, " + cols(*[f"{k}=quantile_cont(m_inst, {v})" for k, v in qs.items()]) + " FROM det GROUP BY ccdnum")
    o["a24_scatter"] = statement(
        f"SELECT healpix_pixel, objectid, count(*) AS n, {cols('scatter=stddev_samp(m_cal)', 'mag=avg(m_cal)')} FROM cal GROUP BY ALL HAVING count(*) >= 3")
    floor = {"fstars": "SELECT stddev_samp(m_cal) AS scatter, avg(m_cal) AS mag FROM cal GROUP BY healpix_pixel, objectid HAVING count(*) >= 3",
             "fcut": "SELECT quantile_cont(mag, 0.02) AS lo, quantile_cont(mag, 0.98) AS hi FROM fstars",
             "fbins": ("SELECT median(scatter) AS med FROM fstars, fcut WHERE mag >= lo AND mag <= hi GROUP BY least(floor((mag - lo)/0.5e0), ceil((hi - lo)/0.5e0) - 1) HAVING count(*) >= 21")}
    o["a24_floor"] = statement(f"SELECT {cols('floor_mag=(SELECT min(med) FROM fbins)')}, count(*) AS n_nodes FROM trial_zp", floor)
    depth = {"tagged": ("SELECT exp_ra, diff_mmag, 'all' AS sample FROM diffs UNION ALL SELECT exp_ra, diff_mmag, '90s' FROM diffs WHERE exptime = 90 "
                        "UNION ALL SELECT exp_ra, diff_mmag, 'deep' FROM diffs WHERE exptime > 100")}
    o["d1_gradient_by_depth"] = statement(
        f"SELECT sample, CAST(floor(exp_ra - 49.0e0) AS INT) AS bin, count(*) AS n, {cols('median=median(diff_mmag)')} FROM tagged GROUP BY ALL HAVING count(*) >= 11", depth)
    edges = (30, 50, 80, 95, 120, 160, 190, 250, 350, 500)
    case = "CASE " + " ".join(f"WHEN exptime >= {a} AND exptime < {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"
    o["d1_difference_by_exptime"] = statement(
        f"SELECT {case} AS bin, count(*) AS n, {cols('median=median(diff_mmag)')} FROM diffs WHERE {case} IS NOT NULL GROUP BY ALL HAVING count(*) > 10")
    deep = {"dpos": "SELECT expnum, (max(ra_mean) - 50.0e0)*2.0e0 + 45.0e0 AS exp_ra FROM positions GROUP BY expnum",
            "dcls": "SELECT CAST(floor((exp_ra - 49.0e0)/0.5e0) AS INT) AS bin, exptime FROM fx_exptime JOIN dpos USING (expnum)"}
    o["d1_deep_fraction"] = statement(
        f"SELECT bin, count(*) AS n_total, count(*) FILTER (exptime > 100) AS n_deep, {cols('fraction=count(*) FILTER (exptime > 100)/count(*)')} FROM dcls GROUP BY bin", deep)
    o["d1_deep_minus_normal"] = statement(
        f"SELECT objectid, {cols('m_deep')}, n_deep, {cols('m_normal')}, n_normal, {cols('dm=m_deep - m_normal')} FROM (SELECT objectid, avg(m_inst) FILTER (exptime > 100) AS m_deep, "
        "count(*) FILTER (exptime > 100) AS n_deep, avg(m_inst) FILTER (exptime = 90) AS m_normal, count(*) FILTER (exptime = 90) AS n_normal FROM det JOIN fx_exptime USING (expnum) GROUP BY objectid) "
        "WHERE n_deep > 0 AND n_normal > 0")
    o["d1_seeing_by_exposure"] = statement(
        f"SELECT expnum, n_det, {cols('fwhm_median', 'ra_median', 'exptime=coalesce(exptime, -1.0e0)')}, CASE WHEN exptime > 100 THEN 'DES_deep' WHEN exptime = 90 THEN 'DES_90s' "
        "WHEN exptime > 0 THEN 'DES_other' ELSE 'non-DES' END AS exp_class FROM (SELECT expnum, count(*) AS n_det, median(fwhm) AS fwhm_median, median(ra) AS ra_median FROM seen GROUP BY expnum) LEFT JOIN fx_exptime USING (expnum)")
    seeing = {"sres": "SELECT fwhm, m_inst - avg(m_inst) OVER (PARTITION BY objectid) AS rs, count(*) OVER (PARTITION BY objectid) AS nn FROM seen",
              "sbin": "SELECT CAST(floor((fwhm - 0.5e0)/0.1e0) AS INT) AS bin, rs FROM sres WHERE nn >= 3",
              "wres": ("SELECT fwhm, m_inst - sum(m_inst/(m_err*m_err)) OVER (PARTITION BY objectid)/sum(1.0e0/(m_err*m_err)) OVER (PARTITION BY objectid) AS rs, "
                       "count(*) OVER (PARTITION BY objectid) AS nn FROM seen WHERE fwhm > 0.5 AND fwhm < 3.0"),
              "wbin": "SELECT CAST(floor((fwhm - 0.8e0)/0.05e0) AS INT) AS bin, rs FROM wres WHERE nn >= 2"}
    o["d1_seeing_residuals"] = statement(
        f"SELECT bin, {cols('center=0.5e0 + (bin + 0.5e0)*0.1e0')}, count(*) AS n, {cols('median=median(rs)', 'std=stddev_samp(rs)', 'std_err=stddev_samp(rs)/sqrt(count(*))')} FROM sbin "
        "GROUP BY bin HAVING count(*) >= 51", seeing)
    o["m8_seeing_bins"] = statement(
        f"SELECT bin, {cols('center=0.8e0 + (bin + 0.5e0)*0.05e0')}, count(*) AS n, {cols('median=median(rs)', 'std_err=stddev_pop(rs)/sqrt(count(*))')} FROM wbin WHERE bin BETWEEN 0 AND 23 "
        "GROUP BY bin HAVING count(*) >= 50", seeing)
    u = "(center - 1.4e0)"
    v = "(s.fwhm - 1.4e0)"
    aperture = {**seeing, "acbins": "SELECT 0.8e0 + (bin + 0.5e0)*0.05e0 AS center, median(rs) AS med, stddev_pop(rs)/sqrt(count(*)) AS se FROM wbin WHERE bin BETWEEN 0 AND 23 "
                                    "GROUP BY bin HAVING count(*) >= 50",
                **elimination("acfit", "acbins", [f"pow({u}, {k})/se" for k in (3, 2, 1, 0)], "med/se", where="se > 0"),
                "acrows": f"SELECT s.*, c0*pow({v}, 3) + c1*pow({v}, 2) + c2*{v} + c3 AS ac FROM seen s, acfit WHERE s.fwhm > 0.5 AND s.fwhm < 3.0",
                "acnode": ("SELECT expnum, ccdnum, avg(ac) AS mean_ac, median(fwhm) AS median_fwhm, count(*) AS n_det, any_value(p.ra_mean) AS ra FROM acrows "
                           "JOIN positions p USING (expnum, ccdnum) GROUP BY ALL"),
                "acnum": (f"SELECT *, {KEY} AS node, row_number() OVER (PARTITION BY healpix_pixel, objectid ORDER BY expnum, ccdnum, m_inst, m_err) AS sq FROM acrows "
                          f"WHERE {KEY} IN (SELECT {KEY} FROM nodes)"),
                "acpairs": ("SELECT a.node AS i, b.node AS j, 1.0e0/(a.m_err*a.m_err + b.m_err*b.m_err) AS w, a.m_inst - b.m_inst AS dm, b.ac - a.ac AS da FROM acnum a JOIN acnum b "
                            "USING (healpix_pixel, objectid) WHERE a.sq < b.sq AND a.node < b.node"),
                "aclinks": "SELECT i, j, sum(w) AS w, sum(w*dm) AS wdm, sum(w*(dm + da)) AS wdc FROM acpairs GROUP BY ALL"}
    for tag, col in (("o", "wdm"), ("c", "wdc")):
        aperture |= {f"ac{tag}two": f"SELECT i, j, w, {col} AS wdm FROM aclinks UNION ALL SELECT j, i, w, -{col} FROM aclinks",
                     f"ac{tag}diag": f"SELECT i, sum(w) AS d, -sum(wdm) AS b FROM ac{tag}two GROUP BY i",
                     f"ac{tag}vec": f"SELECT {KEY} AS i, coalesce(d, 0) + 1.0e-10 AS d, coalesce(b, 0) AS b FROM nodes LEFT JOIN ac{tag}diag ON i = {KEY}",
                     **conjugate_gradients(f"ac{tag}two", f"ac{tag}vec", 24, cg=f"ac{tag}"),
                     f"ac{tag}zp": f"SELECT {node_of('i')}, x - (SELECT coalesce(median(x - zp_fgcm), 0) FROM ac{tag}end JOIN good_anchors ON i = {KEY}) AS zp FROM ac{tag}end"}
    aperture |= {"acboth": "SELECT 'original' AS label, * FROM acozp UNION ALL SELECT 'corrected', * FROM acczp",
                 "acdiff": "SELECT label, ra_mean, zp - zp_fgcm AS diff FROM acboth JOIN good_anchors USING (expnum, ccdnum) JOIN positions USING (expnum, ccdnum)",
                 "acra": ("SELECT label, CAST(floor(ra_mean - 48.0e0) AS INT) AS bin, count(*) AS n, median(diff)*1000 AS median_mmag FROM acdiff WHERE ra_mean >= 48 AND ra_mean < 61 "
                          "GROUP BY ALL HAVING count(*) >= 10"),
                 "acslope": "SELECT label, count(*) AS n_bins, regr_slope(median_mmag, bin + 48.5e0) AS s FROM acra GROUP BY label",
                 "acall": "SELECT label, count(*) AS n_nodes, sqrt(avg(diff*diff))*1000 AS rms_mmag, max(ra_mean) - min(ra_mean) AS span FROM acdiff GROUP BY label"}
    o["m8_aperture_correction"] = statement(f"SELECT expnum, ccdnum, {cols('mean_ac', 'median_fwhm')}, n_det, {cols('ra')} FROM acnode", aperture)
    slope = "CASE WHEN n_bins >= 3 THEN s ELSE 0.0e0 END"
    o["d3_aperture_what_if"] = statement(
        f"SELECT label, n_nodes, coalesce(n_bins, 0) AS n_bins, {cols('rms_mmag', f'slope_mmag_per_deg={slope}', f'total_mmag=span*{slope}', digits=3)} FROM acall LEFT JOIN acslope USING (label)", aperture)
    o["d3_gradient_bins"] = statement(f"SELECT label, bin, n, {cols('center=bin + 48.5e0', 'median_mmag', digits=3)} FROM acra", aperture)
    o["d3b_seeing_by_ra"] = statement(
        f"SELECT bin, {cols('center=48.25e0 + bin*0.5e0')}, n, {cols('median', 'std_err')} FROM (SELECT CAST(floor((ra - 48.0e0)/0.5e0) AS INT) AS bin, count(*) AS n, median(fwhm) AS median, "
        "stddev_samp(fwhm)/sqrt(count(*)) AS std_err FROM seen WHERE fwhm > 0.5 AND fwhm < 3.0 AND ra >= 48 AND ra < 61.5 GROUP BY 1 HAVING count(*) >= 50)", seeing)
    o["d3b_correction_by_ra"] = statement(
        f"SELECT bin, {cols('center=bin + 48.5e0')}, n, {cols('mean_ac_mmag', 'median_fwhm')} FROM (SELECT CAST(floor(ra - 48.0e0) AS INT) AS bin, count(*) AS n, median(mean_ac)*1000 AS mean_ac_mmag, "
        "median(median_fwhm) AS median_fwhm FROM acnode WHERE ra >= 48 AND ra < 61 GROUP BY 1 HAVING count(*) >= 11)", aperture)
    o["d5_gradient_table"] = statement(
        f"SELECT expnum, ccdnum, {cols('ra', 'dec', 'solved_minus_fgcm_mmag=a', 'before_minus_fgcm_mmag=b', 'solved_minus_before_mmag=c', 'fgcm_minus_zpterm_mmag=d')} FROM grad")
    long = {"glong": " UNION ALL ".join(f"SELECT ra, '{n}' AS quantity, {c} AS val FROM grad" for c, n in zip("abcd", (
        "solved_minus_fgcm_mmag", "before_minus_fgcm_mmag", "solved_minus_before_mmag", "fgcm_minus_zpterm_mmag")))}
    o["d5_gradient_summary"] = statement(
        f"SELECT quantity, n, {cols('slope', 'intercept', 'total', 'r', f'p={T_TEST}')} FROM (SELECT quantity, count(*) AS n, regr_slope(val, ra) AS slope, "
        "regr_intercept(val, ra) AS intercept, regr_slope(val, ra)*(max(ra) - min(ra)) AS total, corr(ra, val) AS r FROM glong GROUP BY quantity)", long)
    o["d5_per_exposure"] = statement(
        f"SELECT expnum, {cols('ra=avg(ra)', 'dec=avg(dec)', 'solved_minus_fgcm_mmag=median(a)', 'before_minus_fgcm_mmag=median(b)', 'solved_minus_before_mmag=median(c)')} FROM grad GROUP BY expnum")
    half = lambda t, c: (f"count(*) FILTER ({c}) AS n_{t}, " + cols(f"slope_{t}=regr_slope(y, x) FILTER ({c})", f"intercept_{t}=regr_intercept(y, x) FILTER ({c})", f"r_{t}=corr(x, y) FILTER ({c})"))
    o["d6_dec_step"] = statement(
        f"SELECT {half('north', 'x > -30.0')}, {half('south', 'x < -30.0')}, "
        + cols("discontinuity_mmag=CASE WHEN count(*) FILTER (x > -30.0) > 10 AND count(*) FILTER (x < -30.0) > 10 THEN (regr_slope(y, x) FILTER (x < -30.0))*(-30.0) + regr_intercept(y, x) FILTER (x < -30.0) "
               "- (regr_slope(y, x) FILTER (x > -30.0))*(-30.0) - regr_intercept(y, x) FILTER (x > -30.0) END") + " FROM dec_rows WHERE x > -32.0 AND x < -28.0")
    o["d6_binned_dec"] = statement(
        f"SELECT CAST(floor((x + 35.0e0)/0.5e0) AS INT) AS bin, count(*) AS n, {cols('median=median(y)')} FROM dec_rows GROUP BY ALL HAVING count(*) >= 11")
    o["d6_binned_ra_split"] = statement(
        f"SELECT side, CAST(floor((x - 50.0e0)/2.0e0) AS INT) AS bin, count(*) AS n, {cols('median=median(y)')} FROM split_rows WHERE side IS NOT NULL GROUP BY ALL HAVING count(*) >= 11",
        {"split_rows": "SELECT m.ra_median AS x, CASE WHEN m.dec_median > -30 THEN 'north' WHEN m.dec_median < -30 THEN 'south' END AS side, t.delta_zp*1000 AS y "
                       "FROM valid_table t JOIN medpos m USING (expnum, ccdnum)"})
    o["d8_pixel_counts"] = statement("SELECT healpix_pixel, count(*) AS n_detections, count(DISTINCT objectid) AS n_stars FROM det GROUP BY healpix_pixel")
    o["o2_first_pixels"] = statement("SELECT DISTINCT healpix_pixel FROM det ORDER BY healpix_pixel LIMIT 5")
    m10 = {"m10rows": "SELECT ra_mean AS x, delta_zp AS y FROM ref_table JOIN positions USING (expnum, ccdnum)", **clip_line("m10rows", 3, True)}
    o["m10_ra_gradient"] = statement(f"SELECT {cols('slope_mmag_per_deg=any_value(fb)*1000', 'rms_mmag=stddev_pop(y - fa - fb*x)*1000')} FROM kept, clipfin", m10)
    o["a19_reference_rms"] = statement(
        f"SELECT count(*) AS n, {cols('rms_mmag=sqrt(avg(delta_zp*delta_zp))*1000')} FROM ref_table WHERE (expnum + ccdnum) % 29 <> 0")
    d7 = {"d7s": ("SELECT objectid, avg(ra) AS ra, avg(dec) AS dec, sum((zp_solved - zp_fgcm)/(m_err*m_err + 1.0e-6))/sum(1.0e0/(m_err*m_err + 1.0e-6))*1000 AS df, count(*) AS n "
                  "FROM det JOIN valid_table USING (expnum, ccdnum) WHERE zp_solved > 25 AND zp_solved < 35 GROUP BY objectid HAVING count(*) >= 2")}
    o["d7_star_level"] = statement(f"SELECT objectid, {cols('ra', 'dec')}, n, {cols('diff_mmag=df - (SELECT avg(df) FROM d7s)')} FROM d7s", d7)
    gr = {**band_r, **{k + "_r": re.sub(r"\b(det_units|det_sf|cat_all|cat_mean|trial_zp|live_zp|usable_zp|magzero|det|zpterms|anchors|flat)\b",
                                        lambda m: m.group(1) + "_r" if m.group(1) in ("det_units", "det_sf", "cat_all", "cat_mean", "trial_zp", "live_zp", "usable_zp", "det") else m.group(1), STEPS[k])
                       for k in ("det_units", "det_sf", "cat_all", "cat_mean", "trial_zp", "live_zp", "usable_zp")},
          "gcol": "SELECT c.objectid, c.mag_cal_g - m.mag AS gr FROM cat c JOIN cat_mean_r m USING (objectid) WHERE c.mag_cal_g > 15 AND c.mag_cal_g < 22 AND m.mag > 15 AND m.mag < 22 "
                  "AND c.mag_cal_g - m.mag > -0.5 AND c.mag_cal_g - m.mag < 2.5"}
    o["v4_gaia_rows"] = statement(
        f"SELECT c.objectid, {cols('ra=c.ra', 'dec=c.dec', f'''delta=(mag_cal_g - {e['decam_g']}e0*ebv_sfd - (g.bp - {e['gaia_bp']}e0*ebv_sfd))*1000''', f'''delta_before=(mag_before_g - {e['decam_g']}e0*ebv_sfd - (g.bp - {e['gaia_bp']}e0*ebv_sfd))*1000''', f'''color=k.gr - ({e['decam_g']}e0 - {e['decam_r']}e0)*ebv_sfd''')} "
        "FROM multi c LEFT JOIN gcol k USING (objectid) JOIN gaia g USING (objectid) WHERE g.xmatch_dist < 1.0e0 AND mag_cal_g > 15 AND mag_cal_g < 22 AND g.bp > 10 AND g.bp < 25", gr)
    # colour term of degree 5 with three clips, fitted in t = al color + be and expanded into powers of the colour
    powers = [f"pow(t, {k})" for k in range(6)]
    e4 = (f"(mag_cal_g - {e['decam_g']}e0*ebv_sfd - (g.bp - {e['gaia_bp']}e0*ebv_sfd))*1000", f"(mag_before_g - {e['decam_g']}e0*ebv_sfd - (g.bp - {e['gaia_bp']}e0*ebv_sfd))*1000")

    def gaia_steps(color: str) -> dict:
        return {**gr, "v4rows": (f"SELECT {e4[0]} AS y, {e4[1]} AS yb, {color} AS color FROM multi c LEFT JOIN gcol k USING (objectid) JOIN gaia g USING (objectid) "
                                 "WHERE g.xmatch_dist < 1.0e0 AND mag_cal_g > 15 AND mag_cal_g < 22 AND g.bp > 10 AND g.bp < 25"),
                "v4span": "SELECT min(color) AS lo, max(color) - min(color) AS wd FROM v4rows WHERE color IS NOT NULL AND y IS NOT NULL",
                "v4set": "SELECT y, yb, 2.0e0*(color - lo)/wd - 1.0e0 AS t FROM v4rows, v4span WHERE color IS NOT NULL AND y IS NOT NULL",
                **clip_fit("v4", "v4set", powers, "y", 3, False),
                "v4own": "SELECT count(*) > 1000 AS own FROM multi c JOIN gcol USING (objectid) WHERE mag_cal_g > 15 AND mag_cal_g < 22",
                "v4sum": (f"SELECT count(*) AS n_common, any_value(n) AS n_stars, sqrt(avg(y*y)) AS rb, sqrt(avg(pow(y - ({weighted(powers)}), 2))) AS ra, "
                          f"sqrt(avg(pow(yb - ({weighted(powers)}), 2))) AS rs FROM v4k, v4fit WHERE keep AND yb IS NOT NULL"),
                "v4unit": "SELECT 2.0e0/wd AS al, -2.0e0*lo/wd - 1.0e0 AS be FROM v4span"}

    expanded = [f"color_term_c{m}=" + " + ".join(f"c{k}*{comb(k, m)}*pow(al, {m})*pow(be, {k - m})" for k in range(m, 6)) for m in range(5, -1, -1)]
    shade = f"CASE WHEN (SELECT own FROM v4own) THEN k.gr - ({e['decam_g']}e0 - {e['decam_r']}e0)*ebv_sfd ELSE g.bp_rp - ({e['gaia_bp']}e0 - {e['gaia_rp']}e0)*ebv_sfd END"
    o["v4_gaia_comparison"] = statement(
        f"SELECT {verdict('Test 4: Gaia comparison', 'ra < 50.0 AND ra <= rs')}, n_common, n_stars, {cols('rms_before_ct_mmag=rb', 'rms_after_ct_mmag=ra', 'rms_before_solve_mmag=rs', *expanded, digits=4)}, "
        "CAST((SELECT own FROM v4own) AS INT) AS survey_colour FROM v4sum, (SELECT * EXCLUDE (n) FROM v4fit), v4unit", gaia_steps(shade))
    o["v8_tally"] = statement(
        f"SELECT status, count(*) AS n FROM (SELECT {t0} FROM t0p UNION ALL SELECT {t1} FROM t1 UNION ALL SELECT {t2} FROM t2 UNION ALL SELECT {v6} FROM t6all "
        f"UNION ALL SELECT {verdict('Test 4: Gaia comparison', 'ra < 50.0 AND ra <= rs')} FROM v4sum "
        f"UNION ALL SELECT {verdict('Test 7: PS1 DR2 comparison', 'ra < 30.0 AND ra <= rs')} FROM (SELECT any_value(fn) AS n_stars, "
        "sqrt(avg((y - fa - fb*x)*(y - fa - fb*x))) AS ra, sqrt(avg((yb - fa - fb*x)*(yb - fa - fb*x))) AS rs FROM kept, clipfin) "
        "UNION ALL SELECT 'Test 5: Stellar locus', 'SKIP', NULL) GROUP BY status", {**plain, **ps, **gaia_steps(shade)})
    return o


ORACLE = _build()
