"""Weighted normal equations of the overlap constraints.

Every pair of detections of one star states that its two nodes' zero-points differ by
the measured magnitude difference.  A system is stored as its stars, each with its detections in arrays, for there are an
order of magnitude more pairs than detections.  Summed over stars, a node pair i < j keeps two numbers, the weight w and the weighted
difference wdm; matrix and right-hand side follow from those sums, which are formed where they are asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.config import QualityCuts
from lumitie.functions import photometry as P
from lumitie.functions.epochs import epoch_index
from lumitie.operators.relational import STAR, node_columns, node_id
from lumitie.sources.stage import Stage

PIXELS_PER_STAR = 4     # a star touches at most four pixels, each capped by itself
ROWS_PER_TASK = 100_000  # detections whose pairs one task sums, at most a dozen each


def _stars(dets: DataFrame, keys, node: str, mag: str, err: str, cap: int, basis=()) -> DataFrame:
    """Stars of at least two rows, each with its detections ``_d`` as structs (k, m, v, basis) sorted by node.

    Stars are capped at ingest by ``cap`` rows, so a star's array is bounded; an uncapped star stops the job rather than being cut short.
    """
    d = F.struct(F.col(node).alias("k"), F.col(mag).alias("m"),
                 (F.col(err) * F.col(err)).alias("v"), *basis)
    stars = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(d)).alias("_d"))
    size = F.size("_d")
    safe = F.when(size <= PIXELS_PER_STAR * cap, F.col("_d")).otherwise(
        F.raise_error(F.lit("star above the detection cap; run cap_detections first")))
    return stars.where(size >= 2).select(*keys, safe.alias("_d"))


def _lists(dets: DataFrame, keys, node: str, mag: str, err: str, cap: int, basis=()) -> DataFrame:
    """Stars of at least two rows: keys and arrays k (sorted), m, v and those of ``basis``."""
    return _stars(dets, keys, node, mag, err, cap, basis).select(*keys, *[F.col("_d")[c].alias(c) for c in ("k", "m", "v", *basis)])


def star_pairs(dets: DataFrame, keys=STAR, node="node", mag="m_inst", err="m_err",
               cap: int = QualityCuts().max_detections_per_star, basis=(), parts: int | None = None) -> DataFrame:
    """One row per pair of detections of a star: nodes i <= j, w, wdm.

    For each column in ``basis`` the pair also carries its weighted difference, ``wd_<column>``.

    Nearly all node pairs of a large survey occur once, so merging them before the shuffle only fills memory.  Instead a detection
    travels once with the later ones of its star, as plain arrays, to the task of its node, which forms the pairs: all
    pairs of a node i are together and their sums need no further shuffle.  They are dealt over ``parts`` tasks (see ``tasks_for``).
    """
    return _pairs_of(_lists(dets, keys, node, mag, err, cap, basis), basis, parts)


def _pairs_of(stars: DataFrame, basis=(), parts: int | None = None) -> DataFrame:
    """The pairs of stars given as arrays."""
    names = ("k", "m", "v", *basis)
    lists = stars.select(*[F.col(c).alias(f"_l{c}") for c in names])
    first = lists.select(F.posexplode("_lk").alias("_p", "i"), *[f"_l{c}" for c in names])
    fans = first.where(F.col("_p") + 1 < F.size("_lk")).select(
        "i", (F.col("_p") == 0).alias("_first"), *[F.col(f"_l{c}")[F.col("_p")].alias(f"_a{c}") for c in names[1:]],
        *[F.slice(f"_l{c}", F.col("_p") + 2, F.size("_lk")).alias(f"_l{c}") for c in names])
    dealt = fans.repartition(parts, "i") if parts else fans.repartition("i")
    at = dealt.select("i", "_first", *[f"_a{c}" for c in names[1:]], *[f"_l{c}" for c in names], F.posexplode("_lk").alias("_q", "j"))
    w = F.lit(1.0) / (F.col("_av") + F.col("_lv")[F.col("_q")])
    diff = lambda c: w * (F.col(f"_a{c}") - F.col(f"_l{c}")[F.col("_q")])
    return at.select("i", "j", w.alias("w"), diff("m").alias("wdm"), (F.col("_first") & (F.col("_q") == 0)).cast("int").alias("opens_star"),
                     *[diff(c).alias(f"wd_{c}") for c in basis])


def tasks_for(dets: DataFrame) -> int | None:
    """Tasks that hold the sums of all pairs in memory; none where those of the session's default do."""
    n = math.ceil(dets.count() / ROWS_PER_TASK)
    return n if n > dets.sparkSession.sparkContext.defaultParallelism else None


def pair_sums(pairs: DataFrame) -> DataFrame:
    """Per node pair: total weight, weighted difference, pair count, stars opened, and the sums of any basis."""
    more = [c for c in pairs.columns if c.startswith("wd_")]
    return pairs.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("wdm").alias("wdm"),
                                       F.count(F.lit(1)).alias("n"),
                                       F.sum("opens_star").alias("opened"), *[F.sum(c).alias(c) for c in more])


def star_sums(dets: DataFrame, keys=STAR, node="node", mag="m_inst", err="m_err", cap: int = QualityCuts().max_detections_per_star) -> DataFrame:
    """Diagonal and right-hand side (i, d, rhs) straight from the stars, without a table of pairs.

    A detection is summed against those of its star on other nodes, so one row per detection is merged and moved.
    """
    stars = _stars(dets, keys, node, mag, err, cap).where(F.col("_d")[0]["k"] < F.element_at("_d", -1)["k"])
    one = stars.select(F.explode("_d").alias("a"), "_d")

    def total(term):
        part = lambda acc, x: acc + F.when(x["k"] != F.col("a.k"), F.coalesce(term(x), F.lit(0.0))).otherwise(F.lit(0.0))
        return F.aggregate("_d", F.lit(0.0), part)

    w = lambda x: F.lit(1.0) / (F.col("a.v") + x["v"])
    rows = one.select(F.col("a.k").alias("i"), total(w).alias("d"), total(lambda x: w(x) * (x["m"] - F.col("a.m"))).alias("rhs"))
    return rows.groupBy("i").agg(F.sum("d").alias("d"), F.sum("rhs").alias("rhs"))


def pair_counts(dets: DataFrame, keys=STAR, node="node") -> DataFrame:
    """One row: stars of at least two rows, their pairs of detections, and the pairs inside one node, counted without forming pairs."""
    pairs = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("long")
    held = dets.select(*keys, node).repartition(*keys).groupBy(*keys, node).agg(F.count(F.lit(1)).alias("_c"))
    stars = held.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(pairs("_c")).alias("_self")).where("_n >= 2")
    return stars.agg(F.count(F.lit(1)).alias("n_stars"), F.sum(pairs("_n")).alias("n_pairs"), F.sum("_self").alias("n_self"))


@dataclass
class System:
    """Constraints of the stars on the unknowns, and the table of all unknowns."""

    stars: DataFrame          # keys, k (unknowns, in order), m, v and arrays of any basis: a row per star
    unknowns: DataFrame       # i
    n_stars: int = 0
    n_pairs: int = 0
    n_self: int = 0
    keys: tuple = STAR

    @property
    def links(self) -> DataFrame:
        """i, j, w, wdm with i < j, summed over the stars."""
        return pair_sums(_pairs_of(self.stars)).where("i < j").select("i", "j", "w", "wdm")


def _stored(lists: DataFrame, unknowns: DataFrame | None, keys, stage: Stage, name: str) -> System:
    """The system of stars given as arrays; without ``unknowns`` these are the ones that the stars hold."""
    n = F.size("k").cast("long")
    # In an array in order, a value stands behind as many equal ones as places from the first of them.
    equal = F.aggregate(F.transform("k", lambda e, at: at.cast("long") + 1 - F.array_position("k", e)), F.lit(0).cast("long"), lambda a, x: a + x)
    repeats = F.when(F.size(F.array_distinct("k")) < n, equal).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    stars, seen = stage.write(lists, name, {"stars": F.count(F.lit(1)), "pairs": F.coalesce(F.sum(n * (n - 1) / 2), none).cast("long"),
                                            "self": F.coalesce(F.sum(repeats), none)})
    if unknowns is None:
        unknowns = stage.write(stars.select(F.explode("k").alias("i")).distinct(), f"{name}-unknowns")
    return System(stars, unknowns, int(seen["stars"]), int(seen["pairs"]), int(seen["self"]), tuple(keys))


def _detections(system: System) -> DataFrame:
    """One row per detection of a stored system: keys, k, m, v."""
    return system.stars.select(*system.keys, F.explode(F.arrays_zip("k", "m", "v")).alias("_d")).select(*system.keys, "_d.*")


def _gathered(rows: DataFrame, keys) -> DataFrame:
    """The inverse of ``_detections``, without stars of a single row."""
    d = F.sort_array(F.collect_list(F.struct("k", "m", "v")))
    stars = rows.groupBy(*keys).agg(d.alias("_d")).where(F.size("_d") >= 2)
    return stars.select(*keys, *[F.col("_d")[c].alias(c) for c in ("k", "m", "v")])


def accumulate(dets: DataFrame, nodes: DataFrame, stage: Stage, mag: str = "m_inst",
               keys=STAR, cap: int = QualityCuts().max_detections_per_star, basis=()) -> System:
    """Constraints between connected nodes.

    Repeat detections of a star on one node cancel out of the equations but count as
    pairs.  The columns in ``basis`` are stored beside the magnitudes.
    """
    keyed = nodes.select("expnum", "ccdnum", node_id().alias("node"))
    used = dets.join(keyed, ["expnum", "ccdnum"])
    return _stored(_lists(used, keys, "node", mag, "m_err", cap, basis), keyed.select(F.col("node").alias("i")), keys, stage, "stars")


def sub_system(system: System, keep: DataFrame, stage: Stage) -> System:
    """The constraints among the nodes ``keep`` (i) alone, read from the stored stars.

    A node stays an unknown while one of its stars has another detection left, on whichever node.
    """
    left = keep.select(F.col("i").alias("k")).distinct()
    return _stored(_gathered(_detections(system).join(left, "k", "left_semi"), system.keys), None, system.keys, stage, "sub-stars")


def _times(c: float):
    return lambda x: F.lit(float(c)) * x


def corrected(system: System, coeffs: dict) -> System:
    """The system for magnitudes from which sum of coefficient times basis column is taken."""
    m = F.col("m")
    for name, c in coeffs.items():
        m = F.zip_with(m, F.transform(F.col(name), _times(c)), lambda a, b: a - b)
    return replace(system, stars=system.stars.withColumn("m", m))


def gray_system(system: System, flat: DataFrame, exposure_mjd: DataFrame, bounds, stage: Stage) -> System:
    """Constraints between exposures under a star flat, derived from a node system's stars.

    Nodes of exposures without MJD carry no constraint.
    """
    at = system.unknowns.select(F.col("i").alias("k"), *node_columns("i"))
    timed = at.join(exposure_mjd.select("expnum", "mjd"), "expnum").withColumn("epoch_idx", epoch_index(F.col("mjd"), bounds))
    shifts = timed.join(flat, ["ccdnum", "epoch_idx"], "left").select(
        "k", "expnum", F.coalesce("flat_correction", F.lit(0.0)).alias("f"))
    rows = _detections(system).join(shifts, "k").select(*system.keys, F.col("expnum").alias("k"), (F.col("m") + F.col("f")).alias("m"), "v")
    return _stored(_gathered(rows, system.keys), at.select(F.col("expnum").alias("i")).distinct(), system.keys, stage, "gray-stars")


def apply_flat(dets: DataFrame, exposure_mjd: DataFrame, flat: DataFrame, bounds) -> DataFrame:
    """m_inst plus the detector's star flat; exposures without MJD drop out."""
    timed = dets.drop("mjd").join(exposure_mjd.select("expnum", "mjd"), "expnum")
    timed = timed.withColumn("epoch_idx", epoch_index(F.col("mjd"), bounds))
    joined = timed.join(flat, ["ccdnum", "epoch_idx"], "left")
    return joined.withColumn("m_flat", F.col("m_inst") + F.coalesce("flat_correction", F.lit(0.0)))


def accumulate_gray(dets: DataFrame, exposures: DataFrame, exposure_mjd: DataFrame,
                    flat: DataFrame, bounds, stage: Stage, keys=STAR,
                    cap: int = QualityCuts().max_detections_per_star) -> System:
    """Constraints between whole exposures; pairs inside one exposure carry none."""
    used = apply_flat(dets.join(exposures.select("expnum"), "expnum"), exposure_mjd, flat, bounds)
    system = _stored(_lists(used, keys, "expnum", "m_flat", "m_err", cap), exposures.select(F.col("expnum").alias("i")), keys, stage, "gray-stars")
    return replace(system, n_pairs=system.n_pairs - system.n_self)


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("i", "j", "w", "wdm").unionAll(
        links.select(F.col("j").alias("i"), F.col("i").alias("j"), "w", (-F.col("wdm")).alias("wdm")))


def matrix_entries(links: DataFrame) -> DataFrame:
    """(i, j, v) of the symmetric normal matrix."""
    full = both_ways(links)
    off = full.select("i", "j", (-F.col("w")).alias("v"))
    diag = full.groupBy("i").agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v")
    return off.unionByName(diag)


def star_matrix(dets: DataFrame, keys=STAR, node="node", mag="m_inst", parts: int | None = None) -> DataFrame:
    """(i, j, v) of the symmetric normal matrix straight from the stars: off-diagonals by node pair, the diagonal by node."""
    upper = pair_sums(star_pairs(dets, keys, node=node, mag=mag, parts=parts)).where("i < j").select("i", "j", (-F.col("w")).alias("v"))
    ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    off = upper.select(ends.alias("e"), "v").select("e.i", "e.j", "v")
    diag = star_sums(dets, keys, node=node, mag=mag).select("i", F.col("i").alias("j"), F.col("d").alias("v"))
    return off.unionByName(diag)


def right_hand_side(links: DataFrame) -> DataFrame:
    return both_ways(links).groupBy("i").agg((-F.sum("wdm")).alias("rhs"))


def exposure_links(nodes: DataFrame, strength: float) -> DataFrame:
    """Regulariser pulling the detectors of an exposure towards their mean.

    strength * (I - 11'/n) is the Laplacian of the complete graph with weight
    strength / n, hence plain zero-difference links; n is at most the camera's CCDs.
    """
    keyed = nodes.select("expnum", node_id().alias("node"))
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("expnum")))
    a = sized.select("expnum", "n", F.col("node").alias("i"))
    b = keyed.select("expnum", F.col("node").alias("j"))
    return (a.join(b, "expnum").where("i < j")
            .select("i", "j", (F.lit(float(strength)) / F.col("n")).alias("w"),
                    F.lit(0.0).alias("wdm")))


MAX_GAP_DAYS = 0.02
CHUNK_DAYS = 32.0


def consecutive_exposures(exposure_mjd: DataFrame, max_gap: float = MAX_GAP_DAYS) -> DataFrame:
    """Pairs of exposures adjacent in time and closer than ``max_gap`` days.

    Neighbours are found inside time chunks; each chunk also sees the last exposures
    before it, so no single task sorts the whole survey.
    """
    t = exposure_mjd.where(F.col("mjd").isNotNull()).select("expnum", "mjd")
    own = F.floor(F.col("mjd") / CHUNK_DAYS)
    after = F.floor((F.col("mjd") + max_gap) / CHUNK_DAYS)
    copies = t.withColumn("chunk", F.explode(F.array_distinct(F.array(own, after))))
    order = Window.partitionBy("chunk").orderBy("mjd", "expnum")
    nxt = copies.select("chunk", "expnum", "mjd", own.alias("home"),
                        F.lead(F.struct("mjd", "expnum")).over(order).alias("_n"))
    gap = F.col("_n.mjd") - F.col("mjd")
    pairs = nxt.where(F.col("_n").isNotNull() & (gap < max_gap))
    # A pair is reported by the chunk that owns its later exposure.
    pairs = pairs.where(F.floor(F.col("_n.mjd") / CHUNK_DAYS) == F.col("chunk"))
    return pairs.select("expnum", F.col("_n.expnum").alias("next_expnum"), "mjd", gap.alias("gap"))


def smoothness_links(exposures: DataFrame, exposure_mjd: DataFrame, sigma: float) -> DataFrame:
    """Zero-difference links of weight 1/sigma^2 between consecutive exposures."""
    timed = exposures.select("expnum").join(exposure_mjd.select("expnum", "mjd"), "expnum")
    pairs = consecutive_exposures(timed)
    return pairs.select(F.least("expnum", "next_expnum").alias("i"),
                        F.greatest("expnum", "next_expnum").alias("j"),
                        F.lit(1.0 / sigma ** 2).alias("w"), F.lit(0.0).alias("wdm"))


def anchor_terms(nodes: DataFrame, anchors: DataFrame, strength: float) -> DataFrame:
    """Diagonal and right-hand-side additions pulling nodes to valid reference values."""
    tied = nodes.select("expnum", "ccdnum").join(
        anchors.where(P.valid_zp(F.col("zp_fgcm"))), ["expnum", "ccdnum"])
    return tied.select(node_id().alias("i"), F.lit(float(strength)).alias("d"),
                       (F.lit(float(strength)) * F.col("zp_fgcm")).alias("b"))


def prior_terms(nodes: DataFrame, zpterm: DataFrame, strength: float, offset: float,
                default: float) -> DataFrame:
    """Pull of every node towards zpterm + offset, or ``default`` where there is none."""
    aim = nodes.select("expnum", "ccdnum").join(zpterm, ["expnum", "ccdnum"], "left")
    target = F.coalesce(F.col("zpterm") + F.lit(offset), F.lit(default))
    return aim.select(node_id().alias("i"), F.lit(float(strength)).alias("d"),
                      (F.lit(float(strength)) * target).alias("b"))
