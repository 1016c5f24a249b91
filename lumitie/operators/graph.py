"""Overlap graph between detector exposures and its connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.operators.normal import tasks_for
from lumitie.operators.relational import STAR, node_columns, node_id
from lumitie.sources.stage import Stage


def star_nodes(dets: DataFrame, keys=STAR) -> DataFrame:
    """Distinct (star, node) rows of stars seen on at least two distinct nodes."""
    from lumitie.operators.relational import min_detections

    # Dealt by star once, for the distinct rows and for their count.
    distinct = dets.select(*keys, node_id().alias("node")).repartition(*keys).distinct()
    return min_detections(distinct, 2, keys)


def spanning_edges(members: DataFrame, keys=STAR) -> DataFrame:
    """Every node of a star tied to the star's smallest node: enough for connectivity.  Stars are bounded, edges may repeat."""
    hub = F.min("node").over(Window.partitionBy(*keys))
    return members.withColumn("hub", hub).where(F.col("node") > F.col("hub")).select(F.col("node").alias("u"), F.col("hub").alias("v"))


def overlap_edges(members: DataFrame, keys=STAR, key: str = "node", parts: int | None = None) -> DataFrame:
    """Node pairs src < dst with the number of stars both saw.

    A star contributes at most max_detections_per_star nodes, so its pairs are bounded.  A node travels once with the star's later ones
    to the task that counts all pairs of that node (see ``normal.star_pairs``).
    """
    stars = members.groupBy(*keys).agg(F.sort_array(F.collect_list(key)).alias("_m"))
    first = stars.select(F.posexplode("_m").alias("_p", "src"), "_m")
    fans = first.where(F.col("_p") + 1 < F.size("_m")).select("src", F.slice("_m", F.col("_p") + 2, F.size("_m")).alias("_m"))
    dealt = fans.repartition(parts, "src") if parts else fans.repartition("src")
    return dealt.select("src", F.explode("_m").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_shared"))


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row: edge count and min / truncated median / mean / max of shared stars."""
    from lumitie.operators.robust import attach_scalar, quantiles

    med = quantiles(edges, "n_shared", {"m": 0.5}).select("m")
    base = edges.agg(F.count(F.lit(1)).alias("n_edges"),
                     F.coalesce(F.min("n_shared"), F.lit(0)).cast("long").alias("edge_stars_min"),
                     F.coalesce(F.avg("n_shared"), F.lit(0.0)).alias("edge_stars_mean"),
                     F.coalesce(F.max("n_shared"), F.lit(0)).cast("long").alias("edge_stars_max"))
    joined = attach_scalar(base, med.agg(F.max("m").alias("m")))
    return joined.select("n_edges", "edge_stars_min",
                         F.coalesce(F.col("m").cast("int"), F.lit(0)).alias("edge_stars_median"),
                         "edge_stars_mean", "edge_stars_max")


def spanned_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``connected_components`` where there are far more edges than nodes.

    The rounds first run over one edge of each node, that to its smallest neighbour.  Edges between
    two components found that way, as a rule none, are contracted in turn: all edges are read twice, however many rounds there are.
    """
    every = stage.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "cc-edges")
    found = stage.write(connected_components(every.groupBy("u").agg(F.min("v").alias("v")), stage), "cc-found")
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    # A node without a smaller neighbour may be the smallest neighbour of none.
    met = every.join(label("u"), "u").join(label("v"), "v", "left").select(F.col("_u").alias("u"), F.coalesce("_v", "v").alias("v"))
    rest, seen = stage.write(met.where("u <> v").distinct(), "cc-rest", {"n": F.count(F.lit(1))})
    stage.drop(every)
    if not seen["n"]:
        return found
    joined = stage.write(connected_components(rest, stage), "cc-joined")
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    alone = joined.join(found.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return found.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")).unionByName(alone)


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) with the smallest node of each component as its label.

    Alternating large-star and small-star contraction (Kiveris et al. 2014) on edges
    u > v: rounds grow with the logarithm of the graph, not with its diameter.  Both
    steps are a grouped minimum joined back, so a hub is a join key AQE can split.
    """
    current = stage.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .where("u <> v").distinct(), "cc-edges")
    print_of = None
    while True:  # ends: labels only ever decrease
        both = current.select("u", "v").unionByName(
            current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
                 .where("u <> v").distinct())
        after, seen = stage.write(small, "cc-edges", {
            "n": F.count(F.lit(1)),
            "h": F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))})
        stage.drop(current)
        current = after
        if (seen["n"], seen["h"]) == print_of:
            break
        print_of = (seen["n"], seen["h"])
    roots = current.select(F.col("v").alias("node")).distinct()
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.withColumn("component", F.col("node"))))


def select_component(components: DataFrame, anchor_exposures: DataFrame) -> DataFrame:
    """Mark each node as connected or dropped, and as an anchor node.

    The chosen component is the one with the most nodes among those holding an anchor
    exposure, the smallest label winning ties; without any, every node is kept.
    """
    exps = anchor_exposures.select("expnum").distinct().withColumn("_anchor", F.lit(True))
    nodes = components.select("node", *node_columns(), "component")
    nodes = nodes.join(exps, "expnum", "left").withColumn(
        "is_anchor", F.coalesce("_anchor", F.lit(False))).drop("_anchor")
    best = (nodes.groupBy("component")
            .agg(F.count(F.lit(1)).alias("size"), F.max("is_anchor").alias("has"))
            .agg(F.max_by("component", F.when(F.col("has"), F.struct("size", -F.col("component"))))
                 .alias("chosen")))
    from lumitie.operators.robust import attach_scalar

    marked = attach_scalar(nodes, best)
    keep = F.col("chosen").isNull() | (F.col("component") == F.col("chosen"))
    return marked.select("node", "expnum", "ccdnum", "component", "is_anchor",
                         keep.alias("connected"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def connectivity_report(dets: DataFrame, marked: DataFrame, edges: DataFrame, keys=STAR) -> DataFrame:
    """One-row summary of the overlap graph."""
    from lumitie.operators.robust import attach_scalar

    stars = (dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.count(F.when(F.col("_n") >= 2, 1)).alias("n_stars"),
                  F.coalesce(F.sum("_n"), F.lit(0)).alias("n_detections")))
    nodes = marked.agg(
        F.count(F.lit(1)).alias("n_nodes_total"),
        F.count(F.when(F.col("connected"), 1)).alias("n_nodes_connected"),
        F.count(F.when(~F.col("connected"), 1)).alias("n_nodes_dropped"),
        F.count(F.when(F.col("connected") & F.col("is_anchor"), 1)).alias("n_anchor_nodes"))
    comps = component_sizes(marked).agg(F.count(F.lit(1)).alias("n_components"),
                                        F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    out = attach_scalar(attach_scalar(attach_scalar(nodes, comps), stars), edge_stats(edges))
    pct = F.when(F.col("n_nodes_total") > 0,
                 F.lit(100.0) * F.col("n_nodes_connected") / F.col("n_nodes_total")).otherwise(0.0)
    return out.withColumn("pct_connected", pct)


def exposure_overlaps(dets: DataFrame, positions: DataFrame, keys=("objectid",)) -> DataFrame:
    """Exposure pairs with shared stars and their RA distance.

    Exposures bring their position to the star, so the far more numerous pairs are joined with nothing.
    """
    seen = dets.select(*keys, "expnum").distinct().join(positions.select("expnum", "exp_ra"), "expnum", "left")
    lists = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("expnum", "exp_ra"))).alias("_d"))
    lists = lists.select(F.col("_d")["expnum"].alias("_m"), F.col("_d")["exp_ra"].alias("_ra"))
    first = lists.select(F.posexplode("_m").alias("_p", "exp1"), "_m", "_ra").where(F.col("_p") + 1 < F.size("_m"))
    later = lambda c: F.slice(c, F.col("_p") + 2, F.size("_m")).alias(c)
    fans = first.select("exp1", F.col("_ra")[F.col("_p")].alias("ra1"), later("_m"), later("_ra"))
    parts = tasks_for(dets)
    dealt = fans.repartition(parts, "exp1") if parts else fans.repartition("exp1")
    pairs = dealt.select("exp1", "ra1", "_ra", F.posexplode("_m").alias("_q", "exp2"))
    return pairs.groupBy("exp1", "exp2").agg(F.count(F.lit(1)).alias("n_shared"), F.max(F.abs(F.col("ra1") - F.col("_ra")[F.col("_q")])).alias("dra"))


def exposure_degree(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("exp1").alias("expnum")).unionAll(
        pairs.select(F.col("exp2").alias("expnum")))
    return ends.groupBy("expnum").agg(F.count(F.lit(1)).alias("n_overlaps"))
