"""Selection, capping, keyed lookups and flag removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.sources.stage import Stage

STAR = ("healpix_pixel", "objectid")     # a star inside one stored pixel
#: The same to sort by: pixels are few, and rows that agree in the first key are compared whole.
BY_STAR = ("objectid", "healpix_pixel")
NODE = ("expnum", "ccdnum")              # one detector of one exposure


def node_id(expnum="expnum", ccdnum="ccdnum"):
    """Reversible 64-bit key of a node, so no global numbering pass is needed."""
    return F.shiftleft(F.col(expnum).cast("long"), 10).bitwiseOR(F.col(ccdnum).cast("long"))


def node_columns(key="node"):
    return (F.shiftright(F.col(key), 10).alias("expnum"),
            F.col(key).bitwiseAND(F.lit(1023)).cast("int").alias("ccdnum"))


def cap_detections(df: DataFrame, limit: int, keys=BY_STAR, tiebreak=("expnum", "ccdnum", "mjd")):
    """The ``limit`` detections of each star with the smallest errors.

    The row_number filter lets Spark keep only ``limit`` rows per star in every map task
    before the shuffle, so a star with a huge share of the rows stays harmless.
    """
    order = [F.col("m_err"), *[F.col(c) for c in tiebreak if c in df.columns]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


#: Rows of a file that are numbered by one task.
ARRIVAL_ROWS = 1 << 20
ARRIVAL = ("arrival_file", "arrival_row")


def arrival_index(df: DataFrame, keys=STAR, name: str = "arrival", chunk_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Number the rows of each key from 0 in the order in which the source holds them.

    The order is that of files and rows of the scan (see ``tables.with_arrival``), so it does not depend on how Spark divides
    the work.  Rows are numbered inside chunks of a file and shifted by the key's rows in the chunks before, so a
    key with a huge share of the rows is dealt over the chunks it comes from.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col("arrival_row") / chunk_rows))
    part = [*keys, "arrival_file", "_chunk"]
    sizes = chunked.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("arrival_file", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("arrival_row"))
    return (chunked.withColumn("_row", inside).join(starts, part)
            .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_chunk", "_row", "_start"))


def cap_arrivals(df: DataFrame, limit: int, keys=STAR) -> DataFrame:
    """The first ``limit`` rows of each key in the source's order; every map task keeps that many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ARRIVAL))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def min_detections(df: DataFrame, least: int, keys=BY_STAR) -> DataFrame:
    """Rows of stars with at least ``least`` rows.  Input groups are capped already."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.col("_n") >= least).drop("_n")


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the one that sorts last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the one that sorts first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def remove_flagged(df: DataFrame, stars=None, detections=None, exposures=None, nodes=None,
                   keys=BY_STAR, least: int = 2) -> DataFrame:
    """Anti-join the four kinds of flags, then drop stars left with too few rows."""
    for flags, on in ((stars, ["objectid"]), (detections, ["objectid", *NODE]),
                      (exposures, ["expnum"]), (nodes, list(NODE))):
        if flags is not None:
            df = df.join(flags, on, "left_anti")
    return min_detections(df, least, keys)


def dense_index(df: DataFrame, keys, stage: Stage, name: str = "idx") -> DataFrame:
    """Distinct keys numbered 0..N-1 in key order without a single-task sort.

    Range partitions are numbered inside themselves and shifted by the count of the
    partitions before them; only one count per partition is gathered.
    """
    ranged = df.select(*keys).distinct().repartitionByRange(*keys)
    placed = stage.write(ranged.withColumn("_part", F.spark_partition_id()), "dense-index")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (placed.withColumn("_row", inside).join(offsets, "_part")
            .select(*keys, (F.col("_start") + F.col("_row") - 1).cast("long").alias(name)))
