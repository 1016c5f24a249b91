"""Exact order statistics, clipping, binning.

``F.median`` is used where a group is bounded by nature (detectors of one exposure,
exposures of one night).  Groups that grow with the data go through ``quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000


def attach(df: DataFrame, per_group: DataFrame, keys, few: bool = False) -> DataFrame:
    """Join a per-group table to its rows; Catalyst broadcasts it if it is small.

    Groups that are ``few`` by nature (bins, detectors and epochs) are always broadcast: a table that comes out of an aggregation has no size
    beforehand, and rows dealt by so few keys would meet in as few tasks.
    """
    return df.join(F.broadcast(per_group) if few else per_group, list(keys))


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def exact_mean(value: str) -> Column:
    """Mean of angles that does not depend on the order of the rows: summed as decimals of 16 places, rounded once.

    Positions are compared with bin edges, where the rounding noise of a floating sum would decide.
    """
    return F.avg(F.col(value).cast("decimal(20,16)")).cast("double")


def quantiles(df: DataFrame, value: str, probs: dict, keys=(), accuracy: int = SKETCH_ACCURACY,
              small: int | None = None, few: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group, plus ``n``.

    A mergeable sketch brackets each target rank; a second pass counts the rows below
    the bracket and ranks only the values inside it, a few in ``accuracy`` of the group.
    Groups up to ``small`` rows are bracketed by their extremes; both brackets give the same exact
    answer.  No task ever holds a whole large group, and a bracket that missed its rank raises
    instead of answering.  With ``few`` groups, or a single one, the rows stay where they are (see ``attach``).
    """
    few = few or not keys
    small = 4 * accuracy if small is None else small
    keys = list(keys) or ["_all"]
    rows = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    margin = 4.0 / accuracy
    cuts = [p for q in probs.values() for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"))
    tiny = F.col("n") <= small
    brackets = F.array(*[
        F.struct(F.lit(k).alias("k"),
                 F.when(tiny, F.col("_min")).otherwise(F.col("_cuts")[2 * k]).alias("lo"),
                 F.when(tiny, F.col("_max")).otherwise(F.col("_cuts")[2 * k + 1]).alias("hi"))
        for k in range(len(probs))])
    sketch = sketch.select(*keys, "n", brackets.alias("_b"))

    # Values under a bracket collapse to one NULL row per map task and group.
    inside = (attach(rows, sketch, keys, few)
              .select(*keys, "n", "_v", F.explode("_b").alias("_b"))
              .where(F.col("_v") <= F.col("_b.hi"))
              .select(*keys, "n", F.col("_b.k").alias("_k"),
                      F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")))
    counted = inside.groupBy(*keys, "_k", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    order = Window.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("_c").over(order))

    prob = F.element_at(F.array(*[F.lit(float(q)) for q in probs.values()]), F.col("_k") + 1)
    h = prob * (F.col("n") - 1)
    low_rank, high_rank = F.floor(h) + 1, F.ceil(h) + 1
    per = ranked.groupBy(*keys, "_k").agg(
        F.first("n").alias("n"),
        F.first(h - F.floor(h)).alias("_frac"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_cum") >= low_rank)),
                   F.lit(False)).alias("_under"),
        F.min(F.when(F.col("_cum") >= low_rank, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= high_rank, F.col("_v"))).alias("_hi"))
    missed = F.col("_under") | F.col("_lo").isNull() | F.col("_hi").isNull()
    answer = F.when(~missed, F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).otherwise(
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
    per = per.withColumn("_q", answer)
    out = per.groupBy(*keys).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(name) for k, name in enumerate(probs)])
    return out.drop("_all")


def scalar_quantiles(df: DataFrame, value: str, probs: dict) -> dict:
    """Quantiles of a whole column and its count ``n`` as Python numbers; None for an empty column."""
    row = quantiles(df, value, probs).first()
    return {**{k: row[k] if row else None for k in probs}, "n": row["n"] if row else 0}


def scalar_median(df: DataFrame, value: str):
    return scalar_quantiles(df, value, {"median": 0.5})["median"]


def robust_stats(df: DataFrame, value: str, keys=(), few: bool = False) -> DataFrame:
    """Per group: n, median, mad and sigma = 1.4826 MAD, or the population std when MAD is 0."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    med = quantiles(rows, value, {"median": 0.5}, keys, few=few).drop("n")
    joined = attach(rows, med, keys, few) if keys else attach_scalar(rows, med)
    dev = joined.withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(dev, "_dev", {"mad": 0.5}, keys, few=few)
    spread = dev.groupBy(*keys).agg(F.first("median").alias("median"),
                                    F.stddev_pop(value).alias("_std"))
    out = attach(mad, spread, keys, few) if keys else attach_scalar(mad, spread)
    sigma = F.when(F.col("mad") > 0, F.lit(1.4826) * F.col("mad")).otherwise(F.col("_std"))
    return out.select(*keys, "n", "median", "mad", sigma.alias("sigma"))


def bin_index(c: Column, lo: float, width: float, n_bins: int | None = None) -> Column:
    """Bin of the grid lo, lo + width, ..., negative below ``lo``.

    With ``n_bins`` values outside are NULL and the last bin takes its upper edge as well.
    """
    b = F.floor((c - F.lit(float(lo))) / F.lit(float(width))).cast("int")
    if n_bins is None:
        return b
    inside = (c >= F.lit(float(lo))) & (c <= F.lit(float(lo + width * n_bins)))
    return F.when(inside, F.least(b, F.lit(n_bins - 1)))


def histogram(df: DataFrame, value: str, lo: float, width: float, n_bins: int | None = None, keys=()) -> DataFrame:
    """Counts per bin."""
    return (df.withColumn("bin", bin_index(F.col(value), lo, width, n_bins)).where(F.col("bin").isNotNull())
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("center", F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)))


def histogram2d(df: DataFrame, x: str, y: str, x_grid, y_grid) -> DataFrame:
    """Counts per cell of two grids (lo, width) or (lo, width, n_bins)."""
    return (df.select(bin_index(F.col(x), *x_grid).alias("bin_x"),
                      bin_index(F.col(y), *y_grid).alias("bin_y"))
            .where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
            .groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


def binned_median(df: DataFrame, x: str, value: str, lo: float, width: float, n_bins: int | None = None,
                  least: int = 1, keys=()) -> DataFrame:
    """Median, standard error (sample std / sqrt n) and count per bin with enough rows."""
    keys = list(keys)
    binned = df.withColumn("bin", bin_index(F.col(x), lo, width, n_bins)).where(
        F.col("bin").isNotNull() & F.col(value).isNotNull())
    med = quantiles(binned, value, {"median": 0.5}, [*keys, "bin"], few=True)
    spread = binned.groupBy(*keys, "bin").agg(F.stddev_samp(value).alias("std"))
    return (med.where(F.col("n") >= least).join(spread, [*keys, "bin"])
            .select(*keys, "bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"),
                    "n", "median", "std", (F.col("std") / F.sqrt("n")).alias("std_err")))
