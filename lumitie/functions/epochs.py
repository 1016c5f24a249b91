"""Instrument epochs and observing nights."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumitie.config import EpochBoundaries


def _count(conditions) -> Column:
    terms = [c.cast("int") for c in conditions]
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def epoch_index(mjd: Column, boundaries) -> Column:
    """Number of boundaries at or before ``mjd`` (a boundary opens its epoch)."""
    return _count([mjd >= F.lit(float(b)) for b in sorted(boundaries)])


def epoch_for_ccd(mjd: Column, ccdnum: Column, bounds: EpochBoundaries) -> Column:
    """Number of boundaries strictly before ``mjd``, with the CCD's own ones added."""
    shared = set(bounds.all_ccds)
    base = _count([mjd > F.lit(float(b)) for b in sorted(shared)])
    out = base
    for ccd, extra in sorted(bounds.per_ccd.items()):
        merged = sorted(shared | set(extra))
        out = F.when(ccdnum == ccd, _count([mjd > F.lit(float(b)) for b in merged])).otherwise(out)
    return out.cast("int")


def night(mjd: Column) -> Column:
    return F.floor(mjd).cast("long")


def mjd_from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(86400e6) + F.lit(40587.0)
