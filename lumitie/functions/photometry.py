"""Magnitude, weight, colour and extinction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumitie.config import EXTINCTION, QualityCuts

ZP_LOW, ZP_HIGH = 25.0, 35.0          # physical zero-points; everything else is a sentinel
DEFAULT_MAGZERO = 31.45
REFERENCE_EXPTIME = 90.0
SOFT_FLOOR = 1.0e-6                   # error floor in mag^2 of the detrending weights


def quality_predicate(cuts: QualityCuts) -> Column:
    return ((F.col("flags") <= cuts.flags_max)
            & (F.col("class_star") > cuts.class_star_min)
            & (F.col("magerr_aper4") < cuts.magerr_max)
            & (F.col("mag_aper4") > cuts.mag_min)
            & (F.col("mag_aper4") < cuts.mag_max)
            & ~F.col("ccdnum").isin(*cuts.exclude_ccdnums))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid_zp(zp: Column) -> Column:
    return (zp > ZP_LOW) & (zp < ZP_HIGH)


def weight(err: Column, floor: float = 0.0) -> Column:
    """Inverse variance; ``floor`` is 0 for the catalog and SOFT_FLOOR for detrending."""
    return F.lit(1.0) / (err * err + F.lit(floor)) if floor else F.lit(1.0) / (err * err)


def exptime_normalised(mag_zero: Column, exptime: Column) -> Column:
    seconds = F.coalesce(exptime, F.lit(REFERENCE_EXPTIME))
    return mag_zero - F.lit(2.5) * F.log10(seconds / F.lit(REFERENCE_EXPTIME))


def colour(band: str, this_band: Column, other_band: Column) -> Column:
    """g - r whichever of the two is the band under study."""
    return this_band - other_band if band == "g" else other_band - this_band


def deredden(mag: Column, system: str, ebv: Column) -> Column:
    return mag - F.lit(EXTINCTION[system]) * ebv


def deredden_colour(c: Column, first: str, second: str, ebv: Column) -> Column:
    return c - F.lit(EXTINCTION[first] - EXTINCTION[second]) * ebv


def scatter_mmag(mag_err: Column, nobs: Column) -> Column:
    return mag_err * F.sqrt(nobs) * F.lit(1000.0)


def exposure_class(exptime: Column) -> Column:
    return (F.when(exptime > 100.0, "deep_>100s")
            .when(exptime == 90.0, "normal_90s").otherwise("other"))


def depth_class(exptime: Column) -> Column:
    """Exposure class where a missing exposure time means outside the anchor survey."""
    return (F.when(exptime > 100.0, "DES_deep").when(exptime == 90.0, "DES_90s")
            .when(exptime > 0.0, "DES_other").otherwise("non-DES"))


# Labels of the observing programs.
PROGRAMS = ("DES_survey_90s", "DES_SN_deep", "DES_45s", "DES_long", "DES_other",
            "DECam_no_DES_ZP", "non-DES", "unknown")


def program_class(instrument: Column, exptime: Column) -> Column:
    name = F.coalesce(instrument, F.lit("unknown"))
    decam = name.startswith("c4d")
    return (F.when(decam & exptime.isNull(), "DECam_no_DES_ZP")
            .when(decam & (exptime == 90.0), "DES_survey_90s")
            .when(decam & (exptime == 45.0), "DES_45s")
            .when(decam & exptime.isin(175.0, 200.0), "DES_SN_deep")
            .when(decam & exptime.isin(330.0, 360.0, 400.0), "DES_long")
            .when(decam, "DES_other")
            .when(name != "unknown", "non-DES").otherwise("unknown"))


def polynomial(x: Column, coeffs) -> Column:
    """Horner form; coefficients from the highest power down."""
    out = F.lit(float(coeffs[0]))
    for c in coeffs[1:]:
        out = out * x + F.lit(float(c))
    return out
