"""Angles on the sphere."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Haversine distance, accurate at small angles."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    sd = F.sin((d2 - d1) / 2.0)
    sr = F.sin(F.radians(ra2 - ra1) / 2.0)
    h = sd * sd + F.cos(d1) * F.cos(d2) * sr * sr
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))) * 3600.0
