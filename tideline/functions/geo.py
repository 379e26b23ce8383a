"""Distances, weights and numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EARTH_KM = 6371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: The weight of the far ones, and the distance over which a weight falls to 1/e.
FAR_WEIGHT, KM_SCALE = 0.03, 1200


def w_geo(km: Column) -> Column:
    return F.greatest(F.lit(FAR_WEIGHT), F.exp(-km / KM_SCALE))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def damp(x: Column, beta: float) -> Column:
    return F.pow(x, F.lit(beta))


def winsorize(x: Column, centre: Column, factor: float) -> Column:
    return F.least(F.greatest(x, centre / factor), centre * factor)


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds half up (also for negative values); null for what isn't finite."""
    f = float(10**places)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~bad, F.floor(x * f + 0.5) / f)


def region_label(lat: Column, lon: Column) -> Column:
    """The first box that holds the point (fixed values)."""
    return (
        F.when(lon.between(-30, 45) & (lat >= 34), "Europe")
        .when(lon.between(-20, 55) & (lat < 34) & (lat > -40), "Africa & Middle East")
        .when((lon > 45) & (lon <= 150) & (lat >= 5), "Asia")
        .when((lon > 100) & (lat < 5), "Oceania")
        .when((lon < -30) & (lat >= 15), "North America")
        .when((lon < -30) & (lat < 15), "South America")
        .otherwise("Elsewhere")
    )
