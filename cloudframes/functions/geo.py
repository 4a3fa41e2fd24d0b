"""Distances, angles and local coordinates as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def wrap180(deg: Column) -> Column:
    """Degrees in (-180, 180]."""
    d = F.pmod(deg, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def gps_or_null(lat: Column, lon: Column, rel_alt: Column | None = None, abs_alt: Column | None = None) -> Column:
    """A fix, or null where neither coordinate is told from zero."""
    none = F.lit(None).cast("double")
    fix = F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), (none if rel_alt is None else rel_alt).alias("rel_alt_m"), (none if abs_alt is None else abs_alt).alias("abs_alt_m"))
    return F.when((F.abs(lat) > 1e-6) | (F.abs(lon) > 1e-6), fix)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> list[Column]:
    """East, north and up in metres from an origin, on its tangent plane."""
    return [F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M, alt - alt0]
