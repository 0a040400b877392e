"""Geometry as column expressions. Angles in degrees, distances in kilometres on a sphere of radius 6371 km."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the argument of the arc sine is held at 1."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def km_to_degrees(km) -> Column:
    return _c(km) / (F.pi() * RADIUS_KM / 180)


def degrees_to_km(deg) -> Column:
    return _c(deg) * (F.pi() * RADIUS_KM / 180)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Azimuth from the first point to the second, 0 to 360."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    raw = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(raw + 360, F.lit(360.0))


def flat_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance: 111 km to a degree, longitudes shortened by the first latitude's cosine."""
    return F.hypot((_c(lat2) - _c(lat1)) * KM_PER_DEGREE, (_c(lon2) - _c(lon1)) * KM_PER_DEGREE * F.cos(F.radians(_c(lat1))))


def hypocentral_km(epicentral, depth_km, elevation_m) -> Column:
    return F.hypot(_c(epicentral), _c(depth_km) + _c(elevation_m) / 1000)


def wrap_longitude(lon) -> Column:
    """0 to 360 becomes -180 to 180."""
    return F.when(_c(lon) > 180, _c(lon) - 360).otherwise(_c(lon))


def degree_minutes(value, positive: str, negative: str) -> Column:
    """Whole degrees, minutes and the hemisphere's letter."""
    size = F.abs(_c(value))
    return F.struct(F.floor(size).cast("int").alias("degrees"), ((size - F.floor(size)) * 60).alias("minutes"), F.when(_c(value) >= 0, positive).otherwise(negative).alias("hemisphere"))


def attenuation(r_km, n: float, k: float) -> Column:
    """Geometric and anelastic loss relative to 100 km; distances under a metre count as one."""
    r = F.greatest(_c(r_km), F.lit(0.001))
    return n * F.log10(r / 100) + k * r


def in_box(lat, lon, south: float, north: float, west: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)
