"""Cells on the sphere for equality joins of nearby points.

A level's bands are 2**level degrees high; each is cut into as many equal cells as fit, none narrower on the ground than a band is high, so a
circle no wider in radius than a band is high reaches into few cells anywhere, over the date line and at the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import haversine_km  # noqa: F401  the distance that cells are made for

RADIUS = 6371.0
LEAST = -10


def level_of(km: Column) -> Column:
    """The level whose bands are at least as high as a distance. Beyond a quarter of the earth's round there is but one cell."""
    degrees = F.greatest(km, F.lit(1e-3)) / F.lit(math.pi * RADIUS / 180) * F.lit(1 + 1e-9)
    return F.greatest(F.lit(LEAST), F.least(F.lit(8), F.ceil(F.log2(degrees)))).cast("int")


def _across(level: Column, y: Column) -> Column:
    """Cells of a band."""
    high = F.pow(F.lit(2.0), level)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(y * high - 90), F.abs((y + 1) * high - 90)))
    return F.when(level >= 7, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / high))).cast("long")


def cell(level: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(band, cell) of a point."""
    y = F.floor((lat + 90) / F.pow(F.lit(2.0), level)).cast("long")
    n = _across(level, y)
    return y, F.least(n - 1, F.floor(F.pmod(lon, F.lit(360.0)) / (F.lit(360.0) / n)).cast("long"))


def cover(level: Column, lat: Column, lon: Column, km: Column) -> Column:
    """An array of (y, x): all cells that a circle reaches into."""
    high = F.pow(F.lit(2.0), level)
    reach = km / F.lit(math.pi * RADIUS / 180) * F.lit(1 + 1e-9) + F.lit(1e-9)
    low = F.floor((F.greatest(F.lit(-90.0), lat - reach) + 90) / high).cast("long")
    top = F.floor((F.least(F.lit(90.0), lat + reach) + 90) / high).cast("long")
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(F.lit(90.0), reach))) / F.cos(F.radians(lat))))) + F.lit(1e-9)
    pole = F.abs(lat) + reach >= F.lit(90.0)

    def band(y: Column) -> Column:
        n = _across(level, y)
        wide = F.lit(360.0) / n
        first, last = F.floor((lon - half) / wide).cast("long"), F.floor((lon + half) / wide).cast("long")
        every = F.sequence(F.lit(0).cast("long"), n - 1)
        some = F.array_distinct(F.transform(F.sequence(first, F.greatest(first, F.least(last, first + n))), lambda x: F.pmod(x, n)))
        return F.transform(F.when(pole | (last - first >= n), every).otherwise(some), lambda x: F.struct(y.alias("y"), x.alias("x")))

    return F.flatten(F.transform(F.sequence(low, top), band))
