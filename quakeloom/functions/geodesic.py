"""Distance and azimuths on the WGS84 ellipsoid: Vincenty's inverse method on whole Arrow batches, with a fixed number of steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import RADIUS_KM, _c

#: WGS84, kilometres. Fixed values.
A, FLAT = 6378.137, 1 / 298.257223563
B = A * (1 - FLAT)
#: Each step is about 300 times nearer, but for points that lie nearly opposite each other.
STEPS = 10


def solve(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(km, azimuth, back azimuth) of each pair; see ``inverse``."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    l = np.radians((lon2 - lon1 + 180) % 360 - 180)

    def arc(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sine and cosine of the arc, the arc, sine of its azimuth at the equator, the square of that cosine, and the cosine of twice its middle."""
        ss, cs = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)), s1 * s2 + c1 * c2 * np.cos(lam)
        sa = np.where(ss == 0, 0.0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1.0, ss))
        ca = 1 - sa * sa
        return ss, cs, np.arctan2(ss, cs), sa, ca, np.where(ca <= 1e-15, 0.0, cs - 2 * s1 * s2 / np.where(ca <= 1e-15, 1.0, ca))

    lam, by = l, np.ones_like(l)
    for _ in range(steps):
        ss, cs, s, sa, ca, m = arc(lam)
        c = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
        after = l + (1 - c) * FLAT * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
        lam, by = after, np.abs(after - lam)
    ss, cs, s, sa, ca, m = arc(lam)
    u2 = ca * ((A * A - B * B) / (B * B))
    big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    m2 = m * m
    ds = small * ss * (m + small / 4 * (cs * (2 * m2 - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m2 - 3)))
    km, az, on = B * big * (s - ds), np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)), np.arctan2(c1 * np.sin(lam), c1 * s2 * np.cos(lam) - s1 * c2)
    # On the sphere where the steps did not settle.
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(l / 2) ** 2
    ball = 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
    ball_az, ball_on = np.arctan2(np.sin(l) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(l)), np.arctan2(np.sin(l) * np.cos(a), np.cos(a) * np.sin(b) * np.cos(l) - np.sin(a) * np.cos(b))
    lost, same = ~((by <= 1e-11) & (np.abs(lam) <= np.pi)) | ((ss == 0) & (cs <= 0)), (ss == 0) & (cs > 0)
    pick = lambda exact, sphere: np.where(same, 0.0, np.where(lost, sphere, exact))
    return pick(km, ball), pick(np.degrees(az) % 360, np.degrees(ball_az) % 360), pick((np.degrees(on) + 180) % 360, (np.degrees(ball_on) + 180) % 360)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("km", "az", "baz")]))
def _inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("km", "az", "baz"), solve(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))), strict=True)))


def inverse(lat1, lon1, lat2, lon2) -> Column:
    """A struct ``km, az, baz``: the distance, the azimuth at the first point of the way to the second, and at the second of the way back, 0 to 360.

    Equal points are 0 km apart. Nearly opposite points, for which the steps do not settle, get the great circle of the sphere. Null for a null.
    """
    args = [_c(x).cast("double") for x in (lat1, lon1, lat2, lon2)]
    known = args[0].isNotNull() & args[1].isNotNull() & args[2].isNotNull() & args[3].isNotNull()
    return F.when(known, _inverse(*args))
