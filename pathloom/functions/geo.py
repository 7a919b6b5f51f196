"""Geographic expressions as Column trees (JVM side, code-generated) and their numpy twins for kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius in metres, metres in a mile.
EARTH_M = 6378137.0
MILE_M = 1609.344


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lon1, lat1, lon2, lat2, radius: float = EARTH_M) -> Column:
    """Great-circle metres between two points in degrees; null if any part is null."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = a2 - a1, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def np_haversine_m(lon1, lat1, lon2, lat2, radius: float = EARTH_M) -> np.ndarray:
    """numpy twin of :func:`haversine_m`."""
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(np.asarray(lon2) - np.asarray(lon1)) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def mercator_x(lon) -> Column:
    return F.lit(EARTH_M) * F.radians(col(lon))


def mercator_y(lat) -> Column:
    return F.lit(EARTH_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2))


def mercator_distance(lon1, lat1, lon2, lat2) -> Column:
    """Planar metres in spherical Mercator, larger than on the ground by about 1/cos(lat)."""
    return F.sqrt(F.pow(mercator_x(lon1) - mercator_x(lon2), F.lit(2.0)) + F.pow(mercator_y(lat1) - mercator_y(lat2), F.lit(2.0)))


def utm(lon, lat, zone: int = 16) -> tuple[Column, Column]:
    """Easting and northing on WGS84 in a northern UTM zone, by the Krueger series to the third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(col(lat)), F.radians(col(lon)) - math.radians(6 * zone - 183)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi0, eta0 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, al in enumerate(alpha, 1):
        xi = xi + al * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + al * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return 0.9996 * big_a * eta + 500000.0, 0.9996 * big_a * xi


def in_bbox(lon, lat, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Inclusive box test."""
    return col(lon).between(xmin, xmax) & col(lat).between(ymin, ymax)


def from_mercator(x, y) -> tuple[Column, Column]:
    """Longitude and latitude of a position in spherical Mercator."""
    return F.degrees(col(x) / EARTH_M), F.degrees(2 * F.atan(F.exp(col(y) / EARTH_M)) - F.lit(math.pi / 2))


def from_utm(easting, northing, zone: int = 16) -> tuple[Column, Column]:
    """Longitude and latitude of a position in a northern UTM zone on WGS84, by the inverse Krueger series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    xi, eta = col(northing) / (0.9996 * big_a), (col(easting) - 500000.0) / (0.9996 * big_a)
    x1, e1 = xi, eta
    for j, b in enumerate(beta, 1):
        x1 = x1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e1 = e1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x1) / F.cosh(e1))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(e1), F.cos(x1))) + (6 * zone - 183), F.degrees(phi)
