"""Transverse Mercator projection as column expressions, by series in the third flattening (Krüger, to order 4)."""

from __future__ import annotations

from math import atan, atanh, radians, sin, sinh, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EPSG code: central meridian, latitude of origin, scale, false easting, false northing, semi-major axis, flattening.
PROJECTIONS = {
    32629: (-9.0, 0.0, 0.9996, 500_000.0, 0.0, 6378137.0, 1 / 298.257223563),
    3763: (-8.133108333333334, 39.66825833333333, 1.0, 0.0, 0.0, 6378137.0, 1 / 298.257222101),
}


def _series(flattening: float) -> tuple[float, float, list[float], list[float]]:
    n = flattening / (2 - flattening)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return n, radius, forward, inverse


def _meridian(latitude: float, flattening: float) -> float:
    """Rectifying arc of a latitude in units of the semi-major axis, on the central meridian."""
    _, radius, forward, _ = _series(flattening)
    e, s = sqrt(flattening * (2 - flattening)), sin(radians(latitude))
    xi = atan(sinh(atanh(s) - e * atanh(e * s)))
    return radius * (xi + sum(a * sin(2 * j * xi) for j, a in enumerate(forward, 1)))


def tm_forward(longitude: Column, latitude: Column, epsg: int = 32629) -> tuple[Column, Column]:
    """(easting, northing) in metres of a longitude and a latitude in degrees."""
    meridian, origin, scale, east, north, a, f = PROJECTIONS[epsg]
    _, radius, forward, _ = _series(f)
    e = sqrt(f * (2 - f))
    s, lam = F.sin(F.radians(latitude)), F.radians(longitude - meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(forward, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + scale * a * radius * x, north + scale * a * (radius * y - _meridian(origin, f))


def tm_inverse(easting: Column, northing: Column, epsg: int = 32629) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of an easting and a northing in metres."""
    meridian, origin, scale, east, north, a, f = PROJECTIONS[epsg]
    _, radius, _, inverse = _series(f)
    e = sqrt(f * (2 - f))
    xi = ((northing - north) / (scale * a) + _meridian(origin, f)) / radius
    eta = (easting - east) / (scale * a * radius)
    x, y = xi, eta
    for j, c in enumerate(inverse, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.sin(x) / F.cosh(y)  # sine of the conformal latitude
    psi = F.atanh(conformal)
    s = conformal
    for _ in range(6):  # the isometric latitude is that of the conformal one; solve for the geodetic one
        s = F.tanh(psi + e * F.atanh(e * s))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + meridian, F.degrees(F.asin(s))
