"""Transverse Mercator by Krueger's series to the sixth order (Karney, 2011), and spherical Mercator, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80, zone 30 N.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
SCALE, EASTING, MERIDIAN = 0.9996, 500000.0, math.radians(-3.0)
SPHERE = 6378137.0

_n = FLATTENING / (2 - FLATTENING)
_e = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Coefficients of the series, by power of n.
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
)


def to_projected(lon: Column, lat: Column) -> Column:
    """Degrees to easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon) - MERIDIAN
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_e) * F.atanh(F.lit(_e) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((F.lit(EASTING) + SCALE * _A * x).alias("x"), (F.lit(SCALE * _A) * y).alias("y"))


def to_degrees(x: Column, y: Column) -> Column:
    """Easting and northing to degrees; the latitude by Newton's method, four steps."""
    xi, eta = y / (SCALE * _A), (x - EASTING) / (SCALE * _A)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    lam = F.atan2(F.sinh(v), F.cos(u))
    tau0 = F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u))

    def newton(tau: Column) -> Column:
        sigma = F.sinh(F.lit(_e) * F.atanh(F.lit(_e) * tau / F.sqrt(1 + tau * tau)))
        own = tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)
        return tau + (tau0 - own) / F.sqrt(1 + own * own) * (1 + (1 - _e**2) * tau * tau) / ((1 - _e**2) * F.sqrt(1 + tau * tau))

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(4)), tau0, lambda acc, _: newton(acc))
    return F.struct(F.degrees(lam + MERIDIAN).alias("lon"), F.degrees(F.atan(tau)).alias("lat"))


def to_mercator(lon: Column, lat: Column) -> Column:
    """Degrees to spherical Mercator metres."""
    return F.struct((SPHERE * F.radians(lon)).alias("x"), (SPHERE * F.atanh(F.sin(F.radians(lat)))).alias("y"))
