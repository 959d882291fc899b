"""WGS84 transverse Mercator (UTM) as column expressions: a sixth-order Krüger series, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the UTM grid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, NORTHING = 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_E = (FLATTENING * (2 - FLATTENING)) ** 0.5
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Coefficients of Krüger's series in the third flattening, lowest power first.
_ALPHA = [(1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,)]
_BETA = [(1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,)]


def _series(rows: list[tuple[float, ...]]) -> list[float]:
    return [sum(c * _N ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(rows, 1)]


ALPHA, BETA = _series(_ALPHA), _series(_BETA)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def epsg(lon: Column, lat: Column) -> Column:
    """EPSG number of the UTM zone, north or south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _central(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of a zone; southern latitudes get the false northing."""
    phi, lam = F.radians(lat), F.radians(lon) - _central(zone)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * x, SCALE * _RADIUS * y + F.when(lat < 0, NORTHING).otherwise(0.0)


def from_utm(x: Column, y: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    base = F.lit(0.0) if south is None else F.when(south, NORTHING).otherwise(0.0)
    xi, eta = (y - base) / (SCALE * _RADIUS), (x - EASTING) / (SCALE * _RADIUS)
    xi0, eta0 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lam = F.atan2(F.sinh(eta0), F.cos(xi0)) + _central(zone)
    # latitude from the conformal one by fixed-point steps; each gains a factor of e2
    psi = F.atanh(F.sin(chi))
    sin_phi = F.sin(chi)
    for _ in range(5):
        sin_phi = F.tanh(psi + _E * F.atanh(_E * sin_phi))
    return F.degrees(lam), F.degrees(F.asin(sin_phi))
