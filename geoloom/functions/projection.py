"""Map projections as plain column expressions (Krueger series of order six, 0.1 mm or better)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids as (major axis, inverse flattening).
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)


@dataclass(frozen=True)
class TransverseMercator:
    lat0: float
    lon0: float
    scale: float
    east: float
    north: float
    ellipsoid: tuple[float, float] = GRS80


# Parameters of the projected systems in the EPSG registry.
SYSTEMS = {
    5179: TransverseMercator(38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0),
    5181: TransverseMercator(38.0, 127.0, 1.0, 200_000.0, 500_000.0),
    5185: TransverseMercator(38.0, 125.0, 1.0, 200_000.0, 600_000.0),
    5186: TransverseMercator(38.0, 127.0, 1.0, 200_000.0, 600_000.0),
    5187: TransverseMercator(38.0, 129.0, 1.0, 200_000.0, 600_000.0),
    5188: TransverseMercator(38.0, 131.0, 1.0, 200_000.0, 600_000.0),
}
#: Longitude and latitude in degrees, without a datum shift between them.
GEOGRAPHIC = (4326, 4737, 4258, 6318)
WEB_MERCATOR = 3857
REFERENCE = 5179


def _system(epsg: int) -> TransverseMercator:
    if epsg in SYSTEMS:
        return SYSTEMS[epsg]
    hemisphere, zone = divmod(epsg - 32600, 100)
    if hemisphere in (0, 1) and 1 <= zone <= 60:
        return TransverseMercator(0.0, 6.0 * zone - 183.0, 0.9996, 500_000.0, hemisphere * 10_000_000.0, WGS84)
    raise ValueError(f"EPSG:{epsg} is not supported")


def _series(ellipsoid: tuple[float, float]) -> tuple[float, float, list[float], list[float]]:
    """Rectifying radius, eccentricity, and the coefficients forward and back."""
    a, inverse = ellipsoid
    f = 1 / inverse
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, math.sqrt(f * (2 - f)), alpha, beta


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _conformal(lat: float, e: float) -> float:
    s = math.sin(lat)
    return math.sinh(math.atanh(s) - e * math.atanh(e * s))


def _origin(tm: TransverseMercator) -> float:
    """Rectified distance of the origin's parallel."""
    radius, e, alpha, _ = _series(tm.ellipsoid)
    xi = math.atan(_conformal(math.radians(tm.lat0), e))
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing of degrees of longitude and latitude."""
    if epsg in GEOGRAPHIC:
        return lon, lat
    if epsg == WEB_MERCATOR:
        r = WGS84[0]
        return F.radians(lon) * r, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * r
    tm = _system(epsg)
    radius, e, alpha, _ = _series(tm.ellipsoid)
    phi, lam = F.radians(lat), F.radians(lon - tm.lon0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north = xi + _sum([F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a for j, a in enumerate(alpha, 1)])
    east = eta + _sum([F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a for j, a in enumerate(alpha, 1)])
    return east * (radius * tm.scale) + tm.east, north * (radius * tm.scale) + (tm.north - tm.scale * _origin(tm))


def unproject(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of an easting and northing."""
    if epsg in GEOGRAPHIC:
        return x, y
    if epsg == WEB_MERCATOR:
        r = WGS84[0]
        return F.degrees(x / r), F.degrees(F.atan(F.exp(y / r)) * 2 - math.pi / 2)
    tm = _system(epsg)
    radius, e, _, beta = _series(tm.ellipsoid)
    xi = (y - (tm.north - tm.scale * _origin(tm))) / (radius * tm.scale)
    eta = (x - tm.east) / (radius * tm.scale)
    xi0 = xi - _sum([F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b for j, b in enumerate(beta, 1)])
    eta0 = eta - _sum([F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b for j, b in enumerate(beta, 1)])
    lon = F.atan2(F.sinh(eta0), F.cos(xi0))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    # The conformal latitude is turned back by Newton's iteration on the isometric latitude.
    q = F.atanh(F.sin(chi))
    s = F.sin(chi)
    for _ in range(5):
        s = F.tanh(q + F.atanh(s * e) * e)
    return F.degrees(lon) + tm.lon0, F.degrees(F.asin(s))


def to_reference(x: Column, y: Column, epsg: int, target: int = REFERENCE) -> tuple[Column, Column]:
    """Coordinates in ``target`` of coordinates in ``epsg``; always in order x, y."""
    if epsg == target:
        return x, y
    lon, lat = unproject(x, y, epsg)
    return project(lon, lat, target)
