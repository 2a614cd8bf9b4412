"""Longitude, distance and shape of the Earth as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import NAN, col
from .constants import WGS84_A, WGS84_B


def lon_to_180(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    m = (col(lon).cast("double") + 180.0) % 360.0
    return F.when(m < 0, m + 360.0).otherwise(m) - 180.0


def lon_grid(lon: Column | str) -> Column:
    """Longitude of a grid cell: 360 less where it is above 180."""
    x = col(lon).cast("double")
    return F.when(x > 180, x - 360.0).otherwise(x)


def lon_query(lon: Column | str) -> Column:
    """Longitude of a pixel: turned back once if it is outside [-180, 180]."""
    x = lon_grid(lon)
    return F.when(x < -180, x + 360.0).otherwise(x)


def earth_radius(lat: Column | str) -> Column:
    """Distance in metres from the centre of the WGS84 ellipsoid to its surface, for geodetic latitude in degrees."""
    e2 = 1 - WGS84_B**2 / WGS84_A**2
    geocentric = F.atan((1 - e2) * F.tan(F.radians(col(lat))))
    return WGS84_A * (1 - e2) ** 0.5 / F.sqrt(1 - e2 * F.pow(F.cos(geocentric), F.lit(2.0)))


def great_circle(lat1, lat2, lon1, lon2) -> Column:
    """Central angle in radians of points in degrees, by the law of cosines. Note the order of the arguments."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.when(F.isnan(c), NAN).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Central angle in degrees of points in degrees. Note the order of the arguments."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = F.sin((b - a) / 2), F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon
    return F.when(F.isnan(h), NAN).otherwise(F.degrees(2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))))


def orthographic_inverse(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point of the unit-sphere orthographic projection; NaN off the globe."""
    x, y, p = col(x), col(y), F.radians(F.lit(lat0))
    r = F.sqrt(x * x + y * y)
    c = F.asin(F.least(r, F.lit(1.0)))
    at_centre = r == 0
    lat = F.degrees(F.asin(F.cos(c) * F.sin(p) + F.when(at_centre, 0.0).otherwise(y * F.sin(c) * F.cos(p) / F.when(r > 0, r))))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), r * F.cos(p) * F.cos(c) - y * F.sin(p) * F.sin(c)))
    out = lambda v, centre: F.when(r > 1, NAN).when(at_centre, centre).otherwise(v)
    return out(lon, lon0), out(lat, lat0)


#: The Robinson projection's parallels, every five degrees from the equator: relative length, and relative distance from it. Fixed values.
ROBINSON_LENGTH = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_DISTANCE = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)


def robinson_inverse(x, y, lon0: float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point of the unit-sphere Robinson projection, linear between parallels; NaN off the map."""
    away, x = F.abs(col(y)) / 1.3523, col(x)
    lengths, distances = (F.array(*map(F.lit, t)) for t in (ROBINSON_LENGTH, ROBINSON_DISTANCE))
    k = F.least(F.size(F.filter(distances, lambda d: d <= away)), F.lit(18))
    a, b = F.get(distances, k - 1), F.get(distances, k)
    part = (away - a) / (b - a)
    length = F.get(lengths, k - 1) + part * (F.get(lengths, k) - F.get(lengths, k - 1))
    turn = F.degrees(x / (0.8487 * length))
    off = (away > 1) | (F.abs(turn) > 180) | F.isnan(turn)
    return F.when(off, NAN).otherwise(lon0 + turn), F.when(off, NAN).otherwise(F.signum(col(y)) * 5.0 * (k - 1 + part))
