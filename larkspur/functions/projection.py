"""From the plane of the oblique conformal conic projection of Czechia and Slovakia to latitude and longitude, as column expressions.

The plane has x to the south and y to the west, both positive; files that give east and north have both signs turned.  The way back to
the Bessel ellipsoid is exact but for the latitude, whose equation is solved by ``ROUNDS`` steps (each leaves under a thousandth of the
error); then the geocentric position is turned, scaled and moved to WGS 84.  Means of points are taken in the plane, before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis and flattening of the two ellipsoids.
BESSEL = (6377397.155, 1 / 299.1528128)
WGS84 = (6378137.0, 1 / 298.257223563)
# Fixed values of the projection: latitude of the centre and longitude from Greenwich, co-latitude of the cone's axis,
# latitude of the pseudo standard parallel (degrees), and the scale on it.
CENTRE, MERIDIAN, AXIS, PARALLEL, SCALE = 49.5, 24 + 50 / 60, 30 + 17 / 60 + 17.30311 / 3600, 78.5, 0.9999
# Fixed values of the shift to WGS 84 (position vector): metres, seconds of arc, parts in a million.
SHIFT = (572.213, 85.334, 461.94, 4.9732, 1.529, 5.2484, 3.5378)
ROUNDS = 5


def _square(flattening: float) -> float:
    """Square of the first eccentricity."""
    return flattening * (2 - flattening)


E = math.sqrt(_square(BESSEL[1]))
_SIN = math.sin(math.radians(CENTRE))
#: Of the map from the ellipsoid to the sphere, and from the sphere to the cone.
B = math.sqrt(1 + E**2 * (1 - _SIN**2) ** 2 / (1 - E**2))
_SPHERE = math.asin(_SIN / B)
T0 = math.tan(math.pi / 4 + _SPHERE / 2) * math.exp(E * B * math.atanh(E * _SIN)) / math.tan(math.pi / 4 + math.radians(CENTRE) / 2) ** B
N = math.sin(math.radians(PARALLEL))
R0 = SCALE * BESSEL[0] * math.sqrt(1 - E**2) / (1 - E**2 * _SIN**2) / math.tan(math.radians(PARALLEL))
CONE = math.tan(math.pi / 4 + math.radians(PARALLEL) / 2)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def bessel(y: Column, x: Column) -> Column:
    """lat and lon in radians on the Bessel ellipsoid, of westing y and southing x."""

    def on_sphere(p: Column) -> Column:
        u = F.asin(math.cos(math.radians(AXIS)) * F.sin(p["t"]) - math.sin(math.radians(AXIS)) * F.cos(p["t"]) * F.cos(p["d"]))
        return _let(F.struct(u.alias("u"), p["t"].alias("t"), p["d"].alias("d")), on_ellipsoid)

    def on_ellipsoid(p: Column) -> Column:
        k = F.pow(F.tan(p["u"] / 2 + math.pi / 4), 1 / B) * T0 ** (-1 / B)
        lat = p["u"]
        for _ in range(ROUNDS):
            lat = 2 * F.atan(k * F.exp(E * F.atanh(E * F.sin(lat)))) - math.pi / 2
        lon = math.radians(MERIDIAN) - F.asin(F.cos(p["t"]) * F.sin(p["d"]) / F.cos(p["u"])) / B
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    t = 2 * F.atan(F.pow(R0 / F.sqrt(x * x + y * y), 1 / N) * CONE) - math.pi / 2
    return _let(F.struct(t.alias("t"), (F.atan2(y, x) / N).alias("d")), on_sphere)


def wgs84(y: Column, x: Column) -> Column:
    """lat and lon in degrees on WGS 84, of westing y and southing x (both positive); null if either is."""
    a, e2 = BESSEL[0], E**2
    dx, dy, dz, rx, ry, rz, ppm = SHIFT
    rx, ry, rz, scale = (*(math.radians(s / 3600) for s in (rx, ry, rz)), 1 + ppm * 1e-6)

    def geocentric(p: Column) -> Column:
        n = a / F.sqrt(1 - e2 * F.sin(p["lat"]) * F.sin(p["lat"]))
        flat = n * F.cos(p["lat"])
        return _let(F.struct((flat * F.cos(p["lon"])).alias("x"), (flat * F.sin(p["lon"])).alias("y"), (n * (1 - e2) * F.sin(p["lat"])).alias("z")), moved)

    def moved(p: Column) -> Column:
        q = F.struct((dx + scale * (p["x"] - rz * p["y"] + ry * p["z"])).alias("x"), (dy + scale * (rz * p["x"] + p["y"] - rx * p["z"])).alias("y"), (dz + scale * (-ry * p["x"] + rx * p["y"] + p["z"])).alias("z"))
        return _let(q, geodetic)

    def geodetic(p: Column) -> Column:
        a, e2 = WGS84[0], _square(WGS84[1])
        b = a * (1 - WGS84[1])
        out = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        found = lambda s: F.atan2(p["z"] + e2 / (1 - e2) * b * F.pow(F.sin(s), 3), out - e2 * a * F.pow(F.cos(s), 3))
        return F.struct(F.degrees(_let(F.atan2(p["z"] * a, out * b), found)).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))

    return F.when(y.isNotNull() & x.isNotNull(), _let(bessel(y, x), geocentric))
