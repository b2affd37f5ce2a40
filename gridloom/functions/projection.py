"""Map projections as column expressions: geographic, UTM zone 33 and the European equal-area grid.

Datums are taken as one, as their ellipsoids differ by less than a tenth of a millimetre.
Nothing leaves the JVM, and constants are worked out once, when an expression is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import geometry as G

# The ellipsoid, and of UTM zone 33 the central meridian, scale and false easting.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN_33, SCALE, EASTING = 15.0, 0.9996, 500_000.0
#: Of the equal-area grid the centre and false origin.
CENTRE_LON, CENTRE_LAT, ORIGIN_X, ORIGIN_Y = 10.0, 52.0, 4_321_000.0, 3_210_000.0
#: Codes of the systems: geographic degrees, UTM 33 on both datums, and the equal-area grid.
GEOGRAPHIC, UTM_33, EUROPE = (4326, 4258), (32633, 25833), (3035,)

N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Radius of the circle as long as a meridian, and the coefficients of the transverse series to the fourth power of N.
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACKWARD = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def to_utm33(lon: Column, lat: Column) -> Column:
    """Easting and northing of degrees, as a point; within 30 degrees of the meridian of 15 E."""
    t = G.let(F.sin(F.radians(lat)), lambda sine: F.sinh(F.atanh(sine) - F.atanh(sine * ECCENTRICITY) * ECCENTRICITY))
    dl = F.radians(lon - MERIDIAN_33)

    def project(p: Column) -> Column:
        along, across = p["a"], p["b"]
        x = across + _sum([F.cos(along * 2 * j) * F.sinh(across * 2 * j) * c for j, c in enumerate(FORWARD, 1)])
        y = along + _sum([F.sin(along * 2 * j) * F.cosh(across * 2 * j) * c for j, c in enumerate(FORWARD, 1)])
        return G.point(x * (SCALE * RADIUS) + EASTING, y * (SCALE * RADIUS))

    return G.let(G.let(t, lambda t: F.struct(F.atan2(t, F.cos(dl)).alias("a"), F.atanh(F.sin(dl) / F.sqrt(t * t + 1)).alias("b"))), project)


def from_utm33(x: Column, y: Column) -> Column:
    """Degrees of an easting and northing, as a point of longitude and latitude."""

    def sphere(p: Column) -> Column:
        along = p["a"] - _sum([F.sin(p["a"] * 2 * j) * F.cosh(p["b"] * 2 * j) * c for j, c in enumerate(BACKWARD, 1)])
        across = p["b"] - _sum([F.cos(p["a"] * 2 * j) * F.sinh(p["b"] * 2 * j) * c for j, c in enumerate(BACKWARD, 1)])
        return F.struct(along.alias("a"), across.alias("b"))

    def degrees(p: Column) -> Column:
        chi = F.asin(F.sin(p["a"]) / F.cosh(p["b"]))
        lat = G.let(chi, lambda c: c + _sum([F.sin(c * 2 * j) * d for j, d in enumerate(LATITUDE, 1)]))
        return G.point(F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"]))) + MERIDIAN_33, F.degrees(lat))

    start = F.struct((y / (SCALE * RADIUS)).alias("a"), ((x - EASTING) / (SCALE * RADIUS)).alias("b"))
    return G.let(G.let(start, sphere), degrees)


def _q(sine: float) -> float:
    e = ECCENTRICITY
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) + math.atanh(e * sine) / e)


def from_laea_europe(x: Column, y: Column) -> Column:
    """Degrees of equal-area coordinates, as a point of longitude and latitude."""
    e, e2 = ECCENTRICITY, ECCENTRICITY**2
    phi0, whole = math.radians(CENTRE_LAT), _q(1.0)
    beta0, radius = math.asin(_q(math.sin(phi0)) / whole), AXIS * math.sqrt(whole / 2)
    d = AXIS * math.cos(phi0) / (math.sqrt(1 - e2 * math.sin(phi0) ** 2) * radius * math.cos(beta0))
    east, north = (x - ORIGIN_X) / d, (y - ORIGIN_Y) * d

    def angle(p: Column) -> Column:
        c = F.asin(F.least(F.hypot(p["east"], p["north"]) / (2 * radius), F.lit(1.0))) * 2
        return G.let(c, lambda c: F.struct(p["east"].alias("east"), p["north"].alias("north"), F.hypot(p["east"], p["north"]).alias("rho"), F.sin(c).alias("sin"), F.cos(c).alias("cos")))

    def sphere(p: Column) -> Column:
        sine = p["cos"] * math.sin(beta0) + F.coalesce(F.try_divide(p["north"] * p["sin"] * math.cos(beta0), p["rho"]), F.lit(0.0))
        lon = F.atan2(p["east"] * p["sin"], p["rho"] * p["cos"] * math.cos(beta0) - p["north"] * p["sin"] * math.sin(beta0))
        return F.struct(lon.alias("lon"), sine.alias("sine"))

    def degrees(p: Column) -> Column:
        lat = F.asin(F.greatest(F.least(p["sine"], F.lit(1.0)), F.lit(-1.0)))
        for _ in range(4):  # from the latitude of equal areas to that of the ellipsoid, by Newton's steps
            lat = G.let(lat, lambda v: v + _step(v, p["sine"] * whole))
        return G.point(F.degrees(p["lon"]) + CENTRE_LON, F.degrees(lat))

    def _step(lat: Column, q: Column) -> Column:
        inner = lambda s: q / (1 - e2) - s / (1 - s * s * e2) - F.atanh(s * e) / e
        return G.let(F.sin(lat), lambda s: F.pow(1 - s * s * e2, F.lit(2.0)) / (F.cos(lat) * 2) * inner(s))

    plane = F.struct(east.alias("east"), north.alias("north"))
    return G.let(G.let(G.let(plane, angle), sphere), degrees)


def reproject(p: Column, source: int, target: int) -> Column:
    """A point from one system to another, by their codes; geographic points are longitude and latitude."""
    for code in (source, target):
        if code not in (*GEOGRAPHIC, *UTM_33, *EUROPE):
            raise ValueError(f"no system with code {code}")
    if source == target:
        return p
    back = lambda p: from_utm33(p["x"], p["y"]) if source in UTM_33 else from_laea_europe(p["x"], p["y"])
    known = p if source in GEOGRAPHIC else G.let(p, back)  # a point that is computed is computed once
    if target in GEOGRAPHIC:
        return known
    return G.let(known, lambda g: to_utm33(g["x"], g["y"]) if target in UTM_33 else G.laea_europe(g["x"], g["y"]))


def reproject_line(line: Column, source: int, target: int) -> Column:
    """All points of a line or ring from one system to another."""
    return F.transform(line, lambda p: reproject(p, source, target))
