"""Planar geometry as column expressions.

A point is struct<x:double, y:double>; a line is an array of points; a polygon is a
closed or open ring of points.  Everything is built from higher-order functions, so
no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    """A point."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Distance of two points."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def segments(line: Column) -> Column:
    """The pairs of neighbouring points of a line."""

    def pairs(line: Column) -> Column:
        n = F.size(line)
        ends = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.when(n > 1, ends).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))

    return let(line, pairs)


def closed(ring: Column) -> Column:
    """A ring whose last point is its first."""

    def close(ring: Column) -> Column:
        ends = [(F.element_at(ring, 1)[c], F.element_at(ring, -1)[c]) for c in ("x", "y")]
        return F.when((ends[0][0] == ends[0][1]) & (ends[1][0] == ends[1][1]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))

    return let(ring, close)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def length(line: Column) -> Column:
    """The length of a line."""
    return _sum(F.transform(segments(line), lambda s: distance(s["a"], s["b"])))


def area(ring: Column) -> Column:
    """The area of a simple ring."""
    return F.abs(_sum(F.transform(segments(closed(ring)), _cross))) / 2


def centroid(ring: Column) -> Column:
    """The centre of gravity of a simple ring; the mean of its points where it has no area."""
    mean = lambda axis: _sum(F.transform(ring, lambda p: p[axis])) / F.size(ring)

    def middle(parts: Column) -> Column:
        twice = _sum(F.transform(parts, _cross))
        gravity = lambda axis: _sum(F.transform(parts, lambda s: (s["a"][axis] + s["b"][axis]) * _cross(s))) / (3 * twice)
        return F.when(twice != 0, point(gravity("x"), gravity("y"))).otherwise(point(mean("x"), mean("y")))

    return let(segments(closed(ring)), middle)


def contains(ring: Column, p: Column) -> Column:
    """Whether a point lies inside a ring, by the parity of the edges to its right; of the boundary, the left and lower sides count."""
    crossed = F.filter(
        segments(closed(ring)),
        lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"]))
        & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * F.try_divide(p["y"] - s["a"]["y"], s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def foot_fraction(a: Column, b: Column, p: Column) -> Column:
    """Where on the segment from a to b the point nearest to p lies, from 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    at = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))


def between(a: Column, b: Column, at: Column) -> Column:
    """The point at a fraction of the way from a to b."""
    return point(a["x"] + (b["x"] - a["x"]) * at, a["y"] + (b["y"] - a["y"]) * at)


def _feet(line: Column, p: Column) -> Column:
    """Of each segment its distance to p, how far along the line its nearest point is, and that point."""

    def foot(s: Column) -> Column:
        return let(
            foot_fraction(s["a"], s["b"], p),
            lambda at: F.struct(distance(between(s["a"], s["b"], at), p).alias("distance"), (s["d"] + at * s["l"]).alias("along"), between(s["a"], s["b"], at).alias("foot")),
        )

    return F.transform(measured(line), foot)


def distance_to_line(line: Column, p: Column) -> Column:
    """The distance of a point to a line."""
    return F.array_min(_feet(line, p))["distance"]


def locate(line: Column, p: Column) -> Column:
    """The fraction of a line's length at which it is nearest to a point."""
    return F.coalesce(F.try_divide(F.array_min(_feet(line, p))["along"], length(line)), F.lit(0.0))


def nearest_on_line(line: Column, p: Column) -> Column:
    """The point of a line nearest to a point."""
    return F.array_min(_feet(line, p))["foot"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def measured(line: Column) -> Column:
    """The segments of a line, each with the length before it: an array of (a, b, d, l)."""
    ends = F.transform(segments(line), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), distance(s["a"], s["b"]).alias("l")))
    kind = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,d:double,l:double>>"
    add = lambda done, s: F.concat(done, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), F.coalesce(F.try_element_at(done, F.lit(-1))["d"] + F.try_element_at(done, F.lit(-1))["l"], F.lit(0.0)).alias("d"), s["l"].alias("l"))))
    return F.aggregate(ends, F.array().cast(kind), add)


def _end(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(-1))["d"] + F.try_element_at(parts, F.lit(-1))["l"], F.lit(0.0))


def _at(parts: Column, target: Column) -> Column:
    """The point at a distance along measured segments."""
    first = F.coalesce(F.try_element_at(F.filter(parts, lambda e: target <= e["d"] + e["l"]), F.lit(1)), F.element_at(parts, -1))
    return let(first, lambda s: between(s["a"], s["b"], F.least(F.coalesce(F.try_divide(target - s["d"], s["l"]), F.lit(0.0)), F.lit(1.0))))


def interpolate(line: Column, at: Column) -> Column:
    """The point at a fraction of a line's length."""
    return let(measured(line), lambda parts: _at(parts, _end(parts) * at))


def substring(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two fractions of its length."""

    def cut(parts: Column) -> Column:
        low, high = _end(parts) * start, _end(parts) * end
        inner = F.transform(F.filter(parts, lambda e: (e["d"] > low) & (e["d"] < high)), lambda e: e["a"])
        return F.concat(F.array(_at(parts, low)), inner, F.array(_at(parts, high)))

    return let(measured(line), cut)


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d meet in a point that is inside both."""
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def crossing_fraction(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where on a-b the line through c and d meets it; null for parallels."""
    den = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
    return F.try_divide((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"]), den)


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a line has a point inside a ring or crosses its boundary."""
    inside = F.exists(line, lambda p: contains(ring, p))
    crossing = F.exists(segments(line), lambda s: F.exists(segments(closed(ring)), lambda e: segments_cross(s["a"], s["b"], e["a"], e["b"])))
    return inside | crossing


def wkt_line(line: Column) -> Column:
    """A line as well-known text."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def wkt_polygon(ring: Column) -> Column:
    """A ring as well-known text of a polygon, closed."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def _double_hex(x: Column) -> Column:
    """The 16 hexadecimal digits of a finite double, most significant first; minus zero is written as zero.

    The exponent by logarithm may be one off, which comparing with powers of two mends;
    all further steps are exact.  Values below 2^-1022 are written as zero.
    """
    power = lambda e: F.pow(F.lit(2.0), e)

    def digits(a: Column) -> Column:
        guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022)).cast("double")
        exponent = guess - (power(guess) > a).cast("double") + (power(guess + 1) <= a).cast("double")
        fraction = lambda e: ((a / power(e) - 1) * float(1 << 52)).cast("long")
        bits = let(exponent, lambda e: F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(fraction(e)))
        signed = F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
        return F.lpad(F.hex(signed), 16, "0")

    return F.when(F.abs(x) >= 2.0**-1022, let(F.abs(x), digits)).otherwise(F.lit("0" * 16))


def _points_hex(points: Column) -> Column:
    each = F.transform(points, lambda p: F.concat(_double_hex(p["x"]), _double_hex(p["y"])))
    return F.concat(F.lpad(F.hex(F.size(points)), 8, "0"), F.array_join(each, ""))


def wkb_line(line: Column) -> Column:
    """A line as well-known binary, big-endian; null if a coordinate is null or not finite."""
    return F.when(_finite(line), F.unhex(F.concat(F.lit("0000000002"), _points_hex(line))))


def wkb_polygon(ring: Column) -> Column:
    """A ring as well-known binary of a polygon, closed, big-endian; null without points, or if a coordinate is null or not finite."""
    return F.when(_finite(ring) & (F.size(ring) > 0), F.unhex(F.concat(F.lit("0000000003" + "00000001"), _points_hex(closed(ring)))))


def _finite(points: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return ~F.exists(points, lambda p: bad(p["x"]) | bad(p["y"]))


def from_wkt(text: Column) -> Column:
    """The points of a line, or of the only ring of a polygon, in well-known text."""
    inside = F.regexp_extract(text, r"\(+([^()]*)\)+", 1)
    return F.transform(F.split(inside, r"\s*,\s*"), lambda p: point(F.split(F.trim(p), r"\s+")[0], F.split(F.trim(p), r"\s+")[1]))


def laea_europe(lon: Column, lat: Column) -> Column:
    """Lambert azimuthal equal-area coordinates around 10 E, 52 N on the GRS80 ellipsoid, in metres."""
    a, e2 = 6378137.0, 0.00669438002290
    e = e2**0.5
    import math

    def q_of(sin_phi: float) -> float:
        return (1 - e2) * (sin_phi / (1 - e2 * sin_phi**2) - math.log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e))

    phi0 = math.radians(52.0)
    qp, q0 = q_of(1.0), q_of(math.sin(phi0))
    beta0, rq = math.asin(q0 / qp), a * (qp / 2) ** 0.5
    d = a * math.cos(phi0) / (math.sqrt(1 - e2 * math.sin(phi0) ** 2) * rq * math.cos(beta0))
    q = lambda s: (s / (1 - F.lit(e2) * s * s) - F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)) / (2 * e)) * (1 - e2)
    dl = F.radians(lon) - math.radians(10.0)

    def project(v: Column) -> Column:
        b = F.sqrt(2.0 / (1 + math.sin(beta0) * v["sin"] + math.cos(beta0) * v["cos"] * F.cos(v["dl"]))) * rq
        across = d * v["cos"] * F.sin(v["dl"])
        along = math.cos(beta0) * v["sin"] - math.sin(beta0) * v["cos"] * F.cos(v["dl"])
        return let(b, lambda b: point(F.lit(4321000.0) + b * across, F.lit(3210000.0) + b / d * along))

    parts = lambda beta: F.struct(F.sin(beta).alias("sin"), F.cos(beta).alias("cos"), dl.alias("dl"))
    return let(let(let(F.sin(F.radians(lat)), lambda s: F.asin(q(s) / qp)), parts), project)
