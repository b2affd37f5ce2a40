"""Queries of unions, buffers, networks around areas, and projections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import projection as P
from gridloom.operators import overlay as O
from gridloom.plans.base import SITES_SQL, query, sites, table


def _box(x, y, w, h):
    return F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))


@query("""
    WITH r AS (SELECT c_nationkey AS nation, (c_custkey * 7919) % 500 AS x, (c_custkey * 104729) % 500 AS y, (c_custkey * 7919) % 500 + 10 + (c_custkey * 31) % 60 AS x2, (c_custkey * 104729) % 500 + 10 + (c_custkey * 17) % 60 AS y2 FROM customer),
    xi AS (SELECT nation, v AS x0, lead(v) OVER (PARTITION BY nation ORDER BY v) AS x1 FROM (SELECT nation, x AS v FROM r UNION SELECT nation, x2 FROM r) d),
    yi AS (SELECT nation, v AS y0, lead(v) OVER (PARTITION BY nation ORDER BY v) AS y1 FROM (SELECT nation, y AS v FROM r UNION SELECT nation, y2 FROM r) d),
    c AS (SELECT xi.nation, x0, x1, y0, y1, EXISTS (SELECT 1 FROM r WHERE r.nation = xi.nation AND r.x <= x0 AND r.x2 >= x1 AND r.y <= y0 AND r.y2 >= y1) AS i FROM xi JOIN yi USING (nation) WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
    n AS (SELECT *, coalesce(lag(i) OVER h, false) AS w, coalesce(lead(i) OVER h, false) AS e, coalesce(lag(i) OVER v, false) AS s, coalesce(lead(i) OVER v, false) AS n FROM c WINDOW h AS (PARTITION BY nation, y0 ORDER BY x0), v AS (PARTITION BY nation, x0 ORDER BY y0))
    SELECT nation, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area,
           CAST(sum(CASE WHEN w THEN 0 ELSE y1 - y0 END + CASE WHEN e THEN 0 ELSE y1 - y0 END + CASE WHEN s THEN 0 ELSE x1 - x0 END + CASE WHEN n THEN 0 ELSE x1 - x0 END) AS DOUBLE) AS length FROM n WHERE i GROUP BY 1
""")
def q79_dissolved_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and border of the union of each nation's boxes."""
    k = F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), _box(k * 7919 % 500, k * 104729 % 500, 10 + k * 31 % 60, 10 + k * 17 % 60).alias("ring"))
    out = O.measures(O.border(boxes, "nation"), "nation")
    return out.select("nation", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


_SIDES, _RADIUS = 16, 3.0
_DISC = _SIDES / 2 * _RADIUS**2 * math.sin(2 * math.pi / _SIDES)


@query(f"SELECT c_custkey AS line, round({2 * _RADIUS} * (20 + c_custkey % 50) + {_DISC!r}, 3) AS area FROM customer")
def q80_buffered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area around a line of two parts for every customer."""
    k = F.col("c_custkey")
    x, y, end = k * 7919 % 10007, k * 104729 % 10009, k % 50 + 20
    lines = table(spark, sf_dir, "customer").select(k.alias("line"), F.array(G.point(x, y), G.point(x + 10, y), G.point(x + end, y)).alias("points"))
    out = O.measures(O.buffered(lines, "line", "points", _RADIUS, _SIDES, 40.0), "line")
    return out.select("line", F.round("area", 3).alias("area"))


@query("""
    SELECT CAST(n_nationkey AS INTEGER) AS street, CAST(r_regionkey AS INTEGER) AS area FROM nation, region WHERE greatest(40 * r_regionkey - (10 * n_nationkey + 5), 10 * n_nationkey + 5 - (40 * r_regionkey + 12), 0) <= 6
""")
def q81_streets_around_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets that come within 6 of an area."""
    at, corner = (F.col("n_nationkey") * 10 + 5).cast("double"), F.col("r_regionkey") * 40
    streets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("street"), F.array(G.point(at, F.lit(0.0)), G.point(at, F.lit(100.0))).alias("line"))
    areas = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("area"), _box(corner, F.lit(20), F.lit(12), F.lit(12)).alias("ring"))
    return O.lines_near_polygons(streets, "line", areas, "ring", 6.0, ("street", "area"), 50.0)


_SERIES = lambda f, g: " + ".join(f"{c!r} * {f}({2 * j} * a) * {g}({2 * j} * b)" for j, c in enumerate(P.FORWARD, 1))


@query(f"""
    WITH g AS (SELECT site, radians(10 + x / 1000.0 - {P.MERIDIAN_33}) AS dl, sin(radians(46 + y / 1000.0)) AS s FROM ({SITES_SQL}) s),
    t AS (SELECT site, dl, sinh(atanh(s) - {P.ECCENTRICITY!r} * atanh({P.ECCENTRICITY!r} * s)) AS t FROM g),
    p AS (SELECT site, atan2(t, cos(dl)) AS a, atanh(sin(dl) / sqrt(t * t + 1)) AS b FROM t)
    SELECT site, round({P.EASTING} + {P.SCALE * P.RADIUS!r} * (b + {_SERIES("cos", "sinh")}), 3) AS easting, round({P.SCALE * P.RADIUS!r} * (a + {_SERIES("sin", "cosh")}), 3) AS northing, true AS back FROM p
""")
def q82_reprojected_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from degrees to UTM 33, and whether the way over the equal-area grid leads back within a millimetre."""
    rows = sites(spark, sf_dir).select("site", G.point(F.col("x") / 1000 + 10, F.col("y") / 1000 + 46).alias("g"))
    rows = rows.withColumn("u", P.reproject(F.col("g"), 4326, 32633))
    rows = rows.withColumn("r", P.reproject(P.reproject(F.col("u"), 32633, 3035), 3035, 32633))
    return rows.select("site", F.round("u.x", 3).alias("easting"), F.round("u.y", 3).alias("northing"), (G.distance(F.col("u"), F.col("r")) < 0.001).alias("back"))
