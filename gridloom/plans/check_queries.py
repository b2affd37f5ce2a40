"""Queries that check graph, geometry and table operators on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import graph as R
from gridloom.operators import relational as L
from gridloom.operators import spatial as S
from gridloom.plans.base import EDGES_SQL, SITES_SQL, query, sites, supplier_edges, table


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("vertex"))


@query(f"""
    WITH e AS ({EDGES_SQL}), d AS (SELECT v, count(*) AS n FROM (SELECT source AS v FROM e UNION ALL SELECT target FROM e) u GROUP BY 1)
    SELECT CAST(s_suppkey AS BIGINT) AS vertex, CAST(coalesce(n, 0) AS BIGINT) AS degree, coalesce(n, 0) = 1 AS loose, coalesce(n, 0) = 0 AS alone FROM supplier LEFT JOIN d ON v = s_suppkey
""")
def q83_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges each vertex has, and which are dead ends or alone."""
    return R.degrees(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir))


@query(f"WITH e AS ({EDGES_SQL}) SELECT CAST(s_suppkey AS BIGINT) AS vertex, min(target) AS target FROM supplier LEFT JOIN e ON source = s_suppkey GROUP BY 1")
def q84_least_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest neighbour that an edge of each vertex leads to."""
    return R.least_targets(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir)).select("vertex", F.col("target").cast("long").alias("target"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def q85_customers_of_one_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer has no other."""
    return L.only_ones(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("""
    WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ':' || n, ',' ORDER BY l_quantity DESC) AS entries FROM c GROUP BY 1
""")
def q86_sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each supplier's lines have each quantity, in the order of the quantities as numbers."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    maps = counts.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_quantity").cast("long").cast("string"), "n"))).alias("m"))  # at most 50 quantities
    entries = L.sorted_entries(F.col("m"), descending=True)
    return maps.select("l_suppkey", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("entries"))


@query(f"""
    WITH s AS ({SITES_SQL}), l AS (SELECT CAST(n_nationkey AS INTEGER) AS way, 400.0 * n_nationkey + 200 AS wx FROM nation), d AS (SELECT site, way, abs(CAST(x AS DOUBLE) - wx) AS d, y FROM s, l)
    SELECT site, arg_min(way, (d, way)) AS way, round(min(d), 6) AS distance, round(min(CAST(y AS DOUBLE)) / 12000.0, 6) AS "at" FROM d WHERE d > 0.1 AND d <= 2000 GROUP BY 1
""")
def q87_nearest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street nearest to each site, within 2000, and where along it its foot lies."""
    at = F.col("n_nationkey") * 400.0 + 200
    ways = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("way"), F.array(G.point(at, F.lit(0.0)), G.point(at, F.lit(5000.0)), G.point(at, F.lit(12000.0))).alias("line"))
    points = sites(spark, sf_dir).select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = S.nearest_lines(points, ways, 250.0, 2000.0, "site", "way", ("x", "y"), "line", 0.1)
    return out.select("site", "way", F.round("distance", 6).alias("distance"), F.round("at", 6).alias("at"))


@query("""
    WITH b AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 * 10 AS x, (c_custkey * 104729) % 1000 * 10 AS y, 10 + 10 * (c_custkey % 4) AS w, 10 + 10 * (c_custkey % 3) AS h FROM customer)
    SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id
    WHERE a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h
      AND NOT (a.x < b.x AND a.x + a.w > b.x + b.w AND a.y < b.y AND a.y + a.h > b.y + b.h) AND NOT (b.x < a.x AND b.x + b.w > a.x + a.w AND b.y < a.y AND b.y + b.h > a.y + a.h)
""")
def q88_touching_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes whose borders touch or cross; one inside another does not."""
    k = F.col("c_custkey")
    x, y, w, h = k * 7919 % 1000 * 10, k * 104729 % 1000 * 10, k % 4 * 10 + 10, k % 3 * 10 + 10
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    return S.touching(table(spark, sf_dir, "customer").select(k.alias("id"), ring.alias("ring")), "id", "ring")


@query("""
    WITH o AS (SELECT o_orderkey, 1.0 + o_orderkey % 13 AS w, 2.0 + o_custkey % 11 AS h, CAST(o_orderkey % 17 AS DOUBLE) AS px, CAST(o_custkey % 19 AS DOUBLE) - 3 AS py FROM orders),
    f AS (SELECT *, least(greatest(px, 0), w) AS ax, least(greatest(py, 0), h) AS cy FROM o),
    d AS (SELECT *, sqrt((px - ax) ** 2 + py ** 2) AS d1, sqrt((px - w) ** 2 + (py - cy) ** 2) AS d2 FROM f)
    SELECT o_orderkey, CAST(round(least(d1, d2), 6) AS DOUBLE) AS distance, CAST(round(CASE WHEN d1 <= d2 THEN ax ELSE w + cy END / (w + h), 6) AS DOUBLE) AS at,
           CAST(round(CASE WHEN d1 <= d2 THEN ax ELSE w END, 6) AS DOUBLE) AS fx, CAST(round(CASE WHEN d1 <= d2 THEN 0 ELSE cy END, 6) AS DOUBLE) AS fy FROM d
""")
def q89_feet_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a point beside a bent line: its distance, where along the line its foot is, and the foot."""
    w, h = (F.col("o_orderkey") % 13 + 1).cast("double"), (F.col("o_custkey") % 11 + 2).cast("double")
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(G.point(zero, zero), G.point(w, zero), G.point(w, h)).alias("line"), G.point(F.col("o_orderkey") % 17, F.col("o_custkey") % 19 - 3).alias("p"))
    foot = rows.withColumn("foot", G.nearest_on_line(F.col("line"), F.col("p")))
    return foot.select("o_orderkey", F.round(G.distance_to_line(F.col("line"), F.col("p")), 6).alias("distance"), F.round(G.locate(F.col("line"), F.col("p")), 6).alias("at"), F.round("foot.x", 6).alias("fx"), F.round("foot.y", 6).alias("fy"))
