"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import graph as R
from gridloom.operators import metrics as M
from gridloom.operators import spatial as S
from gridloom.plans.base import SITES_SQL, query, sites, table

_RING = [(1000.0, 1000.0), (9000.0, 2000.0), (7000.0, 8000.0), (4000.0, 5000.0), (2000.0, 9000.0)]
_RING_SQL = ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(_RING, _RING[1:] + _RING[:1], strict=True)))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = sites(spark, sf_dir).select(F.col("site").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return a, a.select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))


@query(f"""
    WITH s AS ({SITES_SQL})
    SELECT a.site, round(avg(n.d), 6) AS mean, CAST(CASE WHEN avg(n.d) < 25 THEN 3 WHEN avg(n.d) < 45 THEN 2 ELSE 1 END AS INTEGER) AS class
    FROM s a, LATERAL (SELECT sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS d FROM s b WHERE b.site <> a.site ORDER BY d, b.site LIMIT 4) n
    GROUP BY 1
""")
def q13_knn4_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance to the four nearest sites, of each site, and the settlement class."""
    a, b = _pairs(spark, sf_dir)
    found = S.nearest(a, b, 4, "a", "b", ("ax", "ay"), ("bx", "by"), others=True)
    means = found.groupBy(F.col("a").alias("site")).agg(F.avg("distance").alias("mean"))
    return means.select("site", F.round("mean", 6).alias("mean"), M.settlement_class(F.col("mean")).alias("class"))


@query(f"""
    WITH s AS ({SITES_SQL})
    SELECT a.site AS a, b.site AS b, round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)), 6) AS distance
    FROM s a JOIN s b ON a.site < b.site WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 200 * 200
""")
def q14_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sites less than 200 apart."""
    return S.pairs_within(sites(spark, sf_dir), 200.0, "site", ("x", "y"), strict=True).select("a", "b", F.round("distance", 6).alias("distance"))


_SUPPLIERS_SQL = "SELECT s_suppkey AS t, (s_suppkey * 6007) % 10007 AS x, (s_suppkey * 3001) % 10009 AS y FROM supplier"


@query(f"""
    WITH s AS ({SITES_SQL}), t AS ({_SUPPLIERS_SQL}),
    d AS (SELECT site, t, sqrt(CAST((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) AS DOUBLE)) AS d FROM s, t)
    SELECT site, arg_min(t, (d, t)) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY 1
""")
def q15_nearest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier nearest to each site."""
    a, _ = _pairs(spark, sf_dir)
    key = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(key.alias("t"), (key * 6007 % 10007).alias("tx"), (key * 3001 % 10009).alias("ty"))
    return S.nearest(a, t, 1, "a", "t", ("ax", "ay"), ("tx", "ty")).select(F.col("a").alias("site"), F.col("t").alias("nearest"), F.round("distance", 6).alias("distance"))


@query(f"""
    WITH s AS ({SITES_SQL}), e(i, ax, ay, bx, bw) AS (VALUES {_RING_SQL})
    SELECT site FROM s, e GROUP BY site, x, y HAVING sum(CASE WHEN (ay > y) <> (bw > y) AND x < (bx - ax) * (y - ay) / nullif(bw - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1
""")
def q16_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites inside an area."""
    ring = spark.createDataFrame([([(x, y) for x, y in _RING],)], "ring array<struct<x:double,y:double>>")
    return S.points_in_polygons(sites(spark, sf_dir).select("site", "x", "y"), ring, ("x", "y"), "ring", 1000.0).select("site")


@query("""
    WITH c AS (SELECT n_nationkey AS k, unnest([0, 1, 2, 3, 4]) AS i FROM nation),
    p AS (SELECT k, i, 100.0 * k + (10 + k % 7) * (CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END) + (CASE WHEN i = 2 THEN 3 ELSE 0 END) AS x, 50.0 * k + (5 + k % 4) * (CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END) AS y FROM c),
    e AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bw FROM p a JOIN p b ON a.k = b.k AND b.i = a.i + 1),
    m AS (SELECT k, sum(ax * bw - bx * ay) AS t, sum((ax + bx) * (ax * bw - bx * ay)) AS sx, sum((ay + bw) * (ax * bw - bx * ay)) AS sy FROM e GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS nation, CAST(round(abs(t) / 2, 6) AS DOUBLE) AS area, CAST(round(sx / (3 * t), 6) AS DOUBLE) AS cx, CAST(round(sy / (3 * t), 6) AS DOUBLE) AS cy FROM m
""")
def q17_polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centre of a ring for every nation."""
    k = F.col("n_nationkey")
    x0, y0, w, h = k * 100.0, k * 50.0, k % 7 + 10, k % 4 + 5
    ring = F.array(G.point(x0, y0), G.point(x0 + w, y0), G.point(x0 + w + 3, y0 + h), G.point(x0, y0 + h))
    rows = table(spark, sf_dir, "nation").select(k.alias("nation"), ring.alias("ring"))
    c = G.centroid(F.col("ring"))
    return rows.select("nation", F.round(G.area(F.col("ring")), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("""
    SELECT o_orderkey, CAST(round(w + h, 6) AS DOUBLE) AS length, CAST(round(CASE WHEN (w + h) * 0.25 <= w THEN (w + h) * 0.25 ELSE w END, 6) AS DOUBLE) AS qx,
           CAST(round(CASE WHEN (w + h) * 0.25 <= w THEN 0 ELSE (w + h) * 0.25 - w END, 6) AS DOUBLE) AS qy, CAST(round((w + h) * 0.5, 6) AS DOUBLE) AS half
    FROM (SELECT o_orderkey, 1.0 + o_orderkey % 13 AS w, 2.0 + o_custkey % 11 AS h FROM orders) o
""")
def q18_line_length_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, a point at a quarter, and the length of the middle half of a line for every order."""
    w, h = (F.col("o_orderkey") % 13 + 1).cast("double"), (F.col("o_custkey") % 11 + 2).cast("double")
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(G.point(zero, zero), G.point(w, zero), G.point(w, h)).alias("line"))
    quarter = G.interpolate(F.col("line"), F.lit(0.25))
    return rows.select(
        "o_orderkey",
        F.round(G.length(F.col("line")), 6).alias("length"),
        F.round(quarter["x"], 6).alias("qx"),
        F.round(quarter["y"], 6).alias("qy"),
        F.round(G.length(G.substring(F.col("line"), F.lit(0.25), F.lit(0.75))), 6).alias("half"),
    )


@query(f"""
    WITH s AS ({SITES_SQL}),
    d AS (SELECT a.nation, a.site, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS d,
                 row_number() OVER (PARTITION BY a.site ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.site) AS nth FROM s a JOIN s b ON a.nation = b.nation),
    m AS (SELECT nation, site, sum(d) / 4 AS m FROM d WHERE nth <= 5 GROUP BY 1, 2)
    SELECT nation, round(median(m), 6) AS house_distance FROM m GROUP BY 1
""")
def q35_house_distance_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the median over sites of the mean distance to the four nearest sites of that nation."""
    a = sites(spark, sf_dir).select("nation", F.col("site").alias("house"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = a.select(F.col("nation").alias("of"), F.col("house").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    found = S.nearest(a, b, 5, "house", "b", ("ax", "ay"), ("bx", "by"), ("nation", "of"))
    return M.house_distance(a, "nation", found).select("nation", F.round("house_distance", 6).alias("house_distance"))


@query("""
    WITH l AS (SELECT c_custkey AS id, (c_custkey * 3) % 50 AS sx, (c_custkey * 7) % 60 AS sy, (c_custkey * 11) % 50 AS tx, (c_custkey * 13) % 60 AS ty FROM customer),
    v AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS vertex FROM (SELECT sx AS x, sy AS y FROM l UNION SELECT tx, ty FROM l) p)
    SELECT id, s.vertex AS source, t.vertex AS target, round(sqrt(CAST((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty) AS DOUBLE)), 6) AS cost
    FROM l JOIN v s ON s.x = sx AND s.y = sy JOIN v t ON t.x = tx AND t.y = ty
""")
def q56_topology_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to a graph: equal ends become one numbered vertex."""
    k = F.col("c_custkey")
    shift = F.lit(0.001) * (k % 3)  # below the tolerance
    line = F.array(G.point(k * 3 % 50 + shift, k * 7 % 60), G.point(k * 11 % 50, k * 13 % 60))
    exact = F.array(G.point(k * 3 % 50, k * 7 % 60), G.point(k * 11 % 50, k * 13 % 60))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), line.alias("line"), exact.alias("exact"))
    edges, _ = R.topology(rows, "id", "line")
    return edges.join(rows.select("id", "exact"), "id").select("id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), F.round(G.length(F.col("exact")), 6).alias("cost"))


@query()
def q58_convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the hull of each nation's sites."""
    return S.convex_hull(sites(spark, sf_dir), "nation", ("x", "y"))


@query("""
    WITH v AS (SELECT n_nationkey AS id, 10.0 * n_nationkey + 5 AS at FROM nation), h AS (SELECT r_regionkey AS id, 7.0 * r_regionkey + 3 AS at FROM region),
    c AS (SELECT v.id AS v, h.id AS h FROM v, h WHERE v.at < 400 AND h.at < 100)
    SELECT 'v' AS kind, CAST(id AS BIGINT) AS id, CAST((SELECT count(*) FROM c WHERE c.v = v.id) + 1 AS BIGINT) AS parts, 100.0::DOUBLE AS length FROM v
    UNION ALL SELECT 'h', CAST(id AS BIGINT), CAST((SELECT count(*) FROM c WHERE c.h = h.id) + 1 AS BIGINT), 400.0 FROM h
""")
def q62_split_at_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets split where they cross: parts and total length of each."""
    zero = F.lit(0.0)
    at = (F.col("n_nationkey") * 10 + 5).cast("double")
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(G.point(at, zero), G.point(at, F.lit(100.0))).alias("line"))
    at = (F.col("r_regionkey") * 7 + 3).cast("double")
    h = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.array(G.point(zero, at), G.point(F.lit(400.0), at)).alias("line"))
    lines = v.unionByName(h)
    parts = R.split_at(lines, R.crossings(lines, 50.0))
    out = parts.groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum(G.length(F.col("line"))), 6).alias("length"))
    return out.select(F.when(F.col("id") >= 1000, "h").otherwise("v").alias("kind"), (F.col("id") % 1000).alias("id"), "parts", "length")
