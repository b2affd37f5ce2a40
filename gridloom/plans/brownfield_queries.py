"""Queries of mapped transformers, their sizes, and the filter of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.functions import geometry as G
from gridloom.operators import graph as R
from gridloom.operators import network as N
from gridloom.operators import transformers as T
from gridloom.plans import classification, pipeline
from gridloom.plans.base import BUILDINGS_SQL, EDGES_SQL, SITES_SQL, buildings, query, sites, supplier_edges, table


@query(f"""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY site) AS nth FROM ({BUILDINGS_SQL}) b),
    r AS (SELECT nation, site, nth, 12.0 + 20 * (nth - 1) AS cost, CASE WHEN kind IN ('Commercial', 'Public') THEN kind ELSE 'Residential' END AS class, CAST(peak AS DOUBLE) AS p, units FROM b WHERE 12 + 20 * (nth - 1) < 300),
    s AS (SELECT *, sum(CASE class WHEN 'Residential' THEN p ELSE 0 END) OVER w AS rp, sum(CASE class WHEN 'Residential' THEN units ELSE 0 END) OVER w AS rn,
            sum(CASE class WHEN 'Commercial' THEN p ELSE 0 END) OVER w AS cp, sum(CASE class WHEN 'Commercial' THEN units ELSE 0 END) OVER w AS cn,
            sum(CASE class WHEN 'Public' THEN p ELSE 0 END) OVER w AS pp, sum(CASE class WHEN 'Public' THEN units ELSE 0 END) OVER w AS pn FROM r WINDOW w AS (PARTITION BY nation ORDER BY nth)),
    l AS (SELECT *, CASE WHEN rn > 0 THEN rp * (0.07 + 0.93 * pow(rn, -0.75)) ELSE 0 END + CASE WHEN cn > 0 THEN cp * (0.5 + 0.5 * pow(cn, -0.75)) ELSE 0 END + CASE WHEN pn > 0 THEN pp * (0.6 + 0.4 * pow(pn, -0.75)) ELSE 0 END AS load FROM s),
    f AS (SELECT nation, min(nth) AS full_at FROM l WHERE load >= 630 GROUP BY 1),
    g AS (SELECT l.*, max(load) FILTER (nth = last) OVER (PARTITION BY l.nation) AS total FROM (SELECT l.*, max(l.nth) OVER (PARTITION BY l.nation) AS last FROM l LEFT JOIN f USING (nation) WHERE full_at IS NULL OR l.nth < full_at) l)
    SELECT nation, site, CAST(cost AS DOUBLE) AS cost, round(total, 6) AS load, CAST(CASE WHEN total < 100 THEN 100 WHEN total < 160 THEN 160 WHEN total < 250 THEN 250 WHEN total < 400 THEN 400 ELSE 630 END AS BIGINT) AS size_kva FROM g
""")
def q72_supply_by_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites along one street a nation, given to the transformer at its start until this is full or out of reach."""
    nth = F.row_number().over(Window.partitionBy("nation").orderBy("site"))
    b = buildings(spark, sf_dir).withColumn("nth", nth)
    points = R.cut(b.select(F.col("nation").alias("zone"), F.col("site").cast("long").alias("point"), "kind", F.col("peak").alias("power"), F.col("units").alias("count"), "nth"))
    along = points.select("zone", F.col("point").alias("source"), F.col("nth").alias("i")).join(points.select("zone", F.col("point").alias("target"), (F.col("nth") - 1).alias("i")), ["zone", "i"])
    mapped = points.select("zone", (-F.col("zone") - 1).cast("long").alias("vertex")).distinct()
    spur = points.where("nth = 1").join(mapped, "zone").select("zone", F.col("vertex").alias("source"), F.col("point").alias("target"), F.lit(12.0).alias("cost"))
    edges = R.cut(along.select("zone", "source", "target", F.lit(20.0).alias("cost")).unionByName(spur))
    given = pipeline.supplied_by_mapped(points.drop("nth"), edges, mapped)
    return given.select(F.col("zone").alias("nation"), F.col("point").alias("site"), "cost", F.round("load", 6).alias("load"), "size_kva")


@query("""
    WITH b AS (SELECT 8.0 * n_nationkey + 0.5 AS x0, 7.0 * n_nationkey + 0.5 AS y0, 5.0 + n_nationkey % 5 AS s FROM nation WHERE n_nationkey % 2 = 0),
    t AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 211 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 199 AS DOUBLE) AS y FROM supplier)
    SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE t.x > x0 AND t.x < x0 + s AND t.y > y0 AND t.y < y0 + s)
""")
def q73_without_indoor_transformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformers that are not inside a building without load."""
    n, key = F.col("n_nationkey"), F.col("s_suppkey")
    x, y, s = n * 8 + 0.5, n * 7 + 0.5, n % 5 + 5.0
    ring = F.array(G.point(x, y), G.point(x + s, y), G.point(x + s, y + s), G.point(x, y + s))
    b = table(spark, sf_dir, "nation").select((n % 2 * 30.0).alias("peak"), ring.alias("ring"))
    t = table(spark, sf_dir, "supplier").select(key.alias("id"), (key * 37 % 211).cast("double").alias("x"), (key * 53 % 199).cast("double").alias("y"))
    return T.without_indoor(t, b, 50.0).select("id")


@query(f"""
    WITH RECURSIVE e AS ({EDGES_SQL}), b AS (SELECT source AS u, target AS w, cost FROM e UNION ALL SELECT target, source, cost FROM e),
    p AS (SELECT CAST(s_suppkey AS BIGINT) AS source, CAST(s_suppkey AS BIGINT) AS vertex, 0.0::DOUBLE AS cost FROM supplier WHERE s_suppkey % 7 = 0
          UNION SELECT p.source, b.w, p.cost + b.cost FROM p JOIN b ON p.vertex = b.u WHERE p.cost + b.cost < 30)
    SELECT source, vertex, min(cost) AS cost FROM p GROUP BY 1, 2
""")
def q74_costs_within_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs below 30 from every seventh vertex, in one search from all of them."""
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("vertex")).where("vertex % 7 = 0")
    return R.shortest_paths(seeds, supplier_edges(spark, sf_dir), 30.0).select("source", "vertex", "cost")


@query(f"""
    SELECT site, CAST(CASE WHEN size IN (500, 800, 1260) THEN size // 2 WHEN size IN (100, 160, 250, 400, 630) THEN size ELSE 630 END AS INTEGER) AS standard_kva,
           CAST(CASE WHEN size IN (500, 800, 1260) THEN 2 WHEN size IN (100, 160, 250, 400, 630) THEN 1 ELSE ceil(size / 630.0) END AS INTEGER) AS parallel,
           CAST(CASE WHEN size IN (100, 160, 250, 400, 630, 500, 800, 1260) THEN size ELSE ceil(size / 630.0) * 630 END AS BIGINT) AS kept_kva,
           CAST(CASE WHEN size < 100 THEN 100 WHEN size < 160 THEN 160 WHEN size < 250 THEN 250 WHEN size < 400 THEN 400 WHEN size < 630 THEN 630 END AS BIGINT) AS next_kva
    FROM (SELECT site, CASE site % 9 WHEN 0 THEN 100 WHEN 1 THEN 160 WHEN 2 THEN 250 WHEN 3 THEN 400 WHEN 4 THEN 630 WHEN 5 THEN 500 WHEN 6 THEN 800 WHEN 7 THEN 1260 ELSE 30 + (site * 13) % 3000 END AS size FROM ({SITES_SQL}) s) z
""")
def q75_transformer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard size and number of units of an installed size, and both ways to correct it."""
    key, size = F.col("site"), 30 + F.col("site") * 13 % 3000
    for i, s in enumerate((100, 160, 250, 400, 630, 500, 800, 1260)):
        size = F.when(key % 9 == i, F.lit(s)).otherwise(size)
    rows = sites(spark, sf_dir).select("site", size.alias("size"))
    standard, units = N.transformer_type(F.col("size"))
    corrected = lambda estimated: E.corrected_size_kva(F.col("size"), F.lit(estimated)).cast("long")
    return rows.select("site", standard.alias("standard_kva"), units.alias("parallel"), corrected(True).alias("kept_kva"), corrected(False).alias("next_kva"))


@query(f"""
    WITH s AS (SELECT site, nation, 10 + x / 10000.0 AS lon, 48 + y / 10000.0 AS lat FROM ({SITES_SQL}) s), f AS (SELECT nation, min(site) AS site FROM s GROUP BY 1)
    SELECT s.site, round(2 * 6371 * asin(sqrt(pow(sin(radians(a.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(a.lat)) * pow(sin(radians(a.lon - s.lon) / 2), 2))), 6) AS km
    FROM s JOIN f ON s.nation = f.nation JOIN s a ON a.site = f.site
""")
def q76_great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance of every site to the first site of its nation."""
    s = sites(spark, sf_dir).select("site", "nation", (F.col("x") / 10000 + 10).alias("lon"), (F.col("y") / 10000 + 48).alias("lat"))
    first = s.groupBy("nation").agg(F.min(F.struct("site", "lon", "lat")).alias("f"))
    return s.join(first, "nation").select("site", F.round(E.haversine_km(F.col("lat"), F.col("lon"), F.col("f.lat"), F.col("f.lon")), 6).alias("km"))


@query(f"""
    WITH b AS ({BUILDINGS_SQL})
    SELECT site, CAST(greatest(units, 1) AS BIGINT) AS loads, round(CASE WHEN kind IN ('Commercial', 'Public') THEN CAST(peak AS DOUBLE) * greatest(units, 1) ELSE 30.0 * greatest(units, 1) END / 1000, 6) AS mw FROM b
""")
def q77_household_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of every site, one for each household, counted and added up."""
    rows = N.household_loads(buildings(spark, sf_dir), "site")
    return rows.groupBy("site").agg(F.count("*").alias("loads"), F.round(F.sum("max_p_mw"), 6).alias("mw"))


@query("""
    WITH g AS (SELECT c_custkey AS grid, (c_custkey % 40) / 15.0 AS max_trafo_dis FROM customer)
    SELECT grid, max_trafo_dis > 2.5 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = grid AND o_orderkey % 160 > 150) AS filtered FROM g
""")
def q78_filtered_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks too long or with too large a building for classification."""
    grids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid"), (F.col("c_custkey") % 40 / 15.0).alias("max_trafo_dis"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid"), (F.col("o_orderkey") % 160).alias("units"))
    return classification.filtered(grids, b).select("grid", "filtered")
