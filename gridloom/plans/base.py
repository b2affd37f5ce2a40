"""Registration of queries with their SQL, and the synthetic sites on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL for the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Segments of customers as types of buildings.
KINDS = {"BUILDING": "SFH", "HOUSEHOLD": "MFH", "FURNITURE": "AB", "AUTOMOBILE": "Commercial", "MACHINERY": "Public"}
KIND_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
SITES_SQL = f"""
    SELECT c_custkey AS site, c_nationkey AS nation, {KIND_SQL} AS kind,
           (c_custkey * 7919) % 10007 AS x, (c_custkey * 104729) % 10009 AS y,
           40 + (c_custkey * 31) % 400 AS area, 1 + c_custkey % 5 AS floors
    FROM customer
"""
UNITS_SQL = """CASE WHEN kind IN ('Commercial', 'Public') THEN 1 WHEN kind = 'SFH' THEN CASE WHEN area < 160 THEN 1 ELSE 2 END
               ELSE CAST(floor(area / 50.0) * floors AS INTEGER) END"""
BUILDINGS_SQL = f"""
    SELECT *, CASE WHEN kind = 'Commercial' THEN area * 79.0 / 1000 WHEN kind = 'Public' THEN area * 29.0 / 1000 ELSE units * 30.0 END AS peak
    FROM (SELECT *, {UNITS_SQL} AS units FROM ({SITES_SQL}) s) u
"""
EDGES_SQL = """
    SELECT CAST(s_suppkey AS BIGINT) AS source, CAST((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS BIGINT) AS target,
           CAST(1 + (s_suppkey * 13) % 17 AS DOUBLE) AS cost
    FROM supplier WHERE s_suppkey % 5 <> 0
"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites on a plane: site, nation, kind, x, y, area and floors."""
    key, kind = F.col("c_custkey"), F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("c_mktsegment") == a, b).otherwise(kind)
    return table(spark, sf_dir, "customer").select(
        key.alias("site"), F.col("c_nationkey").alias("nation"), kind.alias("kind"), (key * 7919 % 10007).alias("x"), (key * 104729 % 10009).alias("y"), (40 + key * 31 % 400).alias("area"), (1 + key % 5).alias("floors")
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the load model: units and peak."""
    from gridloom.functions import electrical as E

    rows = sites(spark, sf_dir).withColumn("units", E.households(F.col("kind"), F.col("area"), F.col("floors")))
    return rows.withColumn("peak", E.peak_load_kw(F.col("kind"), F.col("area"), F.col("units")))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph on suppliers: source, target, cost."""
    rows = table(spark, sf_dir, "supplier")
    n = rows.agg(F.count("*").alias("n"))
    key = F.col("s_suppkey")
    return rows.crossJoin(F.broadcast(n)).where(key % 5 != 0).select(key.alias("source"), ((key * 7 + 3) % F.col("n")).alias("target"), (1 + key * 13 % 17).cast("double").alias("cost"))
