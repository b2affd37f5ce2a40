"""From networks to parameters, and from parameters to classes of networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.operators import cluster as C
from gridloom.operators import metrics as M
from gridloom.operators import radial as P
from gridloom.operators import relational as R
from gridloom.operators import spatial as S
from gridloom.operators.graph import cut
from gridloom.plans.pipeline import Networks

#: The bus that stands for the transformer of every network.
ROOT = "root"
#: Parameters by which networks are classified unless others are named.
COLUMNS = ("cable_length_km", "no_house_connections", "no_households_per_branch", "max_trafo_dis", "avg_trafo_dis", "vsw_per_branch", "max_power_mw")


def _of_cable(field: int) -> Column:
    """A value of the catalogue (1 for r, 2 for x) by the name of the cable."""
    pairs = [F.lit(v) for c in E.STREET_CABLES for v in (c[0], float(c[field]))]
    return F.create_map(*pairs)[F.col("cable")]


def radial_lines(networks: Networks) -> DataFrame:
    """(grid, parent, child, length_km, parallel, r, x): the lines of all networks as trees below ``root``.

    The last line of a feeder leads to the transformer; a house hangs on its point.
    """
    vertex = lambda c: F.concat(F.lit("v"), c)
    feeders = networks.lines.select("grid", F.coalesce(vertex("next"), F.lit(ROOT)).alias("parent"), vertex("node").alias("child"), "length_km", "parallel", "cable")
    houses = networks.houses.where("grid is not null").select("grid", vertex("connection").alias("parent"), F.concat(F.lit("h"), "id").alias("child"), "length_km", "parallel", "cable")
    return feeders.unionByName(houses).select("grid", "parent", "child", "length_km", "parallel", _of_cable(1).alias("r"), _of_cable(2).alias("x"))


def house_distances(networks: Networks) -> DataFrame:
    """(grid, house_distance_km): of each network the median over houses of the mean distance to their four nearest."""
    rows = networks.buildings.where("grid is not null").select("grid", F.col("id").cast("string").alias("house"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    other = rows.select(F.col("grid").alias("of"), F.col("house").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    found = S.nearest(cut(rows), cut(other), 5, "house", "b", ("ax", "ay"), ("bx", "by"), ("grid", "of"))  # a house is its own nearest
    return M.house_distance(rows, "grid", found).select("grid", (F.col("house_distance") / 1000).alias("house_distance_km"))


def parameters(networks: Networks, done: DataFrame | None = None) -> DataFrame:
    """One row of parameters for every network, in one job for all; networks in ``done`` (grid) are skipped."""
    loads = networks.houses.where("grid is not null").select("grid", F.concat(F.lit("h"), "id").alias("vertex"), "kind", (F.col("peak") / 1000).alias("max_p_mw"), F.col("units").cast("long").alias("n"))
    lines, sites = radial_lines(networks), networks.sites
    if done is not None:
        sites = cut(R.unfinished(sites, done, "grid"))
        lines, loads = (t.join(sites.select("grid"), "grid", "left_semi") for t in (lines, loads))
    return P.grid_parameters(lines, loads, ROOT, sites.select("grid", "size_kva", "mapped"), house_distances(networks))


#: Networks with a longer way, in km, or a building of more households are not classified.
LONGEST_KM, MOST_HOUSEHOLDS = 2.5, 150


def filtered(rows: DataFrame, buildings: DataFrame, longest_km: float = LONGEST_KM, most_households: int = MOST_HOUSEHOLDS) -> DataFrame:
    """``rows`` (grid, max_trafo_dis, ...) with ``filtered``; ``buildings`` has grid and units."""
    large = buildings.where(F.col("units") > most_households).select("grid", F.lit(True).alias("__large")).distinct()
    long = F.coalesce(F.col("max_trafo_dis") > longest_km, F.lit(False))
    return rows.join(large, "grid", "left").withColumn("filtered", long | F.col("__large").isNotNull()).drop("__large")


def classes(rows: DataFrame, k: int, columns: tuple[str, ...] = COLUMNS, algorithm: str = "kmeans", key: str = "grid") -> tuple[DataFrame, DataFrame]:
    """(labels, representatives): every network with its ``cluster``, and of each cluster the network nearest to its centre.

    Parameters are brought to the same scale first.  Clusters are numbered by the cable
    length of their representative.  ``algorithm`` is kmeans or kmedoids.
    """
    if algorithm not in ("kmeans", "kmedoids"):
        raise ValueError(f"no algorithm named {algorithm!r}")
    known = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    scaled = R.z_scores(cut(known), list(columns))
    labelled, _ = (C.k_means if algorithm == "kmeans" else C.k_medoids)(scaled, list(columns), key, k)
    labelled = cut(labelled)
    named = cut(C.representatives(labelled, key, columns[0]))
    return labelled.withColumnRenamed("cluster", "old").join(named, "old").select(key, "cluster"), named.select("cluster", "representative")
