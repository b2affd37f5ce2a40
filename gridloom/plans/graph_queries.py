"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cluster as C
from gridloom.operators import graph as G
from gridloom.plans.base import EDGES_SQL, query, supplier_edges, table

_COMPONENTS_SQL = f"""
    e AS ({EDGES_SQL}), b AS (SELECT source AS u, target AS w FROM e UNION SELECT target, source FROM e),
    r AS (SELECT CAST(s_suppkey AS BIGINT) AS v, CAST(s_suppkey AS BIGINT) AS c FROM supplier UNION SELECT b.w, r.c FROM r JOIN b ON r.v = b.u),
    g AS (SELECT v AS vertex, min(c) AS component FROM r GROUP BY 1)
"""


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vertex"))


@query(f"WITH RECURSIVE {_COMPONENTS_SQL} SELECT vertex, component FROM g")
def q19_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each vertex, named by its smallest."""
    return G.connected_components(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_COMPONENTS_SQL}, n AS (SELECT component, CAST(sum(CASE WHEN vertex % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM g GROUP BY 1),
    a AS (SELECT component, n, CASE WHEN (SELECT count(*) FROM n) > 1 AND n <= 1 THEN 'drop' WHEN n >= 2000 THEN 'split' ELSE 'keep' END AS action FROM n)
    SELECT component, n, action, CAST(CASE action WHEN 'keep' THEN 1 WHEN 'split' THEN n // 1000 ELSE 0 END AS BIGINT) AS parts,
           CAST(CASE WHEN action <> 'drop' THEN 1 + coalesce(sum(CASE action WHEN 'keep' THEN 1 WHEN 'split' THEN n // 1000 ELSE 0 END) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS cluster
    FROM a
""")
def q20_component_prune_and_kcid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each component, and the numbers of the clusters."""
    vertices = _vertices(spark, sf_dir)
    components = G.connected_components(vertices, supplier_edges(spark, sf_dir))
    return C.component_clusters(components, vertices.where("vertex % 2 = 0"))


@query(f"""
    WITH RECURSIVE e AS ({EDGES_SQL}), b AS (SELECT source AS u, target AS w FROM e UNION SELECT target, source FROM e),
    r AS (SELECT CAST(s_suppkey AS BIGINT) AS v FROM supplier WHERE s_suppkey % 11 = 0 UNION SELECT b.w FROM r JOIN b ON r.v = b.u WHERE b.w % 3 <> 0)
    SELECT v AS vertex FROM r
""")
def q21_fixpoint_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that an exclusion spreads to, from seeds through admitted neighbours."""
    seeds = _vertices(spark, sf_dir).where("vertex % 11 = 0")
    return G.reachable(seeds, supplier_edges(spark, sf_dir), F.col("t") % 3 != 0)


_PATHS_SQL = f"""
    e AS ({EDGES_SQL}), b AS (SELECT source AS u, target AS w, cost FROM e UNION ALL SELECT target, source, cost FROM e),
    p AS (SELECT CAST(s_suppkey AS BIGINT) AS source, CAST(s_suppkey AS BIGINT) AS vertex, 0.0::DOUBLE AS cost, [CAST(s_suppkey AS BIGINT)] AS seen FROM supplier
          UNION ALL SELECT p.source, b.w, p.cost + b.cost, list_append(seen, b.w) FROM p JOIN b ON p.vertex = b.u WHERE NOT list_contains(seen, b.w))
"""


@query(f"WITH RECURSIVE {_PATHS_SQL} SELECT source, vertex, min(cost) AS cost FROM p GROUP BY 1, 2")
def q22_shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest costs from every vertex to all that it reaches."""
    return G.shortest_paths(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir), many=True).select("source", "vertex", "cost")


@query(f"WITH RECURSIVE {_PATHS_SQL} SELECT source AS i, vertex AS j, min(cost) AS cost FROM p WHERE source <> vertex GROUP BY 1, 2")
def q23_cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs between all pairs of different vertices, as a sparse matrix."""
    paths = G.shortest_paths(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir), many=True)
    return paths.where("source <> vertex").select(F.col("source").alias("i"), F.col("vertex").alias("j"), "cost")


@query(f"""
    WITH RECURSIVE {_PATHS_SQL}, d AS (SELECT source, vertex, min(cost) AS cost FROM p GROUP BY 1, 2),
    v AS (SELECT d.source, d.vertex, min(b.u) AS via FROM d JOIN b ON b.w = d.vertex JOIN d a ON a.source = d.source AND a.vertex = b.u AND a.cost + b.cost = d.cost GROUP BY 1, 2),
    w AS (SELECT source, vertex, vertex AS node, 0 AS back FROM d UNION ALL SELECT w.source, w.vertex, v.via, back + 1 FROM w JOIN v ON v.source = w.source AND v.vertex = w.node)
    SELECT source, vertex, CAST(row_number() OVER (PARTITION BY source, vertex ORDER BY back DESC) AS INTEGER) AS nth, node FROM w
""")
def q71_ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices in order on the cheapest way from every vertex to all that it reaches."""
    return G.every_way(G.shortest_paths(_vertices(spark, sf_dir), supplier_edges(spark, sf_dir), many=True))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radial network: root, regions, nations, and customers as leaves."""
    region = table(spark, sf_dir, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), (F.col("r_regionkey") + 1).cast("double").alias("length"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), (F.col("n_nationkey") % 7 + 1).cast("double").alias("length"))
    leaf = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), (F.col("c_custkey") % 13 + 1).cast("double").alias("length"))
    return region.unionByName(nation).unionByName(leaf)


_TREE_SQL = """
    t AS (SELECT c_custkey, 'r' || n_regionkey AS r, 'n' || n_nationkey AS n, 'c' || c_custkey AS c, CAST(n_regionkey + 1 AS DOUBLE) AS lr, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS ln,
          CAST(c_custkey % 13 + 1 AS DOUBLE) AS lc, CAST(1 + c_custkey % 4 AS DOUBLE) AS h FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


@query(f"WITH {_TREE_SQL} SELECT c AS vertex, 3 AS depth, lr + ln + lc AS distance, r AS branch FROM t")
def q29_tree_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, distance and branch of every leaf."""
    return G.tree_paths(_tree(spark, sf_dir), "root").where("depth = 3").select("vertex", "depth", "distance", "branch")


@query(f"WITH {_TREE_SQL} SELECT vertex, sum(h) AS total FROM (SELECT unnest(['root', r, n, c]) AS vertex, h FROM t) u GROUP BY 1")
def q30_descendant_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households below every vertex."""
    households = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"), (F.col("c_custkey") % 4 + 1).cast("double").alias("h"))
    return G.descendant_sums(G.tree_paths(_tree(spark, sf_dir), "root"), households, "h")


@query(f"""
    WITH {_TREE_SQL}, l AS (SELECT r AS branch, h, unnest([lr, ln, lc]) AS length, unnest([0.2, 0.3, 0.5]::DOUBLE[]) AS ohm FROM t)
    SELECT branch, round(sum(h * length * ohm * 0.8), 4) AS resistance, round(sum(h * length * 0.08), 4) AS reactance FROM l GROUP BY 1
""")
def q31_vsw_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resistance and reactance that the households of each branch see."""
    from gridloom.operators.metrics import vsw

    tree = _tree(spark, sf_dir)
    households = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"), (F.col("c_custkey") % 4 + 1).cast("double").alias("h"))
    level = F.substring("child", 1, 1)
    ohm = F.when(level == "r", 0.2).when(level == "n", 0.3).otherwise(0.5)
    lines = tree.select(F.col("child").alias("line"), "length", ohm.alias("r"), F.lit(0.08).alias("x"), F.lit(0.8).alias("factor"))
    out = vsw(G.tree_paths(tree, "root").where("depth = 3"), lines, households)
    return out.select("branch", F.round("resistance", 4).alias("resistance"), F.round("reactance", 4).alias("reactance"))


@query(f"""
    WITH {_TREE_SQL}, k AS (SELECT sum(lc) AS leaves FROM t), a AS (SELECT sum(CAST(n_nationkey % 7 + 1 AS DOUBLE)) AS s FROM nation), b AS (SELECT sum(CAST(r_regionkey + 1 AS DOUBLE)) AS s FROM region)
    SELECT round(leaves + a.s + b.s, 6) AS cable_length_km, (SELECT CAST(count(*) AS BIGINT) FROM t) AS no_house_connections, (SELECT CAST(count(DISTINCT r) AS BIGINT) FROM t) AS no_branches,
           (SELECT max(lr + ln + lc) FROM t) AS max_trafo_dis, round((SELECT avg(lr + ln + lc) FROM t), 6) AS avg_trafo_dis, CAST((SELECT sum(h) FROM t) AS BIGINT) AS no_households,
           round((SELECT sum(h) FROM t) * 0.03, 6) AS max_power_mw, round((SELECT sum(h) FROM t) / (SELECT count(DISTINCT r) FROM t), 6) AS no_households_per_branch FROM k, a, b
""")
def q60_grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the tree taken as one network."""
    from gridloom.operators.metrics import grid_metrics

    tree = _tree(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    loads = customers.select(F.lit(0).alias("grid"), F.concat(F.lit("c"), "c_custkey").alias("bus"), F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("j"), F.lit(0.03).alias("max_p_mw"))
    paths = G.tree_paths(tree, "root").where("depth = 3").select(F.lit(0).alias("grid"), F.col("vertex").alias("bus"), "distance", "branch")
    out = grid_metrics(tree.select(F.lit(0).alias("grid"), F.col("length").alias("length_km")), loads, paths)
    return out.select(
        F.round("cable_length_km", 6).alias("cable_length_km"), "no_house_connections", "no_branches", "max_trafo_dis", F.round("avg_trafo_dis", 6).alias("avg_trafo_dis"), "no_households",
        F.round("max_power_mw", 6).alias("max_power_mw"), F.round("no_households_per_branch", 6).alias("no_households_per_branch"),
    )
