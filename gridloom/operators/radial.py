"""Parameters of radial networks: accumulated simultaneity, resistances and the row of each grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.operators.graph import cut, tree_paths


def line_factors(paths: DataFrame, loads: DataFrame) -> DataFrame:
    """(grid, vertex, factor): of the line to each vertex the coincident share of all load beyond it.

    ``paths`` has grid, vertex and path from the root; ``loads`` has grid, vertex, kind,
    max_p_mw and n.  Loads of all consumers beyond a line add up by class; 0 without load.
    """
    of_class = loads.groupBy("grid", "vertex", E.consumer_class(F.col("kind")).alias("class")).agg(F.sum("max_p_mw").alias("p"), F.sum("n").alias("n"))
    beyond = paths.join(of_class, ["grid", "vertex"]).select("grid", "class", "p", "n", F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("vertex"))
    sums = beyond.groupBy("grid", "vertex", "class").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    load = E.simultaneous_load(F.col("p"), F.col("n"), E.simultaneity(F.col("class")))
    return sums.groupBy("grid", "vertex").agg(F.coalesce(F.try_divide(F.sum(load), F.sum("p")), F.lit(0.0)).alias("factor"))


def consumer_resistances(paths: DataFrame, lines: DataFrame, loads: DataFrame) -> DataFrame:
    """(grid, branch, households, resistance, reactance): what the household equivalents of each branch see.

    ``lines`` has grid, vertex (their far end), length_km, r and x in ohm per km.
    Resistance is weighted by the accumulated factor of each line, reactance is not.
    """
    equal = loads.groupBy("grid", "vertex").agg((F.sum("max_p_mw") * 1000 / E.HOUSEHOLD_KW).alias("h"))
    ends = paths.join(equal, ["grid", "vertex"])
    steps = ends.select("grid", "branch", "h", F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("vertex"))
    per_line = steps.groupBy("grid", "branch", "vertex").agg(F.sum("h").alias("h"))
    joined = per_line.join(lines, ["grid", "vertex"]).join(line_factors(paths, loads), ["grid", "vertex"])
    ohm = joined.groupBy("grid", "branch").agg(F.sum(F.col("h") * F.col("length_km") * F.col("r") * F.col("factor")).alias("resistance"), F.sum(F.col("h") * F.col("length_km") * F.col("x")).alias("reactance"))
    return ends.groupBy("grid", "branch").agg(F.sum("h").alias("households")).join(ohm, ["grid", "branch"])


def grid_parameters(lines: DataFrame, loads: DataFrame, root: int | str, transformers: DataFrame | None = None, house_distances: DataFrame | None = None) -> DataFrame:
    """One row of classification parameters for every grid, in one job for all of them.

    ``lines`` has grid, parent, child, length_km, parallel, r and x; ``loads`` grid,
    vertex, kind, max_p_mw and n (households).  ``transformers`` (grid, size_kva,
    mapped) and ``house_distances`` (grid, house_distance_km) add their columns.
    """
    lines = cut(lines)
    paths = cut(tree_paths(lines, root, "length_km", ("grid",)))
    ohm = consumer_resistances(paths, lines.withColumnRenamed("child", "vertex").drop("parent"), loads)
    by_grid = ohm.groupBy("grid").agg(
        F.max("households").alias("max_no_of_households_of_a_branch"), F.sum("resistance").alias("resistance"), F.sum("reactance").alias("reactance"), F.max("resistance").alias("max_vsw_of_a_branch")
    )
    cable = lines.groupBy("grid").agg(F.sum(F.col("length_km") * F.col("parallel")).alias("cable_length_km"), F.countDistinct("child").alias("vertices"))
    users = paths.join(loads.select("grid", "vertex").distinct(), ["grid", "vertex"])
    far = users.groupBy("grid").agg(F.count("*").alias("no_house_connections"), F.max("distance").alias("max_trafo_dis"), F.avg("distance").alias("avg_trafo_dis"))
    branches = paths.groupBy("grid").agg(F.countDistinct("branch").alias("no_branches"))
    of_class = loads.groupBy("grid", E.consumer_class(F.col("kind")).alias("class")).agg(F.sum("max_p_mw").alias("p"), F.sum("n").alias("n"))
    coincident = E.simultaneous_load(F.col("p"), F.col("n"), E.simultaneity(F.col("class")))
    power = of_class.groupBy("grid").agg(F.sum("n").alias("no_households"), F.sum("p").alias("max_power_mw"), F.sum(coincident).alias("simultaneous_peak_load_mw"))
    out = cable.join(far, "grid").join(branches, "grid").join(power, "grid").join(by_grid, "grid")
    equal = F.col("max_power_mw") * 1000 / E.HOUSEHOLD_KW
    out = out.withColumns(
        {
            "no_connection_buses": F.col("vertices") - F.col("no_house_connections"),
            "no_household_equ": equal,
            "no_house_connections_per_branch": F.col("no_house_connections") / F.col("no_branches"),
            "no_households_per_branch": equal / F.col("no_branches"),
            "cable_len_per_house": F.col("cable_length_km") / F.col("no_house_connections"),
            "ratio": F.try_divide("resistance", "reactance"),
            "vsw_per_branch": F.col("resistance") / F.col("no_branches"),
        }
    ).drop("vertices")
    if transformers is not None:
        out = out.join(transformers.select("grid", (F.col("size_kva") / 1000).alias("transformer_mva"), F.col("mapped").alias("osm_trafo")), "grid", "left")
    return out if house_distances is None else out.join(house_distances, "grid", "left")
