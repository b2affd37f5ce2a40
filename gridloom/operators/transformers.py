"""Transformers from maps: cleaning of candidates, and removal of those inside buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import spatial as S
from gridloom.operators.staging import cut

# Fixed values of the model: the footprint in m2 from which a candidate is a substation,
# the voltage from which it is not one of the distribution network, and the distance in
# metres below which two candidates are one.
SUBSTATION_M2, HIGH_VOLTAGE, SAME_PLACE_M = 60.0, 110_000.0, 8.0


def voltage_of(tag: Column) -> Column:
    """A voltage tag as a number: 1 where it is missing, null where it is none."""
    return F.coalesce(tag, F.lit("1")).try_cast("double")


def map_id(tag: Column) -> Column:
    """An identifier without the letters of its kind before it."""
    return F.regexp_replace(tag, "^[waynode/]+", "")


def clean_candidates(candidates: DataFrame, malls: DataFrame, cell: float = 500.0) -> DataFrame:
    """(id, x, y) of the candidates that are transformers of their own.

    ``candidates`` has id, nth (their order), voltage and ring, which holds one point for
    a point; ``malls`` has ring.  Dropped are points inside a polygon of a candidate,
    footprints of substations, high voltages (a tag that is no number stays), those
    with a later candidate nearer than SAME_PLACE_M, and those inside a mall.
    """
    is_point = F.size("ring") == 1
    areas = candidates.where(~is_point).select(F.col("ring").alias("around"))
    points = candidates.where(is_point).withColumns({"x": F.col("ring")[0]["x"], "y": F.col("ring")[0]["y"]})
    inside = S.points_in_polygons(points.select("id", "x", "y"), areas, ("x", "y"), "around", cell).select("id").distinct()
    rows = candidates.join(inside, "id", "left_anti")
    low = F.coalesce(voltage_of(F.col("voltage")) < HIGH_VOLTAGE, F.lit(True))
    rows = rows.where((F.when(is_point, 0.0).otherwise(G.area(F.col("ring"))) < SUBSTATION_M2) & low)
    centre = F.when(is_point, F.col("ring")[0]).otherwise(G.centroid(F.col("ring")))
    rows = rows.withColumn("c", centre).select("id", "nth", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    rows = _without_later(rows)
    shops = S.points_in_polygons(rows, malls.select("ring"), ("x", "y"), "ring", cell).select("id").distinct()
    return rows.join(shops, "id", "left_anti").select("id", "x", "y")


def _without_later(rows: DataFrame) -> DataFrame:
    """Rows (id, nth, x, y) without one of a larger nth nearer than SAME_PLACE_M.

    Two rows of a cell whose diagonal is below that distance are always that near, so only
    its latest can stay.  These, a row or so a cell, are compared with the latest of each
    place: work grows with the rows, not with the pairs of a crowded place.
    """
    side = SAME_PLACE_M * 0.7  # less than the distance over the root of two
    rows = cut(rows.withColumns({"__i": F.floor(F.col("x") / side).cast("long"), "__j": F.floor(F.col("y") / side).cast("long")}))
    newest = rows.groupBy("__i", "__j").agg(F.max("nth").alias("__most"))
    judged = cut(rows.join(newest, ["__i", "__j"]).select("id", "nth", "x", "y", "__most"))
    places = rows.groupBy(F.col("x").alias("lx"), F.col("y").alias("ly")).agg(F.max("nth").alias("later"))
    met = S.within_distance(judged.where("nth >= __most"), places, SAME_PLACE_M, ("x", "y"), ("lx", "ly"), strict=True).where("later > nth")
    return rows.join(judged.where("nth < __most").select("id").union(met.select("id")).distinct(), "id", "left_anti").drop("__i", "__j")


def without_indoor(transformers: DataFrame, buildings: DataFrame, cell: float = 500.0) -> DataFrame:
    """Transformers (id, x, y, ...) whose place is not inside a building (peak, ring) that needs no supply."""
    unserved = buildings.where("peak = 0").select(F.col("ring").alias("__ring"))
    indoor = S.points_in_polygons(transformers.select("id", "x", "y"), unserved, ("x", "y"), "__ring", cell).select("id").distinct()
    return transformers.join(indoor, "id", "left_anti")
