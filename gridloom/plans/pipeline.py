"""From buildings and streets to low-voltage networks, for all areas in one job.

Every stage takes and returns DataFrames with the area as a column, so areas are
processed together; nothing loops over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.functions import geometry as G
from gridloom.operators import cluster as C
from gridloom.operators import graph as R
from gridloom.operators import network as N
from gridloom.operators import spatial as S
from gridloom.operators import transformers as T
from gridloom.operators.relational import required

#: Longest and shortest way of a building to its street, and how near an end counts as the end, in metres.
STREET_REACH, STREET_LEAST, SNAP = 2000.0, 0.1, 0.1
#: How far outside the box of its points the paths of a part of a large component may lead, in metres.
ZONE_MARGIN = 1000.0
#: Classes of ways that are house connections, and of parts of split streets.
HOUSE_CLASS, SPLIT_CLASS = 110, 103


@dataclass
class Networks:
    """The tables of generated networks.

    ``buildings`` names the grid that serves each, null for none.  ``clusters`` has a row
    for every class of consumer at a point of a grid; ``sites`` the transformer of every
    grid: ``mapped`` where it comes from a map (then with its id), and its number in its
    zone, negative for mapped ones.
    """

    buildings: DataFrame
    edges: DataFrame
    clusters: DataFrame
    sites: DataFrame
    lines: DataFrame
    houses: DataFrame


def served_buildings(buildings: DataFrame, areas: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Buildings whose centre lies in an area, with units and the peak that the network serves.

    ``buildings`` has id, kind, floors and ring; ``areas`` has area and ring.  Large
    consumers supply themselves, and so does what touches them and is not
    residential.  Buildings without a peak of their own are dropped.
    """
    rows = buildings.withColumn("c", G.centroid(F.col("ring"))).withColumns({"x": F.col("c.x"), "y": F.col("c.y"), "m2": G.area(F.col("ring"))}).drop("c")
    inside = S.points_in_polygons(rows, areas.withColumnRenamed("ring", "around"), ("x", "y"), "around", cell).drop("around")
    inside = inside.withColumn("units", E.households(F.col("kind"), F.col("m2"), F.coalesce("floors", F.lit(1))))
    inside = inside.withColumn("peak", E.peak_load_kw(F.col("kind"), F.col("m2"), F.col("units"))).where("peak > 0")
    inside = R.cut(inside.withColumn("peak", E.without_large_consumers(F.col("kind"), F.col("peak"))))
    business = inside.where(F.col("kind").isin("Commercial", "Public", "Industrial"))
    pairs = S.touching(business, "id", "ring").select(F.col("a").alias("source"), F.col("b").alias("target"))
    spread = R.reachable(business.where("peak = 0").select(F.col("id").alias("vertex")), pairs).select(F.col("vertex").alias("id"))
    hit = spread.withColumn("__own", F.lit(True))
    return inside.join(hit, "id", "left").withColumn("peak", F.when(F.col("__own"), 0.0).otherwise(F.col("peak"))).drop("__own")


def mapped_transformers(transformers: DataFrame, buildings: DataFrame, areas: DataFrame, cell: float = 1000.0) -> DataFrame:
    """(id, x, y) of the transformers inside an area that are not inside a building that needs no supply."""
    places = transformers.select(F.col("id").cast("string").alias("id"), "x", "y")
    inside = S.points_in_polygons(places, areas.select(F.col("ring").alias("around")), ("x", "y"), "around", cell).drop("around").distinct()
    return T.without_indoor(inside, buildings)


def street_graph(buildings: DataFrame, ways: DataFrame, cell: float = 200.0, transformers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, vertices, consumers, mapped): streets split at crossings and house connections, as a graph.

    ``ways`` has id, clazz and line; ``transformers`` id, x and y.  ``consumers`` maps
    buildings, and ``mapped`` transformers, to their vertex and to the vertex of the street
    that they are connected to.
    """
    streets = ways.where(F.col("clazz") != HOUSE_CLASS)
    places = buildings.where("peak <> 0").select(F.concat(F.lit("b/"), "id").alias("id"), "x", "y")
    if transformers is not None:
        places = places.unionByName(transformers.select(F.concat(F.lit("t/"), "id").alias("id"), "x", "y"))
    drops = S.nearest_lines(places, streets.select("id", "line").withColumnRenamed("id", "way"), 50.0, STREET_REACH, "id", "way", ("x", "y"), "line", STREET_LEAST)
    lengths = streets.select(F.col("id").alias("way"), "line", G.length(F.col("line")).alias("whole"))
    drops = drops.join(lengths, "way")
    along = F.col("at") * F.col("whole")
    at = F.when(along < SNAP, 0.0).when(F.col("whole") - along < SNAP, 1.0).otherwise(F.col("at"))
    drops = R.cut(drops.withColumn("at", at).withColumn("foot", G.interpolate(F.col("line"), F.col("at"))).select("id", "way", "at", "foot"))
    cuts = drops.select(F.col("way").alias("id"), "at").unionByName(R.crossings(streets.select("id", "line"), cell))
    parts = R.split_at(streets.select("id", "line"), cuts).select(F.concat_ws("/", F.lit("w"), "id", "part").alias("id"), "line")
    homes = places.join(drops, "id").select("id", F.array(G.point(F.col("x"), F.col("y")), F.col("foot")).alias("line"))
    edges, vertices = R.topology(parts.unionByName(homes), "id", "line")
    edges = R.cut(edges)
    of = lambda mark: edges.where(F.col("id").startswith(mark)).select(F.substring("id", 3, 1 << 30).alias("id"), F.col("source").alias("vertex"), F.col("target").alias("connection"))
    return edges, vertices, of("b/"), of("t/")


def supply_zones(buildings: DataFrame, edges: DataFrame, vertices: DataFrame, consumers: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, edges, mapped): connection points with their consumers by zone and class, the edges between these and the junctions of each zone, and its transformers.

    A zone is a component with more than one consumer; a large component is dealt
    into several by k-means of its places before any distances are taken.
    """
    components = R.connected_components(vertices.select("vertex"), edges)
    fate = C.component_clusters(components, consumers.select("vertex")).where("action <> 'drop'")
    users = consumers.join(buildings.where("peak <> 0").select(F.col("id").cast("string").alias("id"), "kind", "peak", "units"), "id")
    users = users.unionByName(mapped.select("id", "vertex", "connection"), allowMissingColumns=True).join(components, "vertex").join(fate, "component")
    place = R.cut(users.join(vertices.select(F.col("vertex").alias("connection"), "x", "y"), "connection"))
    spots = place.where("action = 'split'").select("component", F.col("connection").alias("id"), "x", "y", "parts").distinct()
    dealt = C.place_clusters(spots, "component", "parts").select("component", F.col("id").alias("connection"), "part")
    place = R.cut(place.join(dealt, ["component", "connection"], "left").withColumn("zone", F.col("cluster") + F.coalesce("part", F.lit(0))))
    of_class = E.consumer_class(F.col("kind")).alias("kind")
    points = place.where(F.col("kind").isNotNull()).groupBy("zone", "component", F.col("connection").alias("point"), of_class)
    points = R.cut(points.agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("peak").alias("power"), F.sum("units").alias("count"), F.count("*").alias("houses")))
    mapped = R.cut(place.where(F.col("kind").isNull()).select("zone", "id", "vertex"))
    ends = points.select("zone", F.col("point").alias("vertex")).union(mapped.select("zone", "vertex"))
    inner = R.cut(R.simplified(_zone_edges(points, edges, vertices, components), ends, ("zone",)))
    return points.drop("component"), inner, mapped


def supplied_by_mapped(points: DataFrame, edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """(zone, point, site, cost, load, size_kva): points of each zone that its mapped transformers serve.

    One search from all transformers at once, which ends at the longest connection.
    """
    paths = R.shortest_paths(mapped.select("zone", "vertex"), edges, C.REACH, ("zone",))
    costs = paths.select("zone", F.col("vertex").alias("consumer"), F.col("source").alias("transformer"), "cost")
    given = C.assign_to_transformers(costs, points.select("zone", F.col("point").alias("consumer"), "kind", "power", "count"), "zone")
    return given.select("zone", F.col("consumer").alias("point"), F.col("transformer").alias("site"), "cost", "load", "size_kva")


def _zone_edges(points: DataFrame, edges: DataFrame, vertices: DataFrame, components: DataFrame) -> DataFrame:
    """(zone, source, target, cost): the edges that paths of each zone may use.

    A component that is one zone gives all its edges.  Of one that is dealt into several,
    a zone has the edges with an end in the box of its points, wider by ZONE_MARGIN, so
    that searches stay local on a network as large as a country.
    """
    box = points.groupBy("component", "zone").agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("min_", F.min), ("max_", F.max))])
    several = box.groupBy("component").agg((F.count("*") > 1).alias("several"))
    place = vertices.join(components, "vertex").select(F.col("vertex").alias("end"), "component", "x", "y")
    near = F.lit(True)
    for c in ("x", "y"):
        near = near & F.col(c).between(F.col(f"min_{c}") - ZONE_MARGIN, F.col(f"max_{c}") + ZONE_MARGIN)
    inside = place.join(several, "component").join(box, "component").where(~F.col("several") | near).select("zone", "end")
    touching = [edges.join(inside.withColumnRenamed("end", c), c).select("zone", "source", "target", "cost") for c in ("source", "target")]
    return touching[0].union(touching[1]).distinct()


def generate(buildings: DataFrame, ways: DataFrame, areas: DataFrame, transformers: DataFrame | None = None) -> Networks:
    """Networks of all areas: clusters, transformer sites, and lines with their cables.

    ``transformers`` (id, x, y) are known from maps and cleaned.  They serve what is within
    reach until they are full; those that serve nothing are left out.  What is left of a
    zone is clustered, unless it is a single building of a zone with transformers.
    """
    required(ways.where(F.col("clazz") != HOUSE_CLASS), "streets")
    served = R.cut(served_buildings(buildings, areas))
    known = None if transformers is None else R.cut(mapped_transformers(transformers, served, areas))
    edges, vertices, consumers, mapped = street_graph(served, ways, transformers=known)
    required(consumers, "buildings near a street")
    points, inner, mapped = supply_zones(served, edges, vertices, consumers, mapped)
    given = R.cut(supplied_by_mapped(points, inner, mapped)) if known is not None else None

    rest = points
    if given is not None:
        rest = points.join(given, ["zone", "point"], "left_anti")
        alone = rest.groupBy("zone").agg(F.sum("houses").alias("n")).where("n <= 1").join(mapped, "zone", "left_semi").select("zone")
        rest = R.cut(rest.join(alone, "zone", "left_anti"))
    ends = R.cut(rest.select("zone", F.col("point").alias("vertex")).distinct())
    paths = R.shortest_paths(ends, inner, within=("zone",), many=True)
    costs = R.cut(paths.join(ends, ["zone", "vertex"], "left_semi").select("zone", F.col("source").alias("i"), F.col("vertex").alias("j"), "cost"))
    parts = R.cut(C.bisect_by_capacity(rest, "zone", costs=costs)).withColumn("number", F.col("cluster") + 1).drop("cluster")
    parts = parts.withColumns({"mapped": F.lit(False), "site": F.lit(None).cast("long"), "cost": F.lit(None).cast("double")})
    if given is not None:
        number = -F.dense_rank().over(Window.partitionBy("zone").orderBy("site")).cast("long")  # a zone has a bounded number of points
        parts = parts.unionByName(given.withColumns({"number": number, "mapped": F.lit(True), "size_kva": F.col("size_kva").cast("double")}))
    parts = R.cut(parts)
    names = R.numbered(parts.select("zone", "number").distinct(), ["zone", "number"], "grid")
    clusters = R.cut(parts.join(names, ["zone", "number"]).join(points.select("zone", "point", "kind", "power", "count"), ["zone", "point"]))

    ends = clusters.where("not mapped").select("zone", "grid", F.col("point").alias("i"))
    other = ends.select("zone", F.col("grid").alias("of"), F.col("i").alias("j"))
    within = costs.join(ends.distinct(), ["zone", "i"]).join(other.distinct(), ["zone", "j"]).where("grid = of").select("grid", "i", "j", "cost")
    loads = clusters.groupBy("grid", F.col("point").alias("j")).agg(F.sum("power").alias("load"))
    chosen = C.weighted_median_site(within, loads, ["grid"])
    fixed = clusters.where("mapped").groupBy("grid", "site").agg(F.sum(F.col("cost") * F.col("power")).alias("moment"))
    of_grid = clusters.select("grid", "zone", "number", "mapped", F.col("load"), "size_kva").distinct()
    sites = chosen.unionByName(fixed).join(of_grid, "grid").join(mapped.select("zone", F.col("vertex").alias("site"), F.col("id").alias("transformer")), ["zone", "site"], "left")
    sites = R.cut(sites.join(vertices.withColumnRenamed("vertex", "site"), "site").select("grid", "zone", "number", "site", "x", "y", "moment", "mapped", "transformer", "load", "size_kva"))

    houses = consumers.join(served.where("peak <> 0").select(F.col("id").cast("string").alias("id"), "kind", "peak", "units"), "id")
    houses = houses.join(edges.where(F.col("id").startswith("b/")).select(F.substring("id", 3, 1 << 30).alias("id"), "cost"), "id")
    houses = N.house_connections(houses, "id", "kind", "peak", "units", "cost").select("id", "connection", "vertex", "kind", "units", "peak", (F.col("cost") / 1000).alias("length_km"), "cable", "parallel")
    of_point = clusters.select(F.col("point").alias("connection"), "grid").distinct()
    houses = R.cut(houses.join(of_point, "connection", "left"))
    served = served.join(houses.select(F.col("id").alias("__id"), "grid"), F.col("id").cast("string") == F.col("__id"), "left").drop("__id")
    return Networks(served, edges, clusters.drop("zone", "number", "site", "cost"), sites, _lines(clusters, sites, inner), houses)


def _lines(clusters: DataFrame, sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Feeders of each grid with their cables, along paths inside its zone."""
    paths = R.shortest_paths(sites.select("zone", F.col("site").alias("vertex")).distinct(), edges, within=("zone",))
    reach = sites.select("grid", "zone", "site").join(paths.withColumnRenamed("source", "site"), ["zone", "site"])
    list_of = lambda c: F.collect_list(F.col(c).cast("double"))
    mine = clusters.groupBy("grid", F.col("point").alias("vertex")).agg(F.collect_list("kind").alias("kinds"), list_of("power").alias("powers"), list_of("count").alias("counts"))
    none = {c: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("kinds", "string"), ("powers", "double"), ("counts", "double"))}
    nodes = reach.join(mine, ["grid", "vertex"], "left").select("grid", F.col("vertex").alias("node"), F.col("via").alias("parent"), F.col("cost").alias("distance"), *none.values())
    feeders = N.lay_branches(nodes, "grid")
    first = Window.partitionBy("grid", "branch")
    feeders = feeders.withColumns({"ka": F.max("current_ka").over(first), "far": F.sum("length").over(first)})
    return N.choose_cable(feeders, "node", F.col("ka"), F.col("far")).select("grid", "branch", "nth", "node", "next", (F.col("length") / 1000).alias("length_km"), "cable", "parallel")
