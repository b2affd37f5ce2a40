"""Spatial joins on square cells.

A distance or containment predicate alone would make Spark compare every pair.  Both
sides are bucketed into square cells instead: one side is copied into the cells
around its own, the join is an equality of cells, and the exact predicate follows.
Work then grows with the number of neighbours and not with the square of a table.
A side that is copied into cells is many times larger than the files it comes from, by
which Spark would choose to broadcast it; such joins are named as merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators.staging import cut


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _around(value: Column, size: float, radius: float) -> Column:
    return F.explode(F.sequence(_cell(value - radius, size), _cell(value + radius, size)))


def within_distance(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str], strict: bool = False) -> DataFrame:
    """All pairs of rows at most ``radius`` apart, with their ``distance``.

    Column names of the two sides must differ.
    """
    size = float(radius)
    (lx, ly), (rx, ry) = left_xy, right_xy
    here = left.withColumns({"__cx": _cell(F.col(lx), size), "__cy": _cell(F.col(ly), size)})
    there = right.withColumn("__cx", _around(F.col(rx), size, radius)).withColumn("__cy", _around(F.col(ry), size, radius))
    d = F.hypot((F.col(lx) - F.col(rx)).cast("double"), (F.col(ly) - F.col(ry)).cast("double"))
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    near = dx * dx + dy * dy <= size * size * (1 + 1e-9)  # cheaper than the distance
    pairs = here.join(there.hint("merge"), ["__cx", "__cy"]).where(near).withColumn("distance", d)
    return pairs.where(F.col("distance") < radius if strict else F.col("distance") <= radius).drop("__cx", "__cy")


def pairs_within(points: DataFrame, radius: float, id_column: str, xy: tuple[str, str], strict: bool = False) -> DataFrame:
    """(a, b, distance): all pairs a < b of rows of one table at most ``radius`` apart; ids are unique.

    Cells are half as wide as the radius, and a row is copied only into its own cell and
    those after it, so each pair is met once.
    """
    size = radius / 2
    rows = points.select(F.col(id_column).alias("p"), F.col(xy[0]).alias("px"), F.col(xy[1]).alias("py"))
    rows = rows.withColumns({"cx": _cell(F.col("px"), size), "cy": _cell(F.col("py"), size)})
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) >= (0, 0)]
    offset = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead]))
    copies = rows.select(F.col("p").alias("q"), F.col("px").alias("qx"), F.col("py").alias("qy"), "cx", "cy", offset.alias("o"))
    copies = copies.select("q", "qx", "qy", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("o.i") + F.abs("o.j") == 0).alias("own"))
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    near = dx * dx + dy * dy <= radius * radius * (1 + 1e-9)  # cheaper than the distance
    met = rows.join(copies.hint("merge"), ["cx", "cy"]).where(near & (~F.col("own") | (F.col("p") < F.col("q"))))
    out = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.hypot(dx.cast("double"), dy.cast("double")).alias("distance"))
    return out.where(F.col("distance") < radius if strict else F.col("distance") <= radius)


#: Sizes of cells that a search for neighbours chooses from: each is twice the one before, the largest holds all.
LEVELS = 20


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], within: tuple[str, str] | None = None, others: bool = False) -> DataFrame:
    """The k rows of ``right`` nearest to each row of ``left``, with ``distance`` and ``nth``.

    ``within`` names a column of each side that must be equal, such as an area; ``others``
    leaves out rows whose ids are equal.  Ties go to the smaller ``right_id``.

    Rows of ``right`` are counted in square cells of LEVELS sizes.  Each row of ``left`` takes
    the smallest of its cells that holds enough of them: all it looks for lies within that
    cell's diagonal.  So the reach follows the density around each row, and a row far from
    all others meets few.  A row whose cells all hold too few meets all of its area, fewer than
    k rows.  Ids of ``left`` are unique; rows without coordinates or area find nothing.
    """
    box = lambda df, xy: df.agg(*[f(c).cast("double") for c in xy for f in (F.min, F.max)]).first()
    both = [v for v in zip(box(left, left_xy), box(right, right_xy), strict=True)]
    known = [[v for v in pair if v is not None] for pair in both]
    low = [min(known[i], default=0.0) for i in (0, 2)]
    span = max(max(known[i + 1], default=0.0) - min(known[i], default=0.0) for i in (0, 2)) or 1.0
    sizes = [span * (1 + 1e-9) / 2 ** (LEVELS - 1 - i) for i in range(LEVELS)]
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("__l") + 1)
    cell = lambda c, start, shift=0.0: F.floor((F.col(c) - start + shift) / size).cast("long")
    group = [] if within is None else ["__g"]
    tagged = lambda df, i: df if within is None else df.withColumn("__g", F.col(within[i]))
    finest = lambda xy: {n: F.floor((F.col(c) - start) / sizes[0]).cast("long") for n, c, start in zip(("__cx", "__cy"), xy, low, strict=True)}

    def at_levels(df: DataFrame, chosen: list[int]) -> DataFrame:
        """Rows of smallest cells once for each of the chosen sizes."""
        rows = df.withColumn("__l", F.explode(F.array(*[F.lit(i) for i in chosen])))
        return rows.withColumns({c: F.expr(f"shiftright({c}, __l)") for c in ("__cx", "__cy")})

    keys = [*group, "__l", "__cx", "__cy"]
    occupied = tagged(right, 1).select(*group, *right_xy).withColumns(finest(right_xy)).groupBy(*group, "__cx", "__cy").agg(F.count("*").alias("__n"))
    enough = at_levels(occupied, list(range(LEVELS))).groupBy(*keys).agg(F.sum("__n").alias("__n")).where(F.col("__n") >= k + int(others)).select(*keys)
    places = tagged(left, 0).select(left_id, *group, *left_xy).withColumns(finest(left_xy))
    fitting = at_levels(places, list(range(LEVELS))).join(enough.hint("merge"), keys).groupBy(left_id).agg(F.min("__l").alias("__l"))
    todo = cut(tagged(left, 0).join(fitting.hint("merge"), left_id, "left").withColumn("__l", F.coalesce("__l", F.lit(LEVELS - 1))))
    used = sorted(r["__l"] for r in todo.select("__l").distinct().collect())  # LEVELS at most
    reach = size * 2**0.5
    for axis, c, start in (("__cx", left_xy[0], low[0]), ("__cy", left_xy[1], low[1])):
        todo = todo.withColumn(axis, F.explode(F.sequence(cell(c, start, -reach), cell(c, start, reach))))
    pairs = todo.join(at_levels(tagged(right, 1).withColumns(finest(right_xy)), used or [0]).hint("merge"), keys)
    if others:
        pairs = pairs.where(F.col(left_id) != F.col(right_id))
    (lx, ly), (rx, ry) = left_xy, right_xy
    d = F.hypot((F.col(lx) - F.col(rx)).cast("double"), (F.col(ly) - F.col(ry)).cast("double"))
    order = Window.partitionBy(left_id).orderBy("distance", right_id)
    pairs = pairs.withColumn("distance", d).where((F.col("distance") <= reach * (1 + 1e-9)) | (F.col("__l") == LEVELS - 1))
    found = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return found.drop(*keys)


def nearest_lines(points: DataFrame, lines: DataFrame, radius: float, most: float, point_id: str, line_id: str, xy: tuple[str, str], line: str, least: float = 0.0) -> DataFrame:
    """(point, line, distance, at): the line nearest to each point, farther than ``least`` and within ``most``.

    ``at`` is the fraction of the line's length nearest to the point.  Segments are
    put into the cells that they pass, and points look around; the radius grows
    until all have found a line or ``most`` is reached.
    """
    out, todo, radius = None, points.select(F.col(point_id), *xy), min(radius, most)
    while True:
        parts = lines.select(F.col(line_id), F.col(line).alias("__line"), F.explode(G.segments(F.col(line))).alias("__s"))
        for axis in ("x", "y"):
            low, high = F.least(f"__s.a.{axis}", f"__s.b.{axis}"), F.greatest(f"__s.a.{axis}", f"__s.b.{axis}")
            parts = parts.withColumn(f"__c{axis}", F.explode(F.sequence(_cell(low, radius), _cell(high, radius))))
        around = todo
        for axis, c in zip(("x", "y"), xy, strict=True):
            around = around.withColumn(f"__c{axis}", _around(F.col(c), radius, radius))
        p = G.point(F.col(xy[0]), F.col(xy[1]))
        found = around.join(parts, ["__cx", "__cy"]).select(point_id, line_id, "__line", p.alias("__p"), G.distance_to_line(F.array("__s.a", "__s.b"), p).alias("distance"))
        found = found.where(F.col("distance") <= radius)
        # the distance of a line is that of its nearest segment: others of a line that is too near do not count
        whole = found.groupBy(point_id, line_id).agg(F.min("distance").alias("distance"), F.any_value("__line").alias("__line"), F.any_value("__p").alias("__p"))
        best = whole.where(F.col("distance") > least).groupBy(point_id).agg(F.min_by(F.struct(line_id, "__line", "__p", "distance"), F.struct("distance", line_id)).alias("m"))
        best = best.select(point_id, F.col(f"m.{line_id}").alias(line_id), F.col("m.distance").alias("distance"), G.locate(F.col("m.__line"), F.col("m.__p")).alias("at"))
        out = best if out is None else out.unionByName(best)
        if radius >= most:
            return out
        todo = todo.join(best.select(point_id), point_id, "left_anti")
        if todo.isEmpty():
            return out
        radius = min(most, radius * 4)


def points_in_polygons(points: DataFrame, polygons: DataFrame, xy: tuple[str, str], ring: str, size: float) -> DataFrame:
    """All pairs of a point and a polygon around it.

    Polygons are copied into the cells that their bounding box meets, so neither
    side is broadcast.
    """
    boxes = polygons
    for axis in ("x", "y"):
        ends = F.transform(F.col(ring), lambda p: p[axis])  # noqa: B023
        boxes = boxes.withColumns({f"__low{axis}": F.array_min(ends), f"__high{axis}": F.array_max(ends)})
    for axis in ("x", "y"):
        boxes = boxes.withColumn(f"__c{axis}", F.explode(F.sequence(_cell(F.col(f"__low{axis}"), size), _cell(F.col(f"__high{axis}"), size))))
    cells = points.withColumns({"__cx": _cell(F.col(xy[0]), size), "__cy": _cell(F.col(xy[1]), size)})
    inside = F.lit(True)
    for axis, c in zip(("x", "y"), xy, strict=True):  # the box first, as it is cheaper than the ring
        inside = inside & F.col(c).between(F.col(f"__low{axis}"), F.col(f"__high{axis}"))
    met = cells.join(boxes, ["__cx", "__cy"]).where(inside & G.contains(F.col(ring), G.point(F.col(xy[0]), F.col(xy[1]))))
    return met.drop("__cx", "__cy", *[f"__{n}{axis}" for n in ("low", "high") for axis in ("x", "y")])


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, line: str, ring: str, size: float = 1000.0) -> DataFrame:
    """Pairs of a line and a polygon that it enters or crosses.

    Both are copied into the cells that their boxes meet.  A pair counts in one cell
    only: the first that both boxes have.
    """
    low = lambda c, axis: F.array_min(F.transform(F.col(c), lambda p: p[axis]))
    high = lambda c, axis: F.array_max(F.transform(F.col(c), lambda p: p[axis]))
    first = F.lit(True)
    for axis in ("x", "y"):
        cells = lambda c: F.explode(F.sequence(_cell(low(c, axis), size), _cell(high(c, axis), size)))  # noqa: B023, E731
        lines, polygons = lines.withColumn(f"__c{axis}", cells(line)), polygons.withColumn(f"__c{axis}", cells(ring))
        first = first & (F.col(f"__c{axis}") == F.greatest(_cell(low(line, axis), size), _cell(low(ring, axis), size)))
    met = lines.join(polygons, ["__cx", "__cy"]).where(first & G.line_meets_ring(F.col(line), F.col(ring)))
    return met.drop("__cx", "__cy")


#: Rings with equal borders that are dealt into one part when their pairs are listed.
COPIES = 512


def touching(rings: DataFrame, id_column: str, ring: str, tolerance: float = 0.01, size: float = 50.0) -> DataFrame:
    """Pairs (a, b), a < b, of rings whose borders come within the tolerance of each other.

    Borders are compared once for all ids that have the same.  Sides are put into the cells
    that their boxes, wider by the tolerance, meet; pairs of ids follow from pairs of borders.
    """
    shape = F.sort_array(F.collect_set(ring))  # an id may have several rings
    of = cut(rings.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(shape.alias("shape")))
    shapes = cut(of.groupBy("shape").agg(F.min("id").alias("a"), F.ceil(F.count("*") / COPIES).cast("int").alias("n")))
    sides = shapes.select("a", "n", F.explode("shape").alias("r")).select("a", "n", F.explode(G.segments(G.closed(F.col("r")))).alias("s"))
    for axis in ("x", "y"):
        low, high = F.least(f"s.a.{axis}", f"s.b.{axis}") - tolerance, F.greatest(f"s.a.{axis}", f"s.b.{axis}") + tolerance
        sides = sides.withColumns({f"low{axis}": low, f"high{axis}": high}).withColumn(f"c{axis}", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    other = sides.select("cx", "cy", F.col("a").alias("b"), F.col("n").alias("m"), F.col("s").alias("o"), *[F.col(c).alias(f"o{c}") for c in ("lowx", "highx", "lowy", "highy")])
    p, q, u, v = (F.col(c) for c in ("s.a", "s.b", "o.a", "o.b"))
    near = lambda x, y, at: G.distance(G.between(x, y, G.foot_fraction(x, y, at)), at) <= tolerance
    meet = G.segments_cross(p, q, u, v) | near(p, q, u) | near(p, q, v) | near(u, v, p) | near(u, v, q)
    boxes = (F.col("lowx") <= F.col("ohighx")) & (F.col("olowx") <= F.col("highx")) & (F.col("lowy") <= F.col("ohighy")) & (F.col("olowy") <= F.col("highy"))
    met = cut(sides.join(other.hint("merge"), ["cx", "cy"]).where((F.col("a") <= F.col("b")) & boxes & meet).select("a", "b", "n", "m").distinct())
    # members of large groups are dealt into parts, so that no task lists all pairs of a group
    members = of.join(shapes.select("shape", F.col("a").alias("of"), "n").hint("merge"), "shape").select("id", "of", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"))
    members = cut(members)
    parts = met.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "m").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    left = parts.where("a < b or i <= j").join(members.select(F.col("of").alias("a"), F.col("part").alias("i"), F.col("id").alias("p")).hint("merge"), ["a", "i"])
    both = left.join(members.select(F.col("of").alias("b"), F.col("part").alias("j"), F.col("id").alias("q")).hint("merge"), ["b", "j"])
    both = both.where((F.col("a") < F.col("b")) | (F.col("i") < F.col("j")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def convex_hull(points: DataFrame, key: str, xy: tuple[str, str]) -> DataFrame:
    """The corners of the convex hull of every group, counter-clockwise: key, ``nth``, x and y.

    A first pass keeps, of each group, only points that are extreme in one of 64
    directions or outside the polygon that these span; the hull of what is left is
    small and is the hull of all.
    """
    import numpy as np
    import pandas as pd

    x, y = xy
    angles = [2 * np.pi * i / 64 for i in range(64)]
    along = [F.col(x) * F.lit(float(np.cos(a))) + F.col(y) * F.lit(float(np.sin(a))) for a in angles]
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    extreme = rows.groupBy(key).agg(F.array(*[F.max_by(F.struct("x", "y"), a) for a in along]).alias("ring"))
    ring = F.array_distinct("ring")
    outside = rows.join(extreme.select(F.col(key).alias("__key"), ring.alias("ring")), F.col(key) == F.col("__key")).where(
        ~G.contains(F.col("ring"), F.struct("x", "y")) | F.array_contains("ring", F.struct("x", "y"))
    )

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        p = sorted(zip(group["x"], group["y"], strict=True))
        chain = []
        for side in (p, p[::-1]):
            part: list = []
            for q in side:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(q)
            chain += part[:-1] if len(p) > 1 else part[: 1 - len(chain)]
        return pd.DataFrame({key: group[key].iloc[0], "nth": range(len(chain)), "x": [q[0] for q in chain], "y": [q[1] for q in chain]})

    kind = dict(points.dtypes)[key]
    return outside.select(key, "x", "y").groupBy(key).applyInPandas(hull, f"{key} {kind}, nth long, x double, y double")
