"""Unions of polygons, their borders as rings, and buffers around lines.

Sides of polygons are split where they meet others, in square cells.  A piece of a side is
on the border of the union if one of its two sides is covered and the other is not: pieces
that two neighbours share in opposite directions cancel out, and pieces inside another
polygon go.  Rings are rebuilt from pieces by pointers that double their reach, so no task
holds a polygon or a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators.graph import cut
from gridloom.operators.relational import join_spread
from gridloom.operators.spatial import lines_meeting_polygons

#: Coordinates are multiples of this, and what is nearer to a side than twice this lies on it.
PRECISION = 1e-6


def _rounded(p: Column, precision: float) -> Column:
    return G.point(*[F.rint(p[a] / precision) * precision for a in ("x", "y")])


def _sides(polygons: DataFrame, ring: str, precision: float) -> DataFrame:
    """(key, pid, a, b): sides with the inside to their left, without sides of no length."""
    points = G.closed(F.transform(ring, lambda p: _rounded(p, precision)))
    cross = lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    rows = polygons.select("key", "pid", G.segments(points).alias("s")).withColumn("twice", F.aggregate("s", F.lit(0.0), cross))
    sides = rows.where("twice <> 0").select("key", "pid", (F.col("twice") > 0).alias("left"), F.explode("s").alias("s"))
    ends = [F.when(F.col("left"), F.col(f"s.{p}")).otherwise(F.col(f"s.{q}")).alias(p) for p, q in (("a", "b"), ("b", "a"))]
    return sides.where(F.col("s.a") != F.col("s.b")).select("key", "pid", *ends)


def _in_cells(lines: DataFrame, size: float, margin: float) -> DataFrame:
    """(key, id, ax, ay, bx, by, their least and greatest, ix, iy): lines in the cells that their boxes meet."""
    rows = lines.select("key", "id", *[F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    for c in ("x", "y"):
        rows = rows.withColumns({f"low{c}": F.least(f"a{c}", f"b{c}"), f"high{c}": F.greatest(f"a{c}", f"b{c}")})
    for c in ("x", "y"):
        low, high = F.col(f"low{c}") - margin, F.col(f"high{c}") + margin
        rows = rows.withColumn(f"i{c}", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    return rows


def _pieces(sides: DataFrame, cell: float, precision: float) -> DataFrame:
    """(key, pid, p, q): sides split where they meet other sides of their group."""
    lines = sides.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    lines = cut(lines.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    mine = _in_cells(lines, cell, 2 * precision)
    other = mine.select("key", "ix", "iy", *[F.col(c).alias(f"o{c}") for c in mine.columns if c not in ("key", "ix", "iy")])
    boxes = F.col("id") != F.col("oid")
    for c in ("x", "y"):
        boxes = boxes & (F.col(f"low{c}") <= F.col(f"ohigh{c}") + 2 * precision) & (F.col(f"olow{c}") <= F.col(f"high{c}") + 2 * precision)
    pairs = mine.join(other.hint("merge"), ["key", "ix", "iy"]).where(boxes)
    a, b, c, d = (F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in ("a", "b", "oa", "ob"))
    # steps of their own: Java compiles small methods only, and the condition of the join has to stay small
    at = lambda p: G.foot_fraction(a, b, p)
    pairs = pairs.withColumns({"atc": at(c), "atd": at(d)})
    on = lambda p, t: (G.distance(G.between(a, b, F.col(t)), p) <= 2 * precision) & (p != a) & (p != b)
    pairs = pairs.withColumns({"onc": on(c, "atc"), "ond": on(d, "atd"), "cross": G.segments_cross(a, b, c, d)})
    # ends of the other line that lie on this one, or else where both cross
    kinds = F.array(F.when(F.col("onc"), 1), F.when(F.col("ond"), 2), F.when(F.col("cross") & ~F.col("onc") & ~F.col("ond"), 3))
    met = pairs.select("id", *[f"{p}{e}" for p in ("a", "b", "oa", "ob") for e in "xy"], F.explode(kinds).alias("kind")).where("kind is not null")
    met = cut(met)
    # a crossing is computed from the smaller line, so that both get the same point
    ends = F.array_sort(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(c.alias("a"), d.alias("b"))))
    crossed = lambda e: G.let(G.crossing_fraction(e[0]["a"], e[0]["b"], e[1]["a"], e[1]["b"]), lambda at: _rounded(G.between(e[0]["a"], e[0]["b"], at), precision))
    found = met.select("id", a.alias("a"), b.alias("b"), F.when(F.col("kind") == 1, c).when(F.col("kind") == 2, d).otherwise(G.let(ends, crossed)).alias("p"))
    found = found.where("p <> a and p <> b")
    cuts = found.groupBy("id").agg(F.collect_set("p").alias("ps"))
    split = lines.join(cuts.hint("merge"), "id", "left")
    none = F.array().cast("array<struct<x:double,y:double>>")
    along = F.transform(F.concat(F.array("a", "b"), F.coalesce("ps", none)), lambda p: F.struct(G.foot_fraction(F.col("a"), F.col("b"), p).alias("at"), p.alias("p")))
    parts = split.select("key", "a", "b", F.explode(G.segments(F.transform(F.array_sort(along), lambda x: x["p"]))).alias("s"))
    parts = cut(parts.select("key", "a", "b", F.col("s.a").alias("p"), F.col("s.b").alias("q")).where("p <> q"))
    back = sides.select("key", "pid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") > F.col("b")).alias("back"))
    ends = [F.when(F.col("back"), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("q", "p"), ("p", "q"))]
    return back.join(parts, ["key", "a", "b"]).select("key", "pid", *ends)


def border(polygons: DataFrame, key: str, ring: str = "ring", cell: float = 100.0, precision: float = PRECISION) -> DataFrame:
    """(key, px, py, qx, qy): the directed pieces of the border of each group's union, with the inside to their left.

    ``polygons`` has the key and a simple ring; rings without area count as nothing.
    """
    rows = polygons.where(F.col(ring).isNotNull()).groupBy(F.col(key).alias("key"), F.col(ring).alias("ring")).agg(F.count("*").alias("n"))
    rows = cut(rows.select("key", "ring", F.xxhash64(F.to_json(F.struct("key", "ring"))).alias("pid")))
    pieces = cut(_pieces(cut(_sides(rows, "ring", precision)), cell, precision))
    low, high = F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")
    forth = pieces.select("key", "pid", low, high, (F.col("p") < F.col("q")).alias("forth"))
    # pieces of opposite directions have the union on both sides
    pids = [F.min("pid").alias("one"), F.max("pid").alias("two"), F.count("*").alias("n")]
    single = forth.groupBy("key", "low", "high").agg(F.min("forth").alias("least"), F.max("forth").alias("most"), *pids).where("least = most")
    middle = G.between(F.col("low"), F.col("high"), F.lit(0.5))
    single = cut(single.withColumns({"mx": middle["x"], "my": middle["y"], "id": F.monotonically_increasing_id()}))
    boxes = rows
    for c in ("x", "y"):
        ends = [f(F.transform("ring", lambda p: p[c])) for f in (F.array_min, F.array_max)]  # noqa: B023
        boxes = boxes.withColumns({f"low{c}": ends[0], f"high{c}": ends[1]})
    boxes = cut(boxes)
    for c in ("x", "y"):
        boxes = boxes.withColumn(f"c{c}", F.explode(F.sequence(*[F.floor(F.col(f"{e}{c}") / cell).cast("long") for e in ("low", "high")])))
    at = single.withColumns({f"c{c}": F.floor(F.col(f"m{c}") / cell).cast("long") for c in ("x", "y")})
    inside = (F.col("pid") != F.col("one")) & (F.col("pid") != F.col("two"))  # its own rings do not cover a piece
    for c in ("x", "y"):
        inside = inside & (F.col(f"low{c}") <= F.col(f"m{c}")) & (F.col(f"m{c}") <= F.col(f"high{c}"))
    near = at.select("id", "key", "low", "high", "n", "one", "two", "mx", "my", "cx", "cy").join(boxes.hint("merge"), ["key", "cx", "cy"]).where(inside)
    around = cut(near.where(G.contains(F.col("ring"), G.point(F.col("mx"), F.col("my")))).select("id", "key", "low", "high", "n", "pid"))
    many = around.where("n > 2").join(forth.select("key", "low", "high", "pid").hint("merge"), ["key", "low", "high", "pid"], "left_anti")
    covered = around.where("n <= 2").select("id").unionByName(many.select("id")).distinct()
    kept = single.join(covered.hint("merge"), "id", "left_anti")
    ends = [F.when(F.col("most"), F.col(x)).otherwise(F.col(y)) for x, y in (("low", "high"), ("high", "low"))]
    return cut(kept.select(F.col("key").alias(key), *[e[c].alias(f"{n}{c}") for n, e in zip("pq", ends, strict=True) for c in ("x", "y")]))


def measures(pieces: DataFrame, key: str) -> DataFrame:
    """(key, area, length) of the unions whose borders ``pieces`` are; holes have no area."""
    area = F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2
    return pieces.groupBy(key).agg(area.alias("area"), F.sum(F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy"))).alias("length"))


def rings(pieces: DataFrame, key: str) -> DataFrame:
    """(key, ring, nth, x, y): the corners of every ring of a border, in order; outer rings run counter-clockwise, holes clockwise.

    Where borders touch in a point, rings stay apart.  Corners on a straight line are left
    out.  A ring is named by its least corner, and starts after it.
    """
    name = F.xxhash64(F.to_json(F.struct(key, "px", "py", "qx", "qy")))
    edges = cut(pieces.withColumn("id", name))
    follows = edges.select(key, F.col("id").alias("next"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qx").alias("rx"), F.col("qy").alias("ry"))
    back = F.atan2(F.col("py") - F.col("qy"), F.col("px") - F.col("qx"))
    turn = F.pmod(back - F.atan2(F.col("ry") - F.col("qy"), F.col("rx") - F.col("qx")) - 1e-12, F.lit(2 * math.pi))
    straight = F.abs((F.col("qx") - F.col("px")) * (F.col("ry") - F.col("qy")) - (F.col("qy") - F.col("py")) * (F.col("rx") - F.col("qx"))) <= PRECISION * F.hypot(F.col("rx") - F.col("px"), F.col("ry") - F.col("py"))
    at = Window.partitionBy("id").orderBy("turn", "next")
    ways = edges.join(follows, [key, "qx", "qy"]).withColumns({"turn": turn, "corner": ~straight}).withColumn("nth", F.row_number().over(at)).where("nth = 1")
    ways = cut(ways.select("id", "next", "corner", F.col("qx").alias("x"), F.col("qy").alias("y"), key))
    # the least corner of each ring: pointers double their reach until nothing falls
    place = F.struct("x", "y", F.col("id").alias("edge"))
    step = cut(ways.select("id", "next", place.alias("least")))
    while True:
        ahead = step.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("least").alias("other"))
        new = cut(join_spread(step, ahead, ["next"]).select("id", F.col("further").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("fell")))
        step = new.drop("fell")
        if new.where("fell").isEmpty():
            break
    named = cut(ways.join(step.select("id", F.col("least.edge").alias("ring")), "id"))
    # how many pieces each is from the one that ends in the least corner
    last = cut(named.select("id", F.when(F.col("id") != F.col("ring"), F.col("next")).alias("to"), F.when(F.col("id") != F.col("ring"), 1).otherwise(0).cast("long").alias("far")))
    while not last.where("to is not null").isEmpty():
        ahead = last.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("far").alias("more"))
        last = cut(join_spread(last, ahead, ["to"], "left").select("id", F.col("further").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0).cast("long"))).alias("far")))
    corners = named.join(last.select("id", "far"), "id").where("corner")
    nth = F.row_number().over(Window.partitionBy("ring").orderBy(F.desc("far")))
    return corners.select(key, "ring", nth.alias("nth"), "x", "y")


def dissolve(polygons: DataFrame, key: str, ring: str = "ring", cell: float = 100.0) -> DataFrame:
    """(key, ring, nth, x, y): the union of each group's polygons as the corners of its rings."""
    return rings(border(polygons, key, ring, cell), key)


def capsules(lines: DataFrame, line: str, radius: float, sides: int = 16) -> DataFrame:
    """``lines`` with ``capsule``: around each of their segments the ring of what is within ``radius``, with round ends of ``sides`` / 2 sides."""
    rows = lines.withColumn("__s", F.explode(G.segments(F.col(line))))
    a, b = F.col("__s.a"), F.col("__s.b")
    theta = F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    half = sides // 2

    def end(centre: Column, start: float) -> Column:
        angle = lambda i: theta + (i / half - 0.5) * math.pi + start
        return F.transform(F.sequence(F.lit(0), F.lit(half)), lambda i: G.point(centre["x"] + F.cos(angle(i)) * radius, centre["y"] + F.sin(angle(i)) * radius))

    return rows.withColumn("capsule", F.concat(end(b, 0.0), end(a, math.pi))).drop("__s")


def buffered(lines: DataFrame, key: str, line: str, radius: float, sides: int = 16, cell: float = 100.0, around: str | None = None) -> DataFrame:
    """(key, px, py, qx, qy): the border of what is within ``radius`` of each group's lines, with round joins.

    ``around`` names a ring column: then ``line`` is its outline, and the inside counts as well.
    """
    parts = capsules(lines, line, radius, sides).select(key, F.col("capsule").alias("ring"))
    if around is not None:
        parts = parts.unionByName(lines.select(key, F.col(around).alias("ring")))
    return border(parts, key, "ring", cell)


def lines_near_polygons(lines: DataFrame, line: str, polygons: DataFrame, ring: str, radius: float, id_columns: tuple[str, str], cell: float = 1000.0) -> DataFrame:
    """The pairs of ids of a line and a polygon that come within ``radius`` of each other: the part of a network around an area.

    A line meets the polygon or one of the capsules around its sides; these are not united.
    """
    mine, its = id_columns
    outline = polygons.select(its, G.closed(F.col(ring)).alias("__outline"), F.col(ring).alias("__ring"))
    parts = capsules(outline.select(its, "__outline"), "__outline", radius).select(its, F.col("capsule").alias("__ring")).unionByName(outline.select(its, "__ring"))
    return lines_meeting_polygons(lines.select(mine, line), parts, line, "__ring", cell).select(mine, its).distinct()
