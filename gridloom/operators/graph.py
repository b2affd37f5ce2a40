"""Graph operators on edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators.relational import join_spread
from gridloom.operators.spatial import within_distance
from gridloom.operators.staging import cut, shared_dir  # noqa: F401 (part of this module's interface)


def topology(lines: DataFrame, id_column: str, line: str, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): line ends within ``tolerance`` of each other become one numbered vertex.

    Edges have id, source, target and cost (the line's length).  Ends meet through others
    between them: a vertex is a component of the links of at most the tolerance.  It lies
    at the least of its ends by x, then y.  Vertices are numbered by x, then y, to the
    nearest multiple of the tolerance.
    """
    end = lambda i: F.element_at(line, i)
    ends = lines.select(F.col(id_column).alias("id"), G.length(F.col(line)).alias("cost"), *[end(i)[a].alias(f"{n}{a}") for i, n in ((1, "s"), (-1, "t")) for a in ("x", "y")])
    spots = cut(numbered(ends.select(F.col("sx").alias("x"), F.col("sy").alias("y")).union(ends.select("tx", "ty")).distinct(), ["x", "y"], "spot"))
    other = spots.select(F.col("spot").alias("target"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    # a little more than the tolerance, as ends exactly that far apart shall meet whatever their rounding
    links = cut(within_distance(spots.withColumnRenamed("spot", "source"), other, tolerance * (1 + 1e-9), ("x", "y"), ("ox", "oy")).where("source < target").select("source", "target"))
    met = links.select(F.col("source").alias("vertex")).union(links.select("target")).distinct()
    joined = connected_components(met, links).select(F.col("vertex").alias("spot"), "component")  # only ends that have others near
    placed = cut(spots.join(joined, "spot", "left").withColumn("component", F.coalesce("component", "spot")))
    near = {f"r{a}": F.floor(F.col(f"v{a}") / tolerance + 0.5) for a in ("x", "y")}
    first = placed.where("spot = component").select("component", F.col("x").alias("vx"), F.col("y").alias("vy")).withColumns(near)
    first = numbered(first, ["rx", "ry", "component"], "vertex")
    vertices = cut(placed.join(first, "component").select("x", "y", "vertex", "vx", "vy"))
    edges = ends
    for n, name in (("s", "source"), ("t", "target")):
        edges = edges.join(vertices.select(F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("vertex").alias(name)), [f"{n}x", f"{n}y"])
    return edges.select("id", "source", "target", "cost"), first.select("vertex", F.col("vx").alias("x"), F.col("vy").alias("y"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Rows numbered from ``start`` in ``order``, without sorting them in one task.

    Rows are dealt into value ranges; each range starts where the ones before end.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(*order)
    return dealt.withColumn("__at", F.row_number().over(inside)).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__at") + (start - 1)).drop("__range", "__at", "__start")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component): a component is named by its smallest vertex.

    ``vertices`` has column vertex, ``edges`` has source and target.  Each round maps
    every vertex to the neighbour that comes first in an order by hashes, follows the
    pointer once, and contracts.  In that order long roads shrink by a share of their
    length in each round, however their vertices are numbered; members of a large
    component, which point to one vertex, are not gathered.  The maps of the rounds, each
    smaller than the one before, are put together at the end.
    """
    links = cut(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a < b").distinct())
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        first = F.least(*[F.min(F.struct(F.xxhash64(c), F.col(c).alias("v"))) for c in ("a", "b")])
        near = cut(both.groupBy(F.col("a").alias("v")).agg(first.alias("f")).select("v", F.col("f.v").alias("to")))
        step = cut(join_spread(near, near.select(F.col("v").alias("to"), F.col("to").alias("further")), ["to"]).select("v", F.col("further").alias("to")))
        steps.append(step)
        moved = cut(join_spread(links, step.select(F.col("v").alias("a"), F.col("to").alias("to_a")), ["a"]))
        moved = join_spread(moved, step.select(F.col("v").alias("b"), F.col("to").alias("to_b")), ["b"])
        links = cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a < b").distinct())
    names = vertices.select("vertex", F.col("vertex").alias("component"))
    if steps:
        last = steps.pop()
        while steps:
            step = steps.pop()
            further = last.select(F.col("v").alias("to"), F.col("to").alias("end"))
            last = cut(join_spread(step, further, ["to"], "left").select("v", F.coalesce("end", "to").alias("to")))
        names = cut(names.join(last.select(F.col("v").alias("component"), "to"), "component", "left").select("vertex", F.coalesce("to", "component").alias("component")))
    least = names.groupBy("component").agg(F.min("vertex").alias("least"))
    return join_spread(names, least, ["component"]).select("vertex", F.col("least").alias("component"))


def reachable(seeds: DataFrame, edges: DataFrame, admits: Column | None = None) -> DataFrame:
    """The vertices reached from ``seeds`` along edges in either direction: a fixpoint by frontiers.

    ``admits`` restricts the edges (source to target) that may be followed.
    """
    both = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).union(edges.select("target", "source")).distinct()
    if admits is not None:
        both = both.where(admits)
    both = cut(both)
    found = frontier = cut(seeds.select("vertex").distinct())
    while not frontier.isEmpty():
        frontier = cut(frontier.join(both, F.col("vertex") == F.col("s")).select(F.col("t").alias("vertex")).distinct().join(found, "vertex", "left_anti"))
        found = found.union(frontier)
    return found


#: Contraction ends when a round takes less than one in so many of the vertices that are left.
WORTH = 8
#: Rounds of a search after which the rows that have changed are merged.
MERGED_AFTER = 8


def shortest_paths(sources: DataFrame, edges: DataFrame, limit: float | None = None, within: tuple[str, ...] = (), many: bool = False) -> DataFrame:
    """(within..., source, vertex, cost, via): cheapest undirected paths from every source.

    ``within`` names columns of both tables, such as an area: paths use the edges of
    their source's area only.  With ``limit`` only costs below it are given.
    ``via`` is the vertex before on the path, the smallest of equals.

    Vertices with at most two neighbours are taken out first, in rounds of such as are not
    neighbours of each other; what is left is searched, and they are put back in reverse.
    So a road of n vertices takes log n rounds, not n, and the search itself sees
    junctions only.  Sources stay unless there are ``many``, a large share of the vertices:
    then they are taken out as well, paths also start at what they were linked to, and
    are put back as sources too.
    """
    core = _cheapest(_directed(edges, within), within)
    starts = cut(sources.select(*within, F.col("vertex").alias("u")).distinct())
    core, taken = contracted(core, starts, within, many)
    begin = starts
    for _, up in taken if many else ():
        begin = begin.union(up.where("need").select(*within, F.col("w").alias("u")))
    if many and taken:
        gone = reduce(DataFrame.union, [up.select(*within, "u") for _, up in taken])
        begin = cut(begin.distinct().join(gone, [*within, "u"], "left_anti"))
    found = _searched(begin, core, limit, within)
    below = lambda rows: rows if limit is None else rows.where(F.col("cost") < limit)
    for down, up in reversed(taken):
        new = found.join(down, (found["vertex"] == down["w"]) & _same(found, down, within)).select(
            *[found[c] for c in within], "source", F.col("u").alias("vertex"), (F.col("cost") + F.col("c")).alias("cost"), down["via"].alias("via")
        )
        found = cut(found.unionByName(_least_cost(below(new), within)))
        if many:
            up = up.where("need").withColumnRenamed("via", "last")
            new = found.join(up, (found["source"] == up["w"]) & _same(found, up, within)).where("vertex <> u").select(
                *[found[c] for c in within], F.col("u").alias("source"), "vertex", (F.col("cost") + F.col("c")).alias("cost"), F.coalesce("via", "last").alias("via")
            )
            own = up.select(*within, F.col("u").alias("source"), F.col("u").alias("vertex"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via")).distinct()
            found = cut(found.unionByName(_least_cost(below(new), within)).unionByName(own))
    if many and taken:
        found = found.join(starts.withColumnRenamed("u", "source"), [*within, "source"], "left_semi")
    return found


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    return reduce(lambda x, c: x & (a[c] == b[c]), columns, F.lit(True))


def _cheapest(directed: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """One edge (u, w, c, via) for each pair: the cheapest, then with the smallest ``via``, which is the vertex before w."""
    best = directed.groupBy(*within, "u", "w").agg(F.min(F.struct("c", "via")).alias("e"))
    return cut(best.select(*within, "u", "w", "e.c", "e.via"))


def _least_cost(rows: DataFrame, within: tuple[str, ...]) -> DataFrame:
    best = rows.groupBy(*within, "source", "vertex").agg(F.min(F.struct("cost", "via")).alias("b"))
    return best.select(*within, "source", "vertex", "b.cost", "b.via")


def contracted(edges: DataFrame, starts: DataFrame, within: tuple[str, ...] = (), also_starts: bool = False) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(edges, taken): what is left of (within..., u, w, c, via), both directions, and what each round took out.

    A round takes vertices with one or two neighbours that have no edge without length and
    come first by a hash among such neighbours; ``starts`` (within..., u) stay unless
    ``also_starts``.  One with two neighbours leaves an edge between them.  Each of ``taken``
    is (down, up): how u, taken out, is reached from each of its neighbours w at that time,
    and how w is from u.  In ``up``, ``need`` marks starts and what starts before were linked to.

    Inside, an edge also has ``back``, the vertex before u on the way from w, so a vertex
    that goes knows all that its neighbours need.  A round writes two tables.
    """
    keys, taken = [*within, "u"], []
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(taken))), F.col(c))
    as_w = lambda rows: rows.select(*within, F.col("u").alias("w"))
    own = Window.partitionBy(*keys)
    edges = edges.join(starts.select(*keys, F.lit(True).alias("need")), keys, "left").withColumn("need", F.col("need").isNotNull())
    turned = edges.select(*within, F.col("u").alias("w"), F.col("w").alias("u"), F.col("via").alias("back"))
    edges = edges.join(turned, [*keys, "w"])
    while True:
        # an edge of no length stays, or pointers to the vertex before could close a circle
        few = (F.count("w").over(own) <= 2) & (F.min("c").over(own) > 0)
        need, side = F.max("need").over(own), F.when(F.col("w").isNotNull(), F.struct("w", "c", "via", "back"))
        judged = edges.withColumns({"need": need, "open": few if also_starts else few & ~need, "a": F.min(side).over(own), "b": F.max(side).over(own)})
        judged = judged.where("w IS NOT NULL").withColumn("first", F.col("w") == F.col("a.w"))
        judged = cut(judged.withColumns({n: F.when(F.col("open") & F.col("first"), F.col(n)) for n in ("a", "b")}))
        edges = judged.select(*keys, "w", "c", "via", "back", "need")
        counts = judged.where("first").agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
        if counts["open"] * WORTH < counts["n"] or not counts["open"]:
            return edges.drop("need", "back"), taken
        open_ = judged.where("open")
        beaten = open_.where(order("w") < order("u")).select(*keys, "w").join(as_w(open_.where("first")), [*within, "w"], "left_semi").select(*keys)
        # a vertex that goes has two edges at most, and its neighbours stay
        gone = cut(open_.where("first").join(beaten, keys, "left_anti").select(*keys, "a", "b", "need"))
        both = F.col("a.w") != F.col("b.w")
        side = gone.select(*keys, "need", F.explode(F.when(both, F.array("a", "b")).otherwise(F.array("a"))).alias("s"))
        down = side.select(*keys, "s.w", "s.c", F.col("s.back").alias("via"))
        up = side.select(*keys, "s.w", "s.c", "s.via", "need")
        turns = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        through = gone.where(both).select(*within, "need", F.explode(turns).alias("p"))
        through = through.select(*within, F.col("p.a.w").alias("u"), F.col("p.b.w").alias("w"), (F.col("p.a.c") + F.col("p.b.c")).alias("c"), F.col("p.b.via").alias("via"), F.col("p.a.via").alias("back"), "need")
        # rows without w note who is needed, as the edges of a vertex may all go: starts, and neighbours of those that go
        values = ["w", "c", "via", "back"]
        noted = up.where("need").select(*within, F.col("w").alias("u"), *[F.lit(None).cast(t).alias(c) for c, t in edges.dtypes if c in values], "need")
        rest = edges.join(gone.select(*keys), keys, "left_anti").join(as_w(gone).withColumn("goes", F.lit(True)), [*within, "w"], "left")
        rest = rest.where("goes IS NULL OR need").select(*keys, *[F.when(F.col("goes").isNull(), F.col(c)).alias(c) for c in values], "need")
        best = rest.unionByName(through).unionByName(noted).repartition(*keys).groupBy(*keys, "w")  # one shuffle, for the window as well
        best = best.agg(F.min(F.struct("c", "via")).alias("e"), F.min(F.struct("c", "back")).alias("r"), F.max("need").alias("need"))
        edges = best.select(*keys, "w", "e.c", "e.via", "r.back", "need")
        taken.append((down, up))


def simplified(edges: DataFrame, kept: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., source, target, cost): fewer edges with the same costs between all ``kept`` (within..., vertex).

    Other vertices with at most two neighbours are taken out, as in ``shortest_paths``.
    """
    core, _ = contracted(_cheapest(_directed(edges, within), within), kept.select(*within, F.col("vertex").alias("u")).distinct(), within)
    return core.where("u < w").select(*within, F.col("u").alias("source"), F.col("w").alias("target"), F.col("c").alias("cost"))


def _directed(edges: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Edges in both directions: (within..., u, w, c, via)."""
    one = lambda a, b: edges.select(*within, F.col(a).alias("u"), F.col(b).alias("w"), F.col("cost").cast("double").alias("c"), F.col(a).cast("long").alias("via"))
    return one("source", "target").union(one("target", "source")).where("u <> w")


def _searched(starts: DataFrame, edges: DataFrame, limit: float | None, within: tuple[str, ...]) -> DataFrame:
    """(within..., source, vertex, cost, via) along (within..., u, w, c, via), for all sources at once.

    Rounds relax only the vertices whose cost has just fallen, and write only rows that change.
    """
    keys = [*within, "source", "vertex"]
    known = cut(starts.select(*within, F.col("u").alias("source"), F.col("u").alias("vertex"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via")))
    changed, rounds = known, 0
    while True:
        offers = changed.select(*within, "source", F.col("vertex").alias("u"), "cost").join(edges, [*within, "u"])
        offers = offers.select(*within, "source", F.col("w").alias("vertex"), (F.col("cost") + F.col("c")).alias("cost"), "via", (F.col("c") > 0).alias("longer"))
        if limit is not None:
            offers = offers.where(F.col("cost") < limit)
        offers = offers.groupBy(*keys).agg(F.min(F.struct("cost", "via", "longer")).alias("o"))
        old = known.groupBy(*keys).agg(F.min(F.struct("cost", "via")).alias("k"))
        better = F.col("k").isNull() | (F.col("o.cost") < F.col("k.cost"))
        # an equal offer over an edge of no length could close a circle of pointers
        equal = (F.col("o.cost") == F.col("k.cost")) & F.col("o.longer") & (F.col("o.via") < F.col("k.via"))
        new = cut(offers.join(old, keys, "left").where(better | equal).select(*keys, F.col("o.cost").alias("cost"), F.col("o.via").alias("via"), better.alias("better")))
        changed, rounds = new.where("better").drop("better"), rounds + 1
        if new.isEmpty():
            return cut(_least_cost(known, within))
        known = known.unionByName(new.drop("better"))
        if rounds % MERGED_AFTER == 0:
            known = cut(_least_cost(known, within))


def ordered_paths(paths: DataFrame, ends: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., source, vertex, nth, node): the vertices on the way from the source, which is 1, to each of ``ends``.

    ``paths`` is the result of ``shortest_paths``; ``ends`` has (within..., source, vertex),
    and those that are not reached give no rows.  Pointers to the vertex before double
    their reach in each round, so a way of n vertices takes log n rounds.
    """
    keys = [*within, "source"]
    ahead = cut(paths.where(F.col("via").isNotNull()).select(*keys, F.col("vertex").alias("node"), "via"))
    asked = ends.select(*keys, "vertex").distinct().join(paths.select(*keys, "vertex"), [*keys, "vertex"], "left_semi")
    on = cut(asked.select(*keys, "vertex", F.col("vertex").alias("node"), F.lit(0).cast("long").alias("back")))
    reach = 1
    while not ahead.isEmpty():
        met = join_spread(on, ahead, [*keys, "node"]).select(*keys, "vertex", F.col("via").alias("node"), (F.col("back") + reach).alias("back"))
        on = cut(on.unionByName(met))
        further = ahead.select(*keys, F.col("node").alias("via"), F.col("via").alias("beyond"))
        ahead = cut(join_spread(ahead, further, [*keys, "via"]).select(*keys, "node", F.col("beyond").alias("via")))
        reach *= 2
    nth = F.row_number().over(Window.partitionBy(*keys, "vertex").orderBy(F.desc("back")))
    return on.select(*keys, "vertex", nth.alias("nth"), "node")


def every_way(paths: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``ordered_paths`` with all of ``paths`` as ends.

    Each row holds the last vertices of its way as an array, which takes in that of the
    vertex before it in each round: one row a way is moved, not one a vertex on it.
    """
    keys = [*within, "source"]
    rows = cut(paths.select(*keys, "vertex", F.col("via").alias("ahead"), F.array("vertex").alias("way")))
    while not rows.where("ahead IS NOT NULL").isEmpty():
        before = rows.select(*keys, F.col("vertex").alias("ahead"), F.col("ahead").alias("beyond"), F.col("way").alias("before"))
        met = rows.where("ahead IS NOT NULL").join(before, [*keys, "ahead"], "left")
        way = F.concat(F.coalesce("before", F.array("ahead")), "way")
        met = met.select(*keys, "vertex", F.col("beyond").alias("ahead"), way.alias("way"))
        rows = cut(rows.where("ahead IS NULL").unionByName(met))
    out = rows.select(*keys, "vertex", F.posexplode("way").alias("nth", "node"))
    return out.withColumn("nth", F.col("nth") + 1)


def tree_paths(edges: DataFrame, root: int | str, length: str = "length", within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., vertex, depth, distance, branch, path) of radial networks of (within..., parent, child, length).

    All networks have the same ``root``; ``within`` names columns that tell them apart.  ``branch`` is the first vertex after the root; ``path`` lists the vertices from
    the root on.  One round a level.
    """
    steps = cut(edges.select(*within, "parent", "child", F.col(length).cast("double").alias("l")))
    level = steps.where(F.col("parent") == root).select(*within, F.col("child").alias("vertex"), F.lit(1).alias("depth"), F.col("l").alias("distance"), F.col("child").alias("branch"), F.array("parent", "child").alias("path"))
    level = cut(level)
    out = level
    while not level.isEmpty():
        level = cut(
            level.withColumnRenamed("vertex", "parent").join(steps, [*within, "parent"]).select(
                *within, F.col("child").alias("vertex"), (F.col("depth") + 1).alias("depth"), (F.col("distance") + F.col("l")).alias("distance"), "branch", F.concat("path", F.array("child")).alias("path")
            )
        )
        out = out.union(level)
    return out


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, degree, loose, alone): how many edges each vertex has, whether it is a dead end, and whether it has none."""
    ends = edges.select(F.col("source").alias("vertex")).union(edges.select("target")).groupBy("vertex").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return vertices.join(ends, "vertex", "left").select("vertex", n.alias("degree"), (n == 1).alias("loose"), (n == 0).alias("alone"))


def least_targets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with the smallest ``target`` of the edges from them, null without one."""
    least = edges.groupBy(F.col("source").alias("vertex")).agg(F.min("target").alias("target"))
    return vertices.join(least, "vertex", "left")


def descendant_sums(paths: DataFrame, values: DataFrame, measure: str) -> DataFrame:
    """(vertex, total): ``measure`` of ``values`` (vertex, measure) summed over each subtree.

    Every vertex gives its value to all vertices on its path: one shuffle, no loop
    over levels.
    """
    return paths.join(values, "vertex").select(F.explode("path").alias("vertex"), F.col(measure)).groupBy("vertex").agg(F.sum(measure).alias("total"))


def split_at(lines: DataFrame, cuts: DataFrame, id_column: str = "id", line: str = "line") -> DataFrame:
    """Lines split at fractions of their length: id, ``part`` from 0, and the line of each part.

    ``cuts`` has the id and ``at``; fractions at the ends and repeated ones are ignored.
    """
    inner = cuts.where((F.col("at") > 1e-9) & (F.col("at") < 1 - 1e-9)).groupBy(id_column).agg(F.sort_array(F.collect_set(F.round("at", 9))).alias("ats"))
    marked = lines.join(inner, id_column, "left").withColumn("ats", F.concat(F.array(F.lit(0.0)), F.coalesce("ats", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    parts = marked.select(id_column, line, "ats", F.explode(F.sequence(F.lit(0), F.size("ats") - 2)).alias("part"))
    piece = G.substring(F.col(line), F.element_at("ats", F.col("part") + 1), F.element_at("ats", F.col("part") + 2))
    return parts.select(id_column, "part", F.when(F.size("ats") == 2, F.col(line)).otherwise(piece).alias(line))


def crossings(lines: DataFrame, size: float, id_column: str = "id", line: str = "line") -> DataFrame:
    """(id, at): where each line is crossed inside a segment by another.

    Segments meet in the square cells that their boxes cover.
    """
    parts = lines.select(F.col(id_column).alias("id"), F.col(line).alias("line"), F.posexplode(G.segments(F.col(line))).alias("i", "s"))
    parts = parts.select("id", "i", "s", G.length(F.slice("line", 1, F.col("i") + 1)).alias("before"), G.length(F.col("line")).alias("whole"))
    for axis in ("x", "y"):
        low, high = F.least(f"s.a.{axis}", f"s.b.{axis}"), F.greatest(f"s.a.{axis}", f"s.b.{axis}")
        parts = parts.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    other = parts.select("cx", "cy", F.col("id").alias("other"), F.col("s").alias("o"))
    a, b, c, d = (F.col(x) for x in ("s.a", "s.b", "o.a", "o.b"))
    met = parts.join(other, ["cx", "cy"]).where((F.col("id") != F.col("other")) & G.segments_cross(a, b, c, d))
    return met.select("id", ((F.col("before") + G.crossing_fraction(a, b, c, d) * G.distance(a, b)) / F.col("whole")).alias("at")).distinct()
