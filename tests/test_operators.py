"""Operators on small inputs with known answers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.functions import geometry as G
from gridloom.operators import cluster, graph, metrics, network, relational, spatial
from gridloom.sources import files
from gridloom.sources.catalog import Catalog
from gridloom.streaming import ingest

LINE = "line array<struct<x:double,y:double>>"


def test_geometry(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],)], LINE)
    p = F.struct(F.lit(2.0).alias("x"), F.lit(1.0).alias("y"))
    r = df.select(
        G.length(F.col("line")).alias("l"),
        G.area(F.col("line")).alias("a"),
        G.centroid(F.col("line")).alias("c"),
        G.distance_to_line(F.col("line"), p).alias("d"),
        G.locate(F.col("line"), p).alias("at"),
        G.nearest_on_line(F.col("line"), p).alias("foot"),
        G.interpolate(F.col("line"), F.lit(5 / 7)).alias("mid"),
        G.substring(F.col("line"), F.lit(0.0), F.lit(1.0)).alias("whole"),
        G.contains(F.col("line"), F.struct(F.lit(3.0).alias("x"), F.lit(1.0).alias("y"))).alias("inside"),
    ).first()
    assert (r.l, r.a, r.d, r.inside) == (7.0, 6.0, 1.0, True)
    assert r.at == pytest.approx(2 / 7) and (r.foot.x, r.foot.y) == (2.0, 0.0)
    assert (r.mid.x, r.mid.y) == pytest.approx((4.0, 1.0)) and len(r.whole) == 3
    assert (r.c.x, r.c.y) == pytest.approx((8 / 3, 1.0))


def test_laea_of_the_centre(spark):
    r = spark.range(1).select(G.laea_europe(F.lit(10.0), F.lit(52.0)).alias("p")).first().p
    assert (r.x, r.y) == pytest.approx((4321000.0, 3210000.0), abs=1e-3)


def test_loads_and_sizes(spark):
    df = spark.createDataFrame([("SFH", 159.0, 2), ("SFH", 160.0, 2), ("MFH", 260.0, 3), ("Commercial", 2000.0, 1), ("TH", 10.0, 1)], "kind string, area double, floors int")
    units = E.households(F.col("kind"), F.col("area"), F.col("floors"))
    peak = E.peak_load_kw(F.col("kind"), F.col("area"), units)
    out = df.select(units.alias("u"), peak.alias("p"), E.without_large_consumers(F.col("kind"), peak).alias("s")).collect()
    assert [tuple(r) for r in out] == [(1, 30.0, 30.0), (2, 60.0, 60.0), (15, 450.0, 450.0), (1, 158.0, 0.0), (1, 30.0, 30.0)]
    sizes = spark.createDataFrame([(99.9,), (100.0,), (250.0,), (400.0,)], "l double").select(E.next_capacity(F.col("l")).alias("c")).collect()
    assert [r.c for r in sizes] == [100, 160, 400, None]
    zero = spark.range(1).select(E.simultaneous_load(F.lit(0.0), F.lit(0), F.lit(0.07)).alias("l")).first().l
    assert zero == 0.0


def test_cable_choice_is_the_smallest_adequate(spark):
    rows = [(i, 0.03 * i, float(7 * i % 50)) for i in range(1, 40)]
    got = {r.k: (r.parallel, r.cable) for r in network.choose_cable(spark.createDataFrame(rows, "k int, ka double, m double"), "k", F.col("ka"), F.col("m")).collect()}
    for k, ka, m in rows:
        for n in itertools.count(1):
            fit = [(q, name) for name, r, x, most, q in E.STREET_CABLES if most >= ka / n - 1e-12 and (m == 0 or np.hypot(r, x) <= 18 / (ka * m / n) + 1e-12)]
            if fit:
                assert got[k] == (n, min(fit)[1])
                break


def union_find(n, edges):
    up = list(range(n))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(v) for v in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(v, v + 1) for v in range(40, 59)]
    v = spark.range(60).withColumnRenamed("id", "vertex")
    e = spark.createDataFrame([(a, b, float(1 + (a * b) % 7)) for a, b in edges], "source long, target long, cost double")
    got = {r.vertex: r.component for r in graph.connected_components(v, e).collect()}
    assert [got[i] for i in range(60)] == union_find(60, edges)
    costs = {r.vertex: r.cost for r in graph.shortest_paths(v.where("vertex = 41"), e).collect()}
    best = {41: 0.0}
    for _ in range(60):
        for a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p in best and best[p] + 1 + (a * b) % 7 < best.get(q, 1e9):
                    best[q] = best[p] + 1 + (a * b) % 7
    assert costs == best
    paths = graph.cut(graph.shortest_paths(v.where("vertex = 41"), e))
    ways = {}
    for r in graph.ordered_paths(paths, paths).orderBy("nth").collect():
        ways.setdefault(r.vertex, []).append(r.node)
    linked = {(a, b): 1 + (a * b) % 7 for p, q in edges for a, b in ((p, q), (q, p))}
    assert {end: sum(linked[s] for s in itertools.pairwise(way)) for end, way in ways.items()} == best
    assert all(way[0] == 41 and way[-1] == end for end, way in ways.items())
    for end, way in ways.items():  # the vertex before is the smallest of equals
        before = [a for (a, b), c in linked.items() if b == end and a in best and best[a] + c == best[end]]
        assert len(way) == 1 or way[-2] == min(before)
    reached = {r.vertex for r in graph.reachable(v.where("vertex = 41"), e).collect()}
    assert reached == set(best)


def test_average_linkage_halves():
    rng = np.random.default_rng(0)
    for n in (2, 3, 7, 25):
        p = rng.random((n, 2))
        d = np.hypot(*(p[:, None] - p[None, :]).transpose(2, 0, 1))
        groups = [[i] for i in range(n)]
        while len(groups) > 2:
            i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda ij: d[np.ix_(groups[ij[0]], groups[ij[1]])].mean())
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        labels = cluster.halves(d)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in (0, 1)} == {frozenset(g) for g in groups}


def test_bisection_serves_every_point_once(spark):
    rng = random.Random(3)
    rows = [(a, i, rng.random() * 500, rng.random() * 500, "MFH", 30.0 * k, k) for a in (1, 2) for i in range(60) for k in [rng.randrange(1, 12)]]
    out = cluster.bisect_by_capacity(spark.createDataFrame(rows, "area int, point int, x double, y double, kind string, power double, count int"), "area").collect()
    assert sorted((r.area, r.point) for r in out) == sorted((r[0], r[1]) for r in rows)
    for r in out:
        members = [x for x in out if (x.area, x.cluster) == (r.area, r.cluster)]
        assert r.load < 400 or len(members) < cluster.SMALLEST_SPLIT
        assert r.size_kva > r.load or len(members) < cluster.SMALLEST_SPLIT


@pytest.mark.parametrize("size", [1, 3, 400])
def test_weighted_median_equals_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = [(g, g * 1000 + i, float(x), float(y), float(w)) for g in range(3) for i, (x, y, w) in enumerate(rng.integers(0, 60, (size, 3)))]
    rows += [(7, 1, 0.0, 0.0, 0.0), (7, 2, 9.0, 9.0, None), (8, 1, None, 0.0, 5.0), (8, 2, 1.0, 1.0, 5.0)]
    rows += [(9, i, float(i), 0.0, 1.0) for i in range(40)] + [(9, 100, 3.0, 0.0, 1.0)]  # on a line, with a tie
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, load double")
    got = {r["g"]: (r["site"], r["moment"]) for r in cluster.weighted_median_point(df, "g").collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[2] is not None]
        moments = [(round(sum((q[4] or 0.0) * np.hypot(p[2] - q[2], p[3] - q[3]) for q in own), 3), p[1]) for p in own]
        assert got[g][0] == min(moments)[1]
        assert got[g][1] == pytest.approx(min(moments)[0], abs=2e-3)
    assert cluster.weighted_median_point(df.limit(0), "g").count() == 0


def test_areas_are_bounded_and_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(g, g * 10_000 + i, float(x), float(y)) for g, n in ((1, 900), (2, 30), (3, 1)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    out = cluster.bounded_areas(spark.createDataFrame(rows, "g int, id long, x double, y double"), "g", 50).toPandas()
    assert sorted(out["id"]) == sorted(r[1] for r in rows)
    assert out.groupby("area").size().max() <= 60 and out.groupby("area")["g"].nunique().max() == 1


def test_greedy_assignment_respects_reach_and_capacity(spark):
    costs = [(1, c, t, float(10 * c + 50 * t)) for c in range(40) for t in (0, 1)]
    users = [(1, c, "Commercial", 90.0, 1) for c in range(40)]
    out = cluster.assign_to_transformers(
        spark.createDataFrame(costs, "area int, consumer int, transformer int, cost double"), spark.createDataFrame(users, "area int, consumer int, kind string, power double, count int"), "area"
    ).collect()
    assert all(10 * r.consumer + 50 * r.transformer < 300 for r in out)
    for t in (0, 1):
        n = sum(r.transformer == t for r in out)
        assert n * 90 * (0.5 + 0.5 * n**-0.75) < 630


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_assignment_equals_taking_pairs_in_order(spark, seed):
    """Ties, large and idle consumers, all classes, an area with most of the rows, and copies of pairs."""
    rng = random.Random(seed)
    areas = [1] * 60 + [2] * 20 + [3]
    users = [(a, c, rng.choice(["SFH", "AB", "Commercial", "Public", "Industrial"]), float(rng.choice([0, 30, 90, 400, 900])), rng.choice([0, 1, 1, 12])) for c, a in enumerate(areas)]
    costs = [(a, c, t, float(rng.randint(1, 33) * 10)) for c, a in enumerate(areas) for t in range(6) if rng.random() < 0.7]
    costs += costs[::7] + [(1, 0, 9, None)]
    by_consumer, sums, full, given = {(u[0], u[1]): u for u in users}, {}, set(), {}
    for a, c, t, cost in sorted((p for p in costs if p[3] is not None and p[3] < cluster.REACH), key=lambda p: (p[3], p[1], p[2])):
        if (a, c) in given or (a, t) in full:
            continue
        trial = [*sums.get((a, t), []), by_consumer[a, c][2:]]
        if cluster.coincident_load(*map(list, zip(*trial, strict=True))) >= cluster.FULL_KVA:
            full.add((a, t))
        else:
            sums[a, t], given[a, c] = trial, t
    size = {at: min(s for s in E.MAPPED_CAPACITIES if s > cluster.coincident_load(*map(list, zip(*rows, strict=True)))) for at, rows in sums.items()}
    want = sorted((a, c, t, size[a, t]) for (a, c), t in given.items())
    assert full and len(want) < len(users)
    out = cluster.assign_to_transformers(
        spark.createDataFrame(costs, "area int, consumer int, transformer int, cost double"), spark.createDataFrame(users, "area int, consumer int, kind string, power double, count int"), "area"
    )
    assert sorted(map(tuple, out.select("area", "consumer", "transformer", "size_kva").collect())) == want and out.where("false").count() == 0


def test_feeders_cover_every_node_once(spark):
    rows = [(1, i, i - 1 if i else None, float(i), ["SFH"], [30.0 * (1 + i % 5)], [1.0 + i % 5]) for i in range(50)]
    out = network.lay_branches(spark.createDataFrame(rows, "grid int, node long, parent long, distance double, kinds array<string>, powers array<double>, counts array<double>"), "grid").collect()
    assert sorted(r.node for r in out) == list(range(50))
    first = {r.branch: r for r in out if r.nth == 0}
    assert all(r.current_ka < E.BRANCH_LIMIT_KA or sum(x.branch == b for x in out) == 1 for b, r in first.items())


def test_feeders_pass_junctions(spark):
    """Four consumers in line with junctions between them are one feeder."""
    rows = [(1, i, i - 1 if i else None, float(i), *((["SFH"], [30.0], [1.0]) if i % 2 else ([], [], []))) for i in range(9)]
    out = network.lay_branches(spark.createDataFrame(rows, "grid int, node long, parent long, distance double, kinds array<string>, powers array<double>, counts array<double>"), "grid").collect()
    assert sorted((r.branch, r.nth, r.node, r.next, r.length) for r in out) == [(0, 0, 7, 5, 2.0), (0, 1, 5, 3, 2.0), (0, 2, 3, 1, 2.0), (0, 3, 1, None, 1.0)]


def test_areas_of_one_point_and_mixed_points(spark):
    rows = [(1, 7, 0.0, 0.0, "SFH", 30.0, 1), (2, 1, 0.0, 0.0, "MFH", 300.0, 10), (2, 1, 0.0, 0.0, "Commercial", 50.0, 1), (2, 2, 5.0, 0.0, "Industrial", 90.0, 1)]
    out = {(r.area, r.point): r for r in cluster.bisect_by_capacity(spark.createDataFrame(rows, "area int, point int, x double, y double, kind string, power double, count int"), "area").collect()}
    assert set(out) == {(1, 7), (2, 1), (2, 2)} and out[1, 7].load == pytest.approx(30) and out[1, 7].size_kva == 100
    assert out[2, 1].load == pytest.approx(300 * (0.07 + 0.93 * 10**-0.75) + 50) and out[2, 2].load == 0


def test_borders_touch_without_common_corners(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rings = [(0, box(0.0, 0.0, 60.0, 10.0)), (1, box(20.0, 10.0, 5.0, 5.0)), (2, box(60.004, 3.0, 5.0, 2.0)), (3, box(61.0, 20.0, 5.0, 5.0)), (4, box(30.0, 5.0, 2.0, 30.0))]
    df = spark.createDataFrame(rings, f"id int, {LINE.replace('line', 'ring', 1)}")
    assert {(r.a, r.b) for r in spatial.touching(df, "id", "ring").collect()} == {(0, 1), (0, 2), (0, 4)}
    lines = spark.createDataFrame([(10, [(-5.0, 4.5), (100.0, 4.5)]), (13, [(-5.0, 6.0), (100.0, 6.0)]), (11, [(22.0, 12.0), (23.0, 13.0)]), (12, [(0.0, 50.0), (9.0, 50.0)])], f"way int, {LINE}")
    met = spatial.lines_meeting_polygons(lines, df, "line", "ring", 7.0).select("way", "id").collect()
    assert sorted((r.way, r.id) for r in met) == [(10, 0), (10, 2), (11, 1), (13, 0), (13, 4)]


@pytest.mark.parametrize("shape", ["full", "tied", "diag", "spherical"])
def test_mixtures_find_clouds(spark, shape):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double")
    of = {r.id: r.cluster for r in cluster.gaussian_mixture(rows, ["a", "b"], "id", 3, shape).collect()}
    assert len(of) == 180 and [len({of[i] for i in range(60 * k, 60 * k + 60)}) for k in range(3)] == [1, 1, 1] and len(set(of.values())) == 3


def test_places_in_parts(spark):
    rng = np.random.default_rng(4)
    spots = [(0, i, float(x), float(y), 4) for i, (x, y) in enumerate(np.concatenate([rng.normal(c, 30, (40, 2)) for c in ((0, 0), (5000, 0), (0, 5000), (5000, 5000))]))]
    spots += [(1, 1000 + i, float(i), 0.0, 1) for i in range(5)]
    out = {r.id: r.part for r in cluster.place_clusters(spark.createDataFrame(spots, "g int, id long, x double, y double, parts int"), "g", "parts", rounds=2).collect()}
    assert len(out) == len(spots) and [len({out[i] for i in range(40 * k, 40 * k + 40)}) for k in range(4)] == [1] * 4
    assert {out[i] for i in range(160)} == {0, 1, 2, 3} and {out[1000 + i] for i in range(5)} == {0}


def test_small_relational_operators(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("b", 3, 8)], "k string, v int, g int")
    assert [r.v for r in relational.only_ones(df, ["k"]).collect()] == [3]
    with pytest.raises(ValueError, match="no ways"):
        relational.required(df.where("false"), "ways")
    assert relational.required(df, "ways").count() == 3 and relational.sampled(df, 100.0).count() == 3
    pool = spark.createDataFrame([("x", 1, 7), ("y", 9, 7), ("z", 10, 8)], "k string, v int, g int")
    assert sorted(r.v for r in relational.replaced(df, "v", 1, pool, ["g"]).collect()) == [2, 3, 9]
    assert sorted(r.v for r in relational.replaced(df, "v", 3, pool.where("g = 7"), ["g"]).collect()) == [1, 2, 3]
    m = spark.sql("SELECT map('630', 1, '1000', 2, '400', 3) AS m").select(relational.sorted_entries(F.col("m")).alias("up"), relational.sorted_entries(F.col("m"), True).alias("down")).first()
    assert [e.key for e in m.up] == ["400", "630", "1000"] and [e.value for e in m.down] == [2, 1, 3]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, 5000)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 950)], "k int, w string")
    got = sorted(map(repr, relational.join_spread(left, right, ["k"], how, share=10).collect()))
    assert got == sorted(map(repr, left.join(right, "k", how).collect()))


def test_degrees_targets_and_text(spark):
    v = spark.range(4).withColumnRenamed("id", "vertex")
    e = spark.createDataFrame([(0, 2), (0, 1), (1, 2)], "source long, target long")
    assert sorted(tuple(r) for r in graph.degrees(v, e).collect()) == [(0, 2, False, False), (1, 2, False, False), (2, 2, False, False), (3, 0, False, True)]
    assert sorted((r.vertex, r.target) for r in graph.least_targets(v, e).where("target IS NOT NULL").collect()) == [(0, 1), (1, 2)]
    line = spark.createDataFrame([([(0.0, 1.5), (2.0, 0.0), (2.0, 2.0)],)], LINE)
    r = line.select(G.wkt_line(F.col("line")).alias("l"), G.wkt_polygon(F.col("line")).alias("p")).select("*", G.from_wkt(F.col("l")).alias("a"), G.from_wkt(F.col("p")).alias("b")).first()
    assert r.l == "LINESTRING (0.0 1.5, 2.0 0.0, 2.0 2.0)" and r.p == "POLYGON ((0.0 1.5, 2.0 0.0, 2.0 2.0, 0.0 1.5))"
    assert [tuple(p) for p in r.a] == [(0.0, 1.5), (2.0, 0.0), (2.0, 2.0)] and len(r.b) == 4


def test_indoor_transformers(spark):
    from gridloom.operators.transformers import without_indoor

    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    homes = spark.createDataFrame([(0.0, square), (30.0, [(x + 20, y) for x, y in square])], f"peak double, {LINE.replace('line', 'ring', 1)}")
    t = spark.createDataFrame([(1, 5.0, 5.0), (2, 25.0, 5.0), (3, 50.0, 5.0)], "id int, x double, y double")
    assert sorted(r.id for r in without_indoor(t, homes).collect()) == [2, 3]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.randrange(10_000), rng.randrange(10_000)) for i in range(300)]
    a = spark.createDataFrame(pts, "a int, ax int, ay int")
    b = spark.createDataFrame(pts, "b int, bx int, by int")
    got = {(r.a, r.nth): r.b for r in spatial.nearest(a, b, 3, "a", "b", ("ax", "ay"), ("bx", "by"), others=True).collect()}
    for i, x, y in pts:
        best = sorted((np.hypot(x - u, y - w), j) for j, u, w in pts if j != i)[:3]
        assert [got[i, n] for n in (1, 2, 3)] == [j for _, j in best]


def test_convex_hull(spark):
    pts = [(1, x, y) for x in range(5) for y in range(5)] + [(2, 3, 3)]
    out = spatial.convex_hull(spark.createDataFrame(pts, "k int, x int, y int"), "k", ("x", "y")).collect()
    assert {(r.x, r.y) for r in out if r.k == 1} == {(0, 0), (4, 0), (4, 4), (0, 4)}
    assert [(r.x, r.y) for r in out if r.k == 2] == [(3, 3)]


def test_touching_exclusion_spreads(spark):
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    rings = spark.createDataFrame([(i, square(float(i))) for i in (0, 1, 2, 5)], f"id long, {LINE.replace('line', 'ring', 1)}")
    pairs = spatial.touching(rings, "id", "ring").select(F.col("a").alias("source"), F.col("b").alias("target"))
    assert {r.vertex for r in graph.reachable(spark.createDataFrame([(0,)], "vertex long"), pairs).collect()} == {0, 1, 2}


def test_duplicates_and_bins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    left = relational.drop_marked_duplicates(df, "k", F.col("v") != 1)
    assert sorted(r.v for r in left.collect()) == [1, 3, 4, 5]
    bins = relational.histogram(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "v double"), "v", 4)
    assert [r.n for r in bins.orderBy("bin").collect()] == [2, 1, 0, 1]
    assert relational.null_free_columns(df).columns == ["v"]


def test_factor_tools(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 1))
    data = np.hstack([base + 0.1 * rng.normal(size=(200, 2)), rng.normal(size=(200, 1))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    shares = metrics.explained_variance(df, ["a", "b", "c"])
    assert shares[-1][2] == pytest.approx(1) and shares[0][1] > 0.6
    assert metrics.factors(df, ["a", "b", "c"])[0][1] in ("a", "b")
    statistic, kmo = metrics.adequacy(df, ["a", "b", "c"])
    assert statistic > 100 and 0 < kmo < 1


def test_catalog(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    assert store.tables() == [] and store.read("ledger").isEmpty()
    grids = spark.createDataFrame([("v", 1, 1, 1, 100.0), ("v", 2, 1, 1, 160.0)], "version string, plz int, kcid int, bcid int, size_kva double")
    store.write("grids", grids, ("plz",))
    store.write("grids", grids.where("plz = 1").withColumn("size_kva", F.lit(250.0)), ("plz",))
    assert sorted((r.plz, r.size_kva) for r in store.read("grids").collect()) == [(1, 250.0), (2, 160.0)]
    store.delete("grids", plz=1)
    assert [r.plz for r in store.read("grids").collect()] == [2]
    (tmp_path / "store" / "grids").rename(tmp_path / "store" / "grids.old")  # a delete that was cut off
    assert [r.plz for r in store.read("grids").collect()] == [2]
    store.write("ledger", spark.createDataFrame([(9, None)], "ags int, at timestamp"))
    store.delete_everywhere(plz=2)
    assert store.read("grids").isEmpty() and store.read("ledger").count() == 1
    store.append("grids", grids, ("plz",))
    assert sorted(r.plz for r in store.read("grids").collect()) == [1, 2]
    with pytest.raises(ValueError, match="no table"):
        store.read("nothing")


def test_ledger_loads_a_unit_once(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, 10.0, 100, 1), (2, 20.0, 200, 2)], "plz int, pop double, ags int, fed_state int")
    full = store.read("municipal_register").unionByName(rows, allowMissingColumns=True)
    ingest.load_once(store, "municipal_register", full)
    ingest.load_once(store, "municipal_register", full)
    assert store.read("municipal_register").count() == 2 and store.read("ledger").count() == 2
    cut_off = full.limit(0).unionByName(spark.createDataFrame([(3, 30.0, 300, 3)], "plz int, pop double, ags int, fed_state int"), allowMissingColumns=True)
    store.append("municipal_register", cut_off)  # a load that ended before the ledger was written
    ingest.load_once(store, "municipal_register", cut_off)
    assert store.read("municipal_register").count() == 3 and store.read("ledger").count() == 3


def test_stream_follows_files(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    schema = store.read("municipal_register").schema
    spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 7, "n", 1, 1, 1, 1.0)], schema).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for _ in range(2):
        ingest.follow(store, "municipal_register", stream, f"{tmp_path}/ck").awaitTermination()
    assert store.read("municipal_register").count() == 1


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"w1","area":5.5},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},'
        '{"type":"Feature","properties":{"id":"w2"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'
    )
    rows = files.read_geojson(spark, str(tmp_path / "a.geojson"), "id:string,area:double")
    assert sorted((r.id, len(r.ring)) for r in rows.collect()) == [("w1", 4), ("w2", 4), ("w2", 4)]
    files.write_geojson(rows, f"{tmp_path}/out", "ring")
    assert spark.read.text(f"{tmp_path}/out").where("value like '%LineString%'").count() == 3


def test_shapefile(spark, tmp_path):
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "x.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"use".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    (tmp_path / "x.dbf").write_bytes(struct.pack("<4BiHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 6) + bytes(20) + field + b"\r" + b" house")
    r = files.read_shapefiles(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].attributes == {"use": "house"} and len(r[0].ring) == 4


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [(0.0, 1.0)])], "name string, n int, line array<struct<x:double,y:double>>")
    files.write_csv(rows, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", "name string, n int, line string").first().n == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
