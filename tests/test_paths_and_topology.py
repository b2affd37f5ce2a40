"""Paths by contraction and topology by tolerance, against searches without Spark."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph


def searched(edges, sources, limit=None):
    """(source, vertex) -> (cost, smallest vertex before)."""
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    out = {}
    for s in sources:
        cost, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for w, c in near.get(u, []) if d == cost[u] else ():
                if d + c < cost.get(w, 1e18):
                    cost[w] = d + c
                    heapq.heappush(heap, (d + c, w))
        for v, d in cost.items():
            if limit is None or d < limit:
                out[s, v] = d, None if v == s else min((u for u, c in near[v] if u in cost and c > 0 and cost[u] + c == d), default=-1)
    return out


def network(seed):
    """A road of 50, loops, dead ends, parallel edges, edges without length, and a vertex alone."""
    rng = random.Random(seed)
    edges = [(i, i + 1, float(rng.randrange(1, 5))) for i in range(50)] + [(rng.randrange(80), rng.randrange(80), float(rng.randrange(1, 5))) for _ in range(25)]
    return [*edges, *edges[:5], (10, 60, 0.0), (60, 61, 0.0), (61, 62, 2.0), (7, 7, 1.0)]


@pytest.mark.parametrize(("sources", "limit", "many"), [([3, 40, 77, 90], None, False), ([3, 40, 77, 90], 9.0, True), (list(range(80)), None, True)])
def test_paths_equal_search(spark, sources, limit, many):
    edges = network(4)
    e, s = spark.createDataFrame(edges, "source long, target long, cost double"), spark.createDataFrame([(x,) for x in sources], "vertex long")
    paths = graph.cut(graph.shortest_paths(s, e, limit, many=many))
    got, want = {(r.source, r.vertex): (r.cost, r.via) for r in paths.collect()}, searched(edges, sources, limit)
    assert paths.count() == len(got) and set(got) == set(want)
    for k, (cost, via) in want.items():
        assert got[k][0] == cost and (via == -1 or got[k][1] == via), k
    for a, v in got:  # pointers lead back to the source
        steps = 0
        while got[a, v][1] is not None:
            v, steps = got[a, v][1], steps + 1
            assert steps < 200
        assert v == a


def test_areas_do_not_mix(spark):
    rows = [(area, a, b, c * (1 + area)) for area in (0, 1) for a, b, c in network(2)]
    e = spark.createDataFrame(rows, "area int, source long, target long, cost double")
    s = spark.createDataFrame([(0, 3), (1, 40)], "area int, vertex long")
    got = {(r.area, r.source, r.vertex): r.cost for r in graph.shortest_paths(s, e, within=("area",)).collect()}
    want = {(area, *k): c for area, v in ((0, 3), (1, 40)) for k, (c, _) in searched([(a, b, c * (1 + area)) for a, b, c in network(2)], [v]).items()}
    assert got == want


def test_a_long_road_takes_few_rounds(spark, monkeypatch):
    n, writes, cut = 100_000, [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: writes.append(1) or cut(df))
    e = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("cost"))
    found = graph.shortest_paths(spark.createDataFrame([(500,)], "vertex long"), e)
    right = (F.col("cost") == F.abs(F.col("vertex") - 500)) & F.coalesce(F.col("via") == F.col("vertex") - F.signum(F.col("vertex") - 500), F.col("vertex") == 500)
    assert found.where(right).count() == found.count() == n
    assert len(writes) < 150


def test_contraction_writes_two_tables_a_round(spark, monkeypatch):
    n, writes, cut = 400, [], graph.cut
    circle = spark.range(n).select(F.col("id").alias("source"), ((F.col("id") + 1) % n).alias("target"), F.lit(1.0).alias("cost"))
    edges = graph._cheapest(graph._directed(circle, ()), ())
    monkeypatch.setattr(graph, "cut", lambda df: writes.append(1) or cut(df))
    left, taken = graph.contracted(edges, spark.createDataFrame([(5,), (6,), (200,)], "u long"))
    assert sorted((r.u, r.w, r.c) for r in left.collect()) == [(5, 6, 1.0), (5, 200, 205.0), (6, 5, 1.0), (6, 200, 194.0), (200, 5, 205.0), (200, 6, 194.0)]
    assert len(writes) <= 2 * len(taken) + 1


@pytest.mark.parametrize("sources", [[3, 77, 90], list(range(80))])
def test_every_way_moves_one_row_a_way(spark, monkeypatch, sources):
    e, s = spark.createDataFrame(network(4), "source long, target long, cost double"), spark.createDataFrame([(x,) for x in sources], "vertex long")
    paths = graph.cut(graph.shortest_paths(s, e, many=True))
    want, sizes, cut = graph.ordered_paths(paths, paths).collect(), [], graph.cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = graph.every_way(paths).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 2 * paths.count()
    assert set(sizes) == {paths.count()}


def test_simplified_keeps_costs(spark):
    edges = network(6)
    kept = [3, 20, 40, 62, 77]
    e, s = spark.createDataFrame(edges, "source long, target long, cost double"), spark.createDataFrame([(x,) for x in kept], "vertex long")
    small = [(r.source, r.target, r.cost) for r in graph.simplified(e, s).collect()]
    assert len(small) < len(edges) / 2
    want = searched(edges, kept)
    assert {k: c for k, (c, _) in searched(small, kept).items() if k[1] in kept} == {k: c for k, (c, _) in want.items() if k[1] in kept}


def test_topology_joins_ends_on_both_sides_of_a_border(spark):
    lines = [(1, [(0.0, 0.0), (5.0049, 0.0)]), (2, [(5.0051, 0.0), (9.0, 0.0)]), (3, [(0.009, 0.0), (3.0, 3.0)]), (4, [(3.0, 3.02), (9.0, 0.0)]), (5, [(9.0, 0.01), (9.0, 0.02)]), (6, [(7.0, 7.0), (7.0, 7.0)])]
    edges, vertices = graph.topology(spark.createDataFrame(lines, "id int, line array<struct<x:double,y:double>>"), "id", "line")
    ends = {r.id: (r.source, r.target) for r in edges.collect()}
    place = {r.vertex: (r.x, r.y) for r in vertices.collect()}
    assert len(edges.collect()) == 6 and sorted(place) == list(range(1, 7)) and [place[v] for v in sorted(place)] == sorted(place.values())
    assert ends[1][1] == ends[2][0] and place[ends[1][1]] == (5.0049, 0.0)  # 0.0002 apart, in two cells
    assert ends[1][0] == ends[3][0] and ends[3][1] != ends[4][0]
    assert ends[2][1] == ends[4][1] == ends[5][0] == ends[5][1]  # 0.01 each from the next: one place
    assert ends[6][0] == ends[6][1]


@pytest.mark.parametrize("seed", [0, 1])
def test_topology_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    spot = lambda: (round(rng.randrange(8) + rng.uniform(-0.02, 0.02), 4), float(rng.randrange(3)))
    lines = [(i, [spot(), spot()]) for i in range(120)]
    edges, vertices = graph.topology(spark.createDataFrame(lines, "id int, line array<struct<x:double,y:double>>"), "id", "line")
    spots = sorted({p for _, line in lines for p in line})
    top = list(range(len(spots)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (x, y) in enumerate(spots):
        for j in range(i):
            if (x - spots[j][0]) ** 2 + (y - spots[j][1]) ** 2 <= (0.01 * (1 + 1e-9)) ** 2:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    near = lambda i: (*[math.floor(c / 0.01 + 0.5) for c in spots[i]], i)
    number = {r: n + 1 for n, r in enumerate(sorted({root(i) for i in range(len(spots))}, key=near))}
    vertex = {p: number[root(i)] for i, p in enumerate(spots)}
    assert {r.id: (r.source, r.target) for r in edges.collect()} == {i: (vertex[line[0]], vertex[line[1]]) for i, line in lines}
    assert {r.vertex: (r.x, r.y) for r in vertices.collect()} == {number[r]: spots[r] for r in number}
