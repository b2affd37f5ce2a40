"""What showed on larger tables only: results, rows compared and broadcast."""

import math

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import projection as P
from gridloom.operators import cluster as C
from gridloom.operators import network as N
from gridloom.operators import overlay as O
from gridloom.operators import spatial as S
from gridloom.operators import transformers as T


def test_nearest_line_is_judged_as_a_whole(spark):
    point = "struct<x:double,y:double>"
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 50.0), (0.0, 120.0)]), (2, [(40.0, 0.0), (40.0, 120.0)])], f"line int, points array<{point}>")
    points = spark.createDataFrame([(1, 0.0, 60.0), (2, 3.0, 60.0)], "id int, x double, y double")
    out = S.nearest_lines(points, lines, 50.0, 100.0, "id", "line", ("x", "y"), "points", 0.1)
    got = {r["id"]: (r["line"], r["distance"], r["at"]) for r in out.collect()}
    # the first is on line 1, whose other segment is 10 away
    assert got == {1: (2, 40.0, 0.5), 2: (1, 3.0, 0.5)}


def test_reprojections_do_not_repeat_what_they_nest(spark):
    g = spark.range(1).select(G.point(F.lit(11.0) + F.col("id"), F.lit(48.0) + F.col("id")).alias("g"))
    out = g.select(P.reproject(P.reproject(P.reproject(F.col("g"), 4326, 32633), 32633, 3035), 3035, 32633).alias("r"))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_rows_copied_into_cells_are_not_broadcast(spark):
    rows = spark.range(400).selectExpr("id as a", "cast(id * 37 % 101 as double) as ax", "cast(id * 53 % 103 as double) as ay")
    other = rows.withColumnsRenamed({"a": "b", "ax": "bx", "ay": "by"})
    found = S.nearest(rows, other, 4, "a", "b", ("ax", "ay"), ("bx", "by"), others=True)
    near = S.within_distance(rows, other, 10.0, ("ax", "ay"), ("bx", "by"))
    for out in (found, near):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_within_meet_once(spark):
    place = {i: (i * 37 % 101 - 50, i * 53 % 103 - 50) for i in range(300)}
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in place.items()], "id long, x long, y long")
    for strict in (False, True):
        got = sorted((r["a"], r["b"], round(r["distance"], 9)) for r in S.pairs_within(rows, 10.0, "id", ("x", "y"), strict).collect())
        far = {(i, j): math.hypot(place[i][0] - place[j][0], place[i][1] - place[j][1]) for i in place for j in place if i < j}
        assert got == sorted((i, j, round(d, 9)) for (i, j), d in far.items() if d < 10 or (d == 10 and not strict))


def test_touching_compares_equal_rings_once(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 3)
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rings = {i: box(float(i % 4 * 10), 0.0, 10.0 if i % 4 != 3 else 5.0) for i in range(40)} | {40: box(2.0, 2.0, 1.0)}
    rows = spark.createDataFrame(list(rings.items()), "id long, ring array<struct<x:double,y:double>>")
    out = S.touching(rows, "id", "ring")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()  # pairs of ids need no shuffle to be distinct
    assert sorted(map(tuple, out.collect())) == [(i, j) for i in range(40) for j in range(i + 1, 40) if abs(i % 4 - j % 4) <= 1]


def test_sides_of_rings_are_rounded_once(spark):
    rows = spark.range(1).select(F.lit(1).alias("key"), F.lit(1).alias("pid"), F.array(*[G.point(F.col("id") + x, F.col("id") + y) for x, y in ((0, 0), (1, 0), (0, 1))]).alias("ring"))
    plan = O._sides(rows, "ring", O.PRECISION)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rint(") + plan.count("round(") <= 8


def test_assignment_by_steps_equals_all_pairs_and_meets_few(spark, monkeypatch):
    """consumers find a transformer nearby, whatever the number within reach; some transformers are full."""
    monkeypatch.setattr(C, "SMALL_STEP", 400)
    monkeypatch.setattr(C, "STEP_PAIRS", 4)
    met, decided = [], C._decided
    monkeypatch.setattr(C, "_decided", lambda pairs, key: met.append(pairs.count()) or decided(pairs, key))
    users = [(i % 2, i, i * 37 % 401, i * 53 % 397, "Commercial", float(30 + 200 * (i % 3)), 1) for i in range(300)]
    users = spark.createDataFrame(users, "area int, consumer long, x long, y long, kind string, power double, count int")
    sites = spark.createDataFrame([(i, i * 61 % 211, i * 29 % 223) for i in range(60)], "transformer long, tx long, ty long")
    pairs = S.within_distance(users, sites, C.REACH, ("x", "y"), ("tx", "ty"), strict=True)
    rows = lambda df: sorted((r["area"], r["consumer"], r["transformer"], r["cost"], round(r["load"], 6), r["size_kva"]) for r in df.collect())
    got = rows(C.assign_within_reach(users, sites, "area"))
    steps = list(met)
    assert got == rows(C.assign_to_transformers(pairs.withColumnRenamed("distance", "cost"), users, "area"))
    assert len(steps) > 1 and sum(steps) < met[-1] / 2


def test_only_the_latest_of_a_crowd_are_compared(spark, monkeypatch):
    """2000 candidates on a few square metres."""
    place = {i: (i * 37 % 23 * 1.0, i * 53 % 19 * 1.0) for i in range(2000)}
    data = [(str(i), i, "400", [p]) for i, p in place.items()] + [("far", 1, None, [(90.0, 90.0)]), ("nowhere", 2, None, [(None, 1.0)])]
    rows = spark.createDataFrame(data, "id string, nth long, voltage string, ring array<struct<x:double,y:double>>")
    malls = spark.createDataFrame([], "ring array<struct<x:double,y:double>>")
    compared, within = [], S.within_distance
    monkeypatch.setattr(S, "within_distance", lambda *a, **k: compared.append((a[0].count(), a[1].count())) or within(*a, **k))
    got = {r["id"] for r in T.clean_candidates(rows, malls).collect()}
    assert got == {str(i) for i, p in place.items() if not any(math.dist(p, place[j]) < T.SAME_PLACE_M for j in range(i + 1, 2000))} | {"far", "nowhere"}
    assert compared[0][0] <= 5 * 4 + 1 and compared[0][1] <= 23 * 19 + 2


def test_halving_ends_in_one_task_a_node(spark, monkeypatch):
    rows = [(g, 100_000 * g + i, i * 7919 % 1009, i * 6007 % 2003 if i % 3 else 5) for g, n in ((1, 3000), (2, 500), (3, 1)) for i in range(n)]
    writes, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: writes.append(1) or cut(df))
    points = spark.createDataFrame(rows, "g int, id long, x long, y long").withColumn("parts", F.expr("CASE g WHEN 1 THEN 61 WHEN 2 THEN 10 ELSE 1 END"))
    few = {r.id: (r.g, r["__node"]) for r in C.halved(points, "g", "parts").collect()}
    assert len(few) == len(rows) and len(set(few.values())) == 72 and len(writes) == 2
    monkeypatch.setattr(C, "NODE", 0)  # all rounds
    assert {r.id: (r.g, r["__node"]) for r in C.halved(points, "g", "parts").collect()} == few


def test_feeders_follow_large_numbers_and_sum_in_order(spark):
    first = 2**60
    rows = [(1, first + i, first + i - 1 if i else None, float(i), ["SFH", "Commercial"], [3.1, 0.7], [1.0, 1.0]) for i in range(4)]
    schema = "grid int, node long, parent long, distance double, kinds array<string>, powers array<double>, counts array<double>"
    out = N.lay_branches(spark.createDataFrame(rows, schema), "grid").collect()
    load = C.coincident_load(["SFH", "Commercial"] * 4, [3.1, 0.7] * 4, [1.0, 1.0] * 4)
    assert sorted((r.branch, r.nth, r.node, r.next) for r in out) == [(0, i, first + 3 - i, first + 2 - i if i < 3 else None) for i in range(4)]
    assert all(math.isclose(r.load, load, rel_tol=1e-12) for r in out)
