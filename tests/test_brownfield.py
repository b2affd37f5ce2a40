"""Villages with mapped transformers, from buildings to classes."""

import pytest
from test_pipeline import RING, square

from gridloom.functions import electrical as E
from gridloom.operators import cluster, graph
from gridloom.plans import classification
from gridloom.plans.pipeline import generate


@pytest.fixture(scope="module")
def village(spark):
    """Area 1: 40 houses along 800 m and a transformer at its start; area 2: a village without, and a lone house near one."""
    houses = [(i, "SFH", 1, square(20.0 * i - 5, 15.0)) for i in range(1, 41)]
    houses += [(100 + i, "MFH" if i % 3 else "Public", 2, square(20.0 * i - 5, 20_015.0)) for i in range(1, 9)]
    houses += [(200, "SFH", 1, square(95.0, 40_015.0)), (201, "SFH", 1, square(795.0, 40_015.0))]
    houses += [(300, "Commercial", 1, square(400.0, -100.0, 60.0))]  # supplies itself; a transformer is inside
    buildings = spark.createDataFrame(houses, f"id int, kind string, floors int, ring {RING}")
    ways = spark.createDataFrame([(n, 101, [(0.0, y), (900.0, y)]) for n, y in ((1, 0.0), (2, 20_000.0), (3, 40_000.0))], f"id int, clazz int, line {RING}")
    areas = spark.createDataFrame([(1, square(-1000.0, -1000.0, 10_000.0)), (2, square(-1000.0, 19_000.0, 30_000.0))], f"area int, ring {RING}")
    found = [("t1", 10.0, -12.0), ("t2", 430.0, -70.0), ("t3", 60.0, 40_008.0), ("far", 90_000.0, 0.0), ("t4", 880.0, 20_012.0)]
    return generate(buildings, ways, areas, spark.createDataFrame(found, "id string, x double, y double"))


def test_mapped_and_synthesised_grids(village):
    sites = {r.grid: r for r in village.sites.collect()}
    assert {(r.transformer, r.mapped) for r in sites.values()} == {("t1", True), ("t3", True), (None, False)}  # t2 is indoors, t4 serves nothing, one is outside
    of = {r.id: r.grid for r in village.buildings.collect()}
    t1 = next(g for g, r in sites.items() if r.transformer == "t1")
    # the way is 12 m to the street and then along it; points at 20 * i
    assert {i for i, g in of.items() if g == t1} == {i for i in range(1, 41) if 12 + abs(20 * i - 10) < cluster.REACH}
    assert sites[t1].number == -1 and (sites[t1].x, sites[t1].y) == (10.0, -12.0)
    n = sum(g == t1 for g in of.values())
    load = n * E.HOUSEHOLD_KW * (0.07 + 0.93 * n**-0.75)
    assert sites[t1].load == pytest.approx(load) and sites[t1].size_kva == min(c for c in E.MAPPED_CAPACITIES if c > load)
    assert sites[t1].moment == pytest.approx(sum(E.HOUSEHOLD_KW * (12 + abs(20 * i - 10)) for i in range(1, n + 1)))
    left = [i for i in range(1, 41) if of[i] != t1]
    assert left and all(of[i] is not None and not sites[of[i]].mapped and sites[of[i]].number >= 1 for i in left)
    assert of[200] == next(g for g, r in sites.items() if r.transformer == "t3") and of[201] is None  # one house alone beside a mapped transformer
    assert of[300] is None and {of[100 + i] for i in range(1, 9)}.isdisjoint({t1, of[200], None})


def test_every_served_house_has_its_lines(village):
    of = {r.id: r.grid for r in village.houses.collect()}
    lines = classification.radial_lines(village).collect()
    assert sorted(r.child[1:] for r in lines if r.child[0] == "h") == sorted(i for i, g in of.items() if g is not None)
    paths = graph.tree_paths(classification.radial_lines(village), "root", "length_km", ("grid",)).collect()
    assert len(paths) == len(lines)  # all lines hang on a transformer, and none twice
    t1 = next(r for r in village.sites.collect() if r.transformer == "t1")
    far = {r.vertex: r.distance for r in paths if r.grid == t1.grid and r.vertex.startswith("h")}
    assert far["h1"] == pytest.approx((12 + 10 + 20) / 1000) and far["h14"] == pytest.approx((12 + 270 + 20) / 1000)


def test_parameters_and_classes(spark, village):
    rows = {r.grid: r for r in classification.parameters(village).collect()}
    sites = {r.grid: r for r in village.sites.collect()}
    assert set(rows) == set(sites) and all(rows[g].osm_trafo == sites[g].mapped and rows[g].transformer_mva == sites[g].size_kva / 1000 for g in rows)
    t1 = next(g for g, r in sites.items() if r.transformer == "t1")
    assert rows[t1].no_house_connections == 15 - 1 and rows[t1].house_distance_km == pytest.approx((20 + 20 + 40 + 40) / 4000)
    skipped = classification.parameters(village, spark.createDataFrame([(t1,)], "grid long"))
    assert {r.grid for r in skipped.collect()} == set(rows) - {t1}
    labels, named = classification.classes(classification.parameters(village), 2)
    label = {r.grid: r.cluster for r in labels.collect()}
    reps = {r.cluster: r.representative for r in named.collect()}
    assert set(label) <= set(rows) and set(label.values()) == {0, 1} == set(reps) and all(label[g] == c for c, g in reps.items())
    assert rows[reps[0]].cable_length_km < rows[reps[1]].cable_length_km


def test_points_with_several_classes_are_given_whole(spark):
    costs = spark.createDataFrame([(1, 7, 1, 10.0), (1, 8, 1, 20.0)], "area int, consumer int, transformer int, cost double")
    users = spark.createDataFrame([(1, 7, "SFH", 30.0, 1), (1, 7, "Public", 600.0, 1), (1, 8, "SFH", 30.0, 1)], "area int, consumer int, kind string, power double, count int")
    assert cluster.assign_to_transformers(costs, users, "area").count() == 0  # 630 kW in one place fill it
    users = spark.createDataFrame([(1, 7, "SFH", 30.0, 1), (1, 7, "Public", 500.0, 1), (1, 8, "SFH", 30.0, 1)], "area int, consumer int, kind string, power double, count int")
    got = {r.consumer: r.load for r in cluster.assign_to_transformers(costs, users, "area").collect()}
    assert set(got) == {7, 8} and got[7] == pytest.approx(500 + 60 * (0.07 + 0.93 * 2**-0.75))
