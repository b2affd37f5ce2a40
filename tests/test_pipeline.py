"""Networks of small villages, end to end."""

from gridloom.functions import electrical as E
from gridloom.plans.pipeline import generate

RING = "array<struct<x:double,y:double>>"


def square(x, y, side=10.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_two_streets(spark):
    houses = [(i, "SFH", 1, square(20.0 * i, 20.0)) for i in range(1, 13)]
    alone = [(50, "SFH", 1, square(500.0, 5020.0))]
    large = [(60, "Commercial", 1, square(300.0, 40.0, 50.0)), (61, "Public", 1, square(350.0, 40.0, 10.0)), (62, "SFH", 1, square(350.0, 80.0))]
    outside = [(70, "SFH", 1, square(50_000.0, 20.0))]
    buildings = spark.createDataFrame(houses + alone + large + outside, f"id int, kind string, floors int, ring {RING}")
    ways = spark.createDataFrame([(1, 101, [(0.0, 0.0), (400.0, 0.0)]), (2, 101, [(400.0, 5000.0), (600.0, 5000.0)]), (3, 101, [(200.0, -50.0), (200.0, 10.0)])], f"id int, clazz int, line {RING}")
    areas = spark.createDataFrame([(1, square(-1000.0, -1000.0, 10_000.0))], f"area int, ring {RING}")
    out = generate(buildings, ways, areas)
    peak = {r.id: r.peak for r in out.buildings.collect()}
    assert set(peak) == {*range(1, 13), 50, 60, 61, 62}
    assert peak[60] == 0 and peak[61] == 0 and peak[62] == E.HOUSEHOLD_KW and peak[1] == E.HOUSEHOLD_KW
    clusters = out.clusters.collect()
    assert len({r.point for r in clusters}) == len(clusters) == 12  # two houses meet at the end of way 3
    assert sum(r.power for r in clusters) == 13 * E.HOUSEHOLD_KW
    sites = {r.grid: r.site for r in out.sites.collect()}
    assert set(sites) == {r.grid for r in clusters}
    lines = out.lines.collect()
    assert sorted(r.node for r in lines) == sorted(r.point for r in clusters)
    assert all(r.cable and r.parallel == 1 for r in lines)
    homes = out.houses.collect()
    assert {r.id for r in homes} == {str(r.id) for r in out.buildings.where("peak <> 0").collect()} - {"50"} | {"50"} and all(r.parallel >= 1 for r in homes)
    longest = max(lines, key=lambda r: -r.nth)
    assert {r.node for r in lines if r.branch == longest.branch and r.grid == longest.grid} >= {longest.node}
    # junctions do not end a feeder: all points of the street share few branches
    assert len({(r.grid, r.branch) for r in lines}) < len(lines)
