"""Projections: round trips, fixed points, arcs and shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import projection as P


@pytest.fixture(scope="module")
def grid(spark):
    places = [(float(lon), float(lat)) for lon in np.linspace(5.5, 24.5, 20) for lat in np.linspace(46.5, 55.5, 10)] + [(10.0, 52.0), (15.0, 0.0), (15.0, -30.0)]
    return spark.createDataFrame(places, "lon double, lat double").select(G.point(F.col("lon"), F.col("lat")).alias("g"))


@pytest.mark.parametrize("code", [32633, 3035])
def test_round_trips(grid, code):
    there = grid.select("g", P.reproject(F.col("g"), 4326, code).alias("p"))
    rows = there.select("g", "p", P.reproject(F.col("p"), code, 4326).alias("b")).collect()
    for r in rows:
        if code == 3035 and r.g.y < 40:
            continue
        assert math.hypot((r.b.x - r.g.x) * 111_000, (r.b.y - r.g.y) * 111_000) < 1e-3, r
    other = there.select(P.reproject(P.reproject(F.col("p"), code, 3035 if code == 32633 else 32633), 3035 if code == 32633 else 32633, code).alias("q"), "p", "g")
    assert all(math.hypot(r.p.x - r.q.x, r.p.y - r.q.y) < 1e-3 for r in other.collect() if r.g.y > 40)


def test_meridian_arc_and_symmetry(spark):
    f, a = P.FLATTENING, P.AXIS
    e2 = f * (2 - f)
    for lat in (10.0, 48.0, 60.0):
        phi = np.linspace(0, math.radians(lat), 200_001)
        radius = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
        arc = ((radius[1:] + radius[:-1]) / 2 * np.diff(phi)).sum()
        rows = spark.createDataFrame([(15.0, lat), (12.0, lat), (18.0, lat)], "x double, y double").select(P.to_utm33(F.col("x"), F.col("y")).alias("p")).collect()
        assert rows[0].p.x == pytest.approx(500_000, abs=1e-6) and rows[0].p.y == pytest.approx(0.9996 * arc, abs=1e-3)
        assert rows[1].p.x + rows[2].p.x == pytest.approx(1_000_000, abs=1e-6) and rows[1].p.y == pytest.approx(rows[2].p.y, abs=1e-6)


def test_utm_keeps_angles_and_europe_keeps_areas(spark):
    e2, h = P.FLATTENING * (2 - P.FLATTENING), 1e-4
    places = [(9.0, 48.0), (13.4, 52.5), (16.0, 50.0)]
    for lon, lat in places:
        s = math.sin(math.radians(lat))
        north = P.AXIS * (1 - e2) / (1 - e2 * s * s) ** 1.5 * math.radians(h)
        east = P.AXIS / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(lat)) * math.radians(h)
        around = spark.createDataFrame([(lon + h, lat), (lon - h, lat), (lon, lat + h), (lon, lat - h)], "x double, y double")
        for code in (32633, 3035):
            e, w, n, t = (r.p for r in around.select(P.reproject(G.point(F.col("x"), F.col("y")), 4326, code).alias("p")).collect())
            dx, dy = ((e.x - w.x) / (2 * east), (e.y - w.y) / (2 * east)), ((n.x - t.x) / (2 * north), (n.y - t.y) / (2 * north))
            if code == 32633:
                assert dx[0] == pytest.approx(dy[1], rel=1e-6) and dx[1] == pytest.approx(-dy[0], abs=1e-6)
            else:
                assert dx[0] * dy[1] - dx[1] * dy[0] == pytest.approx(1, rel=1e-6)


def test_centre_and_unknown_codes(spark):
    r = spark.range(1).select(P.from_laea_europe(F.lit(4321000.0), F.lit(3210000.0)).alias("c"), P.reproject_line(F.array(G.point(F.lit(15.0), F.lit(0.0))), 4326, 32633).alias("l")).first()
    assert (r.c.x, r.c.y) == (pytest.approx(10.0), pytest.approx(52.0)) and (r.l[0].x, r.l[0].y) == (500_000.0, 0.0)
    with pytest.raises(ValueError, match="31467"):
        P.reproject(F.col("p"), 31467, 3035)
