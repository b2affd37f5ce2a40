"""Unions, rings and buffers against grids of cells and closed forms."""

import math
import random

import pytest

from gridloom.operators import overlay

RING = "array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def corners(df, key="g"):
    out = {}
    for r in df.collect():
        out.setdefault((r[key], r.ring), []).append((r.nth, (r.x, r.y)))
    assert all(sorted(n for n, _ in v) == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [p for _, p in sorted(v)] for k, v in out.items()}


def test_boxes_in_groups(spark):
    rng = random.Random(3)
    boxes = [(g, box(rng.randrange(40), rng.randrange(40), rng.randrange(1, 15), rng.randrange(1, 15))) for g in range(3) for _ in range(30)]
    boxes += [(0, boxes[0][1]), (0, boxes[1][1][::-1]), (1, box(3, 3, 0, 5))]  # a copy, a ring turned round, and one without area
    boxes += [(3, box(0, 0, 10, 10)), (3, box(10, 0, 10, 10)), (3, box(0, 10, 10, 10)), (3, box(20, 10, 5, 5)), (4, box(0, 0, 30, 5)), (4, box(0, 25, 30, 5)), (4, box(0, 0, 5, 30)), (4, box(25, 0, 5, 30)), (5, None)]
    rows = spark.createDataFrame(boxes, f"g int, ring {RING}")
    pieces = overlay.border(rows, "g", cell=7.0)
    got = {r.g: (r.area, r.length) for r in overlay.measures(pieces, "g").collect()}
    found = corners(overlay.rings(pieces, "g"))
    for g in range(5):
        cells = {(x, y) for k, b in boxes if k == g and b for x in range(int(min(p[0] for p in b)), int(max(p[0] for p in b))) for y in range(int(min(p[1] for p in b)), int(max(p[1] for p in b)))}
        edges = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert got[g] == pytest.approx((len(cells), edges))
        mine = [r for (k, _), r in found.items() if k == g]
        assert sum(map(shoelace, mine)) == pytest.approx(len(cells))
        assert sum(math.dist(a, b) for r in mine for a, b in zip(r, r[1:] + r[:1], strict=True)) == pytest.approx(edges)
        for r in mine:  # every corner turns
            assert all((b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(r, r[1:] + r[:1], r[2:] + r[:2], strict=True))
    assert 5 not in got
    three = [r for (k, _), r in found.items() if k == 3]
    assert sorted(map(len, three)) == [4, 6]  # touching in a point only: two rings
    assert sorted(shoelace(r) for (k, _), r in found.items() if k == 4) == [-400.0, 900.0]  # a frame and its hole


def test_slanted_polygons(spark):
    rng = random.Random(1)
    polygons = []
    for _ in range(25):
        x, y, r, n, turn = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(3, 15), rng.randrange(3, 9), rng.uniform(0, 6)
        polygons.append((0, [(x + r * math.cos(turn + 2 * math.pi * i / n), y + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]))
    pieces = overlay.border(spark.createDataFrame(polygons, f"g int, ring {RING}"), "g", cell=11.0)
    area = overlay.measures(pieces, "g").first().area

    def inside(ring, px, py):
        return sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    step = 0.25
    hits = sum(any(inside(r, x * step, y * step) for _, r in polygons) for x in range(-80, 320) for y in range(-80, 320))
    assert area == pytest.approx(hits * step * step, rel=0.01)
    assert sum(map(shoelace, corners(overlay.rings(pieces, "g")).values())) == pytest.approx(area, rel=1e-6)


def test_buffers(spark):
    sides, r = 16, 3.0
    disc = sides / 2 * r * r * math.sin(2 * math.pi / sides)
    lines = [(1, [(0.0, 0.0), (10.0, 0.0), (25.0, 0.0), (40.0, 0.0)]), (2, [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0)]), (3, [(5.0, 5.0), (20.0, 25.0)]), (4, [(0.0, 0.0)])]
    rows = spark.createDataFrame(lines, f"g int, line {RING}")
    got = {r.g: r.area for r in overlay.measures(overlay.buffered(rows, "g", "line", r, sides, 10.0), "g").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == pytest.approx(2 * r * 40 + disc, rel=1e-6) and got[3] == pytest.approx(2 * r * 25 + disc, rel=1e-5)
    # a right angle: two straight parts that share a square of r by r, and the round outer corner
    assert got[2] == pytest.approx(2 * r * 40 + disc - r * r + disc / 4, rel=1e-5)
    area = spark.createDataFrame([(1, box(0, 0, 30, 20), box(0, 0, 30, 20) + [(0.0, 0.0)])], f"g int, ring {RING}, line {RING}")
    whole = overlay.measures(overlay.buffered(area, "g", "line", r, sides, 10.0, "ring"), "g").first()
    assert whole.area == pytest.approx(600 + 2 * r * 50 + disc, rel=1e-6)


def test_network_around_an_area(spark):
    rng = random.Random(5)
    spot = lambda: (rng.uniform(0, 100), rng.uniform(0, 100))
    lines, ring, r = [(i, [spot(), spot()]) for i in range(60)], [(30.0, 30.0), (60.0, 35.0), (50.0, 60.0)], 8.0
    lines += [(100, [(0.0, 45.0), (99.0, 45.0)]), (101, [(40.0, 40.0), (42.0, 41.0)]), (102, [(60.0, 90.0), (90.0, 90.0)])]

    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])

    def distance(line):
        a, b = line
        points = [(a[0] + (b[0] - a[0]) * i / 4000, a[1] + (b[1] - a[1]) * i / 4000) for i in range(4001)]
        sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
        inside = any(all((q[0] - p[0]) * (m[1] - p[1]) - (q[1] - p[1]) * (m[0] - p[0]) > 0 for p, q in sides) for m in points)
        return 0.0 if inside else min(gap(m, *s) for m in points for s in sides)

    far = {i: distance(line) for i, line in lines}
    lines = [x for x in lines if abs(far[x[0]] - r) > 0.2]  # the round ends have sides
    out = overlay.lines_near_polygons(spark.createDataFrame(lines, f"way int, line {RING}"), "line", spark.createDataFrame([(7, ring)], f"area int, ring {RING}"), "ring", r, ("way", "area"), 20.0)
    assert sorted(map(tuple, out.collect())) == sorted((i, 7) for i, _ in lines if far[i] < r)
