"""Nearest neighbours by cells that follow the density, against all pairs."""

import math
import random

import pytest

from gridloom.operators import spatial

LEFT, RIGHT = "a int, area string, ax double, ay double", "b int, of string, bx double, by double"


def brute(left, right, k, grouped, others):
    out = {}
    for a, g, x, y in left:
        if x is not None:
            near = sorted((math.hypot(x - u, y - v), b) for b, h, u, v in right if u is not None and (not grouped or (g == h and g is not None)) and not (others and a == b))[:k]
            out |= {(a, n + 1): (b, pytest.approx(d)) for n, (d, b) in enumerate(near)}
    return out


def scattered(seed):
    """Dense and sparse places, points at one place, one far away, small areas, and nulls."""
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(rng.choice("pq"), rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(60)]
    rows += [("p", 3.0, 3.0)] * 6 + [("q", 1e6, -1e6), ("r", 5.0, 5.0), ("r", 6.0, 5.0), ("p", None, 1.0), (None, 0.0, 0.0)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("grouped", "others"), [(False, True), (True, True), (True, False)])
def test_equals_all_pairs(spark, grouped, others):
    rows = scattered(1)
    right = [r for r in rows if r[0] % 3 or not others] if not others else rows
    got = spatial.nearest(spark.createDataFrame(rows, LEFT), spark.createDataFrame(right, RIGHT), 4, "a", "b", ("ax", "ay"), ("bx", "by"), ("area", "of") if grouped else None, others)
    assert got.columns == ["a", "area", "ax", "ay", "b", "of", "bx", "by", "distance", "nth"]
    assert {(r.a, r.nth): (r.b, r.distance) for r in got.collect()} == brute(rows, right, 4, grouped, others)


def test_few_and_none(spark):
    rows = scattered(2)
    left, right = spark.createDataFrame(rows, LEFT), spark.createDataFrame(rows[:2], RIGHT)
    got = {(r.a, r.nth): (r.b, r.distance) for r in spatial.nearest(left, right, 5, "a", "b", ("ax", "ay"), ("bx", "by")).collect()}
    assert got == brute(rows, rows[:2], 5, False, False)
    assert spatial.nearest(left, right.where("false"), 2, "a", "b", ("ax", "ay"), ("bx", "by")).count() == 0
    assert spatial.nearest(left.where("false"), right, 2, "a", "b", ("ax", "ay"), ("bx", "by")).count() == 0
    one = spark.createDataFrame([(1, "p", 2.0, 2.0)], LEFT)
    assert spatial.nearest(one, one.toDF("b", "of", "bx", "by"), 1, "a", "b", ("ax", "ay"), ("bx", "by")).first().distance == 0


def test_no_pairs_of_all(spark):
    rng = random.Random(3)
    rows = [(i, "p", rng.random(), rng.random()) for i in range(4000)] + [(9999, "p", 1e4, 1e4)]
    left, right = spark.createDataFrame(rows, LEFT), spark.createDataFrame(rows, RIGHT)
    got = spatial.nearest(left.where("a < 4000"), right, 4, "a", "b", ("ax", "ay"), ("bx", "by"), others=True)
    assert got.count() == 16_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
