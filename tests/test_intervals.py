"""Nearest points by ordered scans, against all pairs."""

import random

import pytest

from cohortloom.operators import intervals

LEFT, RIGHT = "k string, r long, a long, z long, extra int", "k string, p long, name long, a string"


def brute(left, right):
    out = []
    for k, r, a, z, _ in left:
        found = [(max(a - p, p - z, 0), n) for q, p, n, _ in right if None not in (k, a, z, q, p, n) and q == k]
        d, n = min(found, default=(None, None))
        out.append((k, r, n, None if d is None else float(d)))
    return sorted(out, key=repr)


def world(seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["x", "x", "x", "y", "lonely", None])
    left = []
    for i in range(120):
        a = rnd.randint(-50, 50)
        left.append((key(), i % 100, a, a + rnd.choice([0, 0, 0, 3, 20]), 1))
    left += [("x", 200, None, 4, 1), ("x", 201, 5, None, 1), ("x", 7, 1, 1, 1)]
    right = [(rnd.choice(["x", "y", "z", None]), rnd.randint(-80, 80), rnd.randint(0, 30), "c") for _ in range(60)]
    return left, [*right, ("x", None, 3, "c"), ("x", 5, None, "c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_points_against_all_pairs(spark, seed):
    left, right = world(seed)
    got = intervals.nearest_point(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), "k", "r", "a", "z", "p", "name")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right)


def test_slices_carry_the_last_point(spark, tiny_slices):
    left, right = world(3)
    got = intervals.nearest_point(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), "k", "r", "a", "z", "p", "name")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right)


def test_reach_and_empty_tables(spark):
    left, right = spark.createDataFrame([("x", 1, 0, 0, 1), ("x", 2, 9, 9, 1)], LEFT), spark.createDataFrame([("x", 3, 8, "")], RIGHT)
    near = lambda a, b, **more: sorted(map(tuple, intervals.nearest_point(a, b, "k", "r", "a", "z", "p", "name", **more).collect()))
    assert near(left, right, reach=3) == [("x", 1, 8, 3.0), ("x", 2, None, None)]
    assert near(left, right.where("false")) == [("x", 1, None, None), ("x", 2, None, None)]
    assert near(left.where("false"), right) == []
