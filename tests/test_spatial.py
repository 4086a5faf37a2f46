import numpy as np
import pytest

from cellweave.operators.spatial import RTree, build_forest, near_and_inside

POINTS = "cell_id long, stack string, section int, x int, y int, vertices string"
RINGS = "annotation_id long, stack string, section int, vertices array<struct<x:double,y:double>>, x int"


def brute(points, rings, r):
    out = set()
    for a in points:
        for b in points:
            if None not in a[1:5] and None not in b[1:5] and a[0] < b[0] and a[1:3] == b[1:3] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= r * r:
                out.add((a[0], "cell", b[0]))
    for i, s, c, v, _ in rings:
        if v is None or len(v) < 3 or s is None or c is None:
            continue
        for a in points:
            if None in a[1:5] or a[1:3] != (s, c):
                continue
            odd = False
            for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1], strict=True):
                if (y0 > a[4]) != (y1 > a[4]) and a[3] < (x1 - x0) * (a[4] - y0) / (y1 - y0) + x0:
                    odd = not odd
            if odd:
                out.add((a[0], "region", i))
    return out


@pytest.mark.parametrize("capacity,hot", [(4000, 50000), (20, 50000), (20, 7)])
def test_against_brute_force(spark, capacity, hot):
    rng = np.random.default_rng(2)
    points = [(i, "a" if i % 2 else "b", 1 if i % 5 else 2, int(x), int(y), "") for i, (x, y) in enumerate(rng.integers(0, 120, (300, 2)))]
    points += [(1000 + i, "a", 1, 33, 33, "") for i in range(25)] + [(2000, None, 1, 1, 1, ""), (2001, "a", None, 1, 1, ""), (2002, "a", 1, None, 1, "")]
    ring = [(10.5, 10.5), (90.5, 20.5), (60.5, 100.5), (40.5, 40.5)]
    rings = [(1, "a", 1, ring, 0), (2, "b", 1, ring + ring[:1], 0), (3, "a", 1, ring[:2], 0), (4, "a", 1, None, 0), (5, None, 1, ring, 0), (6, "a", 1, ring[::-1], 0), (7, "a", 1, [], 0)]
    got = near_and_inside(spark.createDataFrame(points, POINTS), spark.createDataFrame(rings, RINGS), 15.0, ("stack", "section"), capacity=capacity, hot=hot).collect()
    got = [tuple(r) for r in got]
    assert len(got) == len(set(got))
    assert set(got) == brute(points, rings, 15)


def test_empty(spark):
    points, rings = spark.createDataFrame([], POINTS), spark.createDataFrame([], RINGS)
    assert near_and_inside(points, rings, 15.0, ("stack", "section")).count() == 0


def test_rtree_probe():
    rng = np.random.default_rng(3)
    for n in (1, 16, 17, 1000):
        x, y = rng.random(n), rng.random(n)
        boxes = np.sort(rng.random((50, 2, 2)), axis=1).reshape(50, 4)
        q, e = RTree(x, y).probe(boxes)
        want = {(i, j) for i, b in enumerate(boxes) for j in range(n) if b[0] <= x[j] <= b[2] and b[1] <= y[j] <= b[3]}
        assert set(zip(q.tolist(), e.tolist(), strict=True)) == want and len(q) == len(want)


def test_forest_gives_each_point_one_home():
    rng = np.random.default_rng(4)
    p = rng.random((500, 2)) * 100
    f = build_forest([("a", 1, *q) for q in p], (0, 0, 100, 100), 1, 30, 1)
    row, leaf = f.leaves_of(np.zeros(500, dtype=int), p[:, 0], p[:, 1], p[:, 0], p[:, 1])
    assert sorted(row) == list(range(500)) and np.bincount(leaf).max() <= 30
