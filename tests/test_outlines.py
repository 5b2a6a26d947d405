"""Cut lines of many points."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from eoframe.operators.grid import crop_polygon


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _star(n, radius, cx=0.0, cy=0.0):
    angles = [2 * math.pi * i / n for i in range(n)]
    return [(cx + radius * (1 + 0.3 * math.sin(9 * a)) * math.cos(a), cy + radius * (1 + 0.3 * math.sin(9 * a)) * math.sin(a)) for a in angles]


def _points(spark, n, reach):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-reach, reach, (n, 2)))]
    rows += [(n, None, 0.0), (n + 1, 0.0, None), (n + 2, float("nan"), 0.0)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_strips_answer_as_brute_force(spark):
    rings = [_star(300, 5.0), _star(200, 2.0, 1.0, 1.0), [(6.0, 6.0), (8.0, 6.0), (8.0, 8.0), (6.0, 8.0), (6.0, 6.0)]]
    # points at the height of corners too
    corners = spark.createDataFrame([(10_000 + i, x - 0.5, y) for i, (x, y) in enumerate(rings[0][::7] + rings[2])], "id long, x double, y double")
    points = _points(spark, 2000, 9.0).unionByName(corners)
    want = {r.id for r in points.collect() if r.x is not None and r.y is not None and r.x == r.x and _inside(r.x, r.y, rings)}
    strips, literals = (crop_polygon(points, rings, literal=n) for n in (0, 10**6))
    assert {r.id for r in strips.collect()} == {r.id for r in literals.collect()} == want
    assert strips.columns == points.columns


def test_repeated_rows_stay_and_flat_outlines_hold_nothing(spark):
    points = spark.createDataFrame([(0.5, 0.5)] * 3 + [(2.0, 0.5)], "x double, y double")
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    assert crop_polygon(points, square, literal=0).count() == 3
    assert crop_polygon(points.limit(0), square, literal=0).count() == 0
    assert crop_polygon(points, [[(0.0, 0.5), (3.0, 0.5)]]).count() == 0


def test_tall_teeth_keep_the_strip_table_small(spark):
    # every edge spans the whole height, so one strip has to do
    teeth = [[(i * 0.5, float(i % 2)) for i in range(400)] + [(200.0, -1.0), (0.0, -1.0)]]
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(0, 200, 500), rng.uniform(-1, 1, 500)))]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    assert {r.id for r in crop_polygon(points, teeth).collect()} == {i for i, x, y in rows if _inside(x, y, teeth)}


def test_an_outline_of_a_hundred_thousand_edges(spark):
    n = 100_000
    ring = _star(n, 5.0)
    points = _points(spark, 20_000, 7.0)
    began = time.time()
    cropped = crop_polygon(points, [ring])
    assert "Exchange hashpartitioning(_strip" not in cropped._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = {r.id for r in cropped.collect()}
    assert time.time() - began < 60
    # the outline is the star to within a chord's height: compare away from it
    for r in points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x")).collect():
        gap = math.hypot(r.x, r.y) - 5.0 * (1 + 0.3 * math.sin(9 * math.atan2(r.y, r.x)))
        if abs(gap) > 1e-3:
            assert (r.id in got) == (gap < 0)
