"""Projection back and forth, and scenes of neighbouring zones on one grid."""

import math

import pytest
from pyspark.sql import functions as F

from eoframe.functions.geo import reproject, utm_forward, utm_inverse
from eoframe.operators.grid import Grid, align_scenes, crop_geographic
from eoframe.plans.optical import on_common_grid


def test_round_trip_below_a_millimetre(spark):
    points = [(lon / 4, lat, e) for e, m in ((32616, -87), (32717, -81), (32631, 3)) for lon in range(m * 4 - 13, m * 4 + 14, 2)
              for lat in (-80.0, -45.3, -9.95, 0.0, 9.95, 52.1, 83.9)]
    df = spark.createDataFrame(points, "lon double, lat double, epsg int")
    there = df.withColumn("p", utm_forward(F.col("lon"), F.col("lat"), F.col("epsg"))).withColumn("q", utm_inverse(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    again = there.withColumn("r", utm_forward(F.col("q.lon"), F.col("q.lat"), F.col("epsg")))
    for r in again.collect():
        assert math.hypot(r.p.x - r.r.x, r.p.y - r.r.y) < 1e-3
        assert abs(r.q.lon - r.lon) < 1e-8 and abs(r.q.lat - r.lat) < 1e-8
    assert df.select(utm_inverse(F.col("lon"), F.col("lat"), F.lit(4326)).alias("q")).where("q IS NOT NULL").count() == 0


def test_equal_codes_and_degrees(spark):
    r = spark.range(1).select(
        reproject(F.lit(512345.5), F.lit(1e6), F.lit(32616), F.lit(32616)).alias("a"),
        reproject(F.lit(-84.0), F.lit(10.0), F.lit(4326), F.lit(32616)).alias("b"), reproject(F.lit(1.0), F.lit(2.0), F.lit(1), F.lit(2)).alias("c")).first()
    assert tuple(r.a) == (512345.5, 1e6) and r.c is None and abs(r.b.x - 828928.74) < 0.1


def place(spark, rows):
    return {r.i: (r.p.x, r.p.y) for r in spark.createDataFrame(rows, "i int, x double, y double, s int, t int").select("i", reproject(*[F.col(c) for c in "xyst"]).alias("p")).collect()}


def test_two_zones_against_brute_force(spark):
    target = Grid(780_000.0, 1_100_000.0, 20.0, -20.0, 12, 10)
    # a frame of the next zone that covers it, by its own corner
    x, y = place(spark, [(0, 779_800.0, 1_100_200.0, 32616, 32617)])[0]
    frame = (float(math.floor(x)), float(math.ceil(y)), 30.0, -30.0, 32617)
    cols, rows = 30, 30
    value = lambda c, q: None if (c * 7 + q) % 11 == 0 else float(c * 3 + q * q % 17)
    data = [("z17", c, q, *frame, value(c, q)) for c in range(cols) for q in range(rows)]
    data += [("own", c, q, target.x0, target.y0, target.dx, target.dy, 32616, float(c - q)) for c in range(14) for q in range(10)]
    data += [("lost", 1, 1, None, 1.0, 1.0, 1.0, 32616, 1.0), ("lost", 1, 2, 1.0, 1.0, 1.0, 1.0, None, 1.0), ("odd", 1, 1, 1.0, 1.0, 1.0, 1.0, 3857, 1.0)]
    schema = "scene string, px_col int, px_row int, x0 double, y0 double, dx double, dy double, epsg int, v double"
    got, rejected = align_scenes(spark.createDataFrame(data, schema), target, 32616, ["scene"], ["v"])
    have = {(r.scene, r.px_col, r.px_row): r.v for r in got.collect()}
    assert {(r.scene, r.n_rows) for r in rejected.collect()} == {("lost", 2), ("odd", 1)}
    centres = [(c * 100 + q, target.x0 + (c + 0.5) * 20, target.y0 - (q + 0.5) * 20, 32616, 32617) for c in range(12) for q in range(10)]
    seen = 0
    for i, (sx, sy) in place(spark, centres).items():
        u, w = (sx - frame[0]) / 30 - 0.5, (sy - frame[1]) / -30 - 0.5
        total = weight = 0.0
        for c in (math.floor(u), math.floor(u) + 1):
            for q in (math.floor(w), math.floor(w) + 1):
                k = (1 - abs(u - c)) * (1 - abs(w - q))
                if 0 <= c < cols and 0 <= q < rows and k > 0 and value(c, q) is not None:
                    total, weight = total + k * value(c, q), weight + k
        key = ("z17", i // 100, i % 100)
        assert (key in have) == (weight > 0)
        if weight:
            seen += 1
            assert have[key] == pytest.approx(total / weight, abs=1e-6)
    assert seen > 100
    assert {k: v for k, v in have.items() if k[0] == "own"} == {("own", c, q): float(c - q) for c in range(12) for q in range(10)}


def test_crop_in_degrees_reaches_the_scan(spark, tmp_path):
    rows = [(i, 812_000.0 + i * 500, 1_100_000.0) for i in range(60)]
    spark.createDataFrame(rows, "i int, x double, y double").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    box = (-84.1, 9.9, -84.0, 10.0)
    cut = crop_geographic(df, box, 32616)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x," in plan and "atanh" not in plan.lower()
    edge = place(spark, [(k, lon, lat, 4326, 32616) for k, (lon, lat) in enumerate((a + (b - a) * f / 8, s) for a, b in ((-84.1, -84.0),) for s in (9.9, 10.0) for f in range(9))])
    low, high = min(x for x, _ in edge.values()), max(x for x, _ in edge.values())
    assert [r.i for r in cut.orderBy("i").collect()] == [i for i, x, _ in rows if low <= x <= high]
    ring = [[(-84.06, 9.8), (-83.9, 9.8), (-83.9, 10.2), (-84.06, 10.2)]]
    inner = {r.i for r in crop_geographic(df, box, 32616, rings=ring).collect()}
    west = place(spark, [(0, -84.06, 9.948, 4326, 32616)])[0][0]
    assert inner == {i for i, x, _ in rows if west < x <= high}


def test_the_first_dry_scene_is_the_grid(spark):
    chosen = spark.createDataFrame([(1, "2024-07-01"), (2, "2024-02-01"), (3, "2024-01-05")], "scene_id int, day string").select("scene_id", F.to_date("day").alias("acquired"))
    frames = spark.createDataFrame([(1, 0.0, 0.0, 10.0, -10.0, 2, 2, 32616), (2, 10.0, 0.0, 10.0, -10.0, 2, 2, 32616), (3, None, 0.0, 1.0, 1.0, 2, 2, 32616)],
                                   "scene_id int, x0 double, y0 double, dx double, dy double, cols int, rows int, epsg int")
    values = chosen.select("scene_id", "acquired", F.lit("NDVI").alias("index"), F.lit("g").alias("grid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("px_col"), F.lit(0).alias("px_row"),
                           F.lit(0.5).alias("value"))
    got, lost = on_common_grid(values, chosen, frames, (1, 2, 3), ("grid", "px_col", "px_row"))
    assert sorted((r.scene_id, r.px_col) for r in got.collect()) == [(1, 0), (2, 0), (2, 1)]
    assert [(r.scene_id, r.n_rows) for r in lost.collect()] == [(3, 2)]
