"""Findings of the first review, each held by a test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions.text import equal_interval_labels, iso_timestamp
from eoframe.operators.catalog import collect_new
from eoframe.operators.coefficients import GROUPS, tasseled_cap_from
from eoframe.operators.grid import Grid, align_to_reference
from eoframe.operators.ranks import exact_quantiles
from eoframe.operators.seasonal import seasonal_amplitude
from eoframe.plans.optical import optical_run
from eoframe.streaming import intake


def test_old_scenes_are_kept_over_many_batches(spark, tmp_path):
    schema = "scene_id long, datetime timestamp"
    days = ["2024-06-01", "2020-01-01", "1999-05-05"]
    for i, day in enumerate(days):
        rows = spark.createDataFrame([(i, day), (9, day)], "scene_id long, day string")
        rows.select("scene_id", F.col("day").cast("timestamp").alias("datetime")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        intake.stream_new_scenes(arrivals, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted(r.scene_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0, 1, 2, 9]


def test_quantiles_leave_out_nan_and_infinity(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, float("nan"), float("inf"), float("-inf"), None)], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", [0.5]).first()
    assert (r.n_total, r.n_valid, r.v_max, r.q0) == (6, 2, 2.0, 1.5)


def test_quantiles_of_values_close_together(spark):
    rng = np.random.default_rng(5)
    close = np.concatenate([290.0 + rng.random(30_000) / 10, np.full(4_000, 290.05), rng.normal(size=500)])
    rows = [(k, float(sign * v)) for k, sign in (("a", 1), (None, -1)) for v in close] + [("one", 7.0)] * 3000
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = (0.02, 0.25, 0.5, 0.75, 0.98)
    for bound in (1000, 10**6):
        got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, split=bound).collect()}
        for k, sign in (("a", 1), (None, -1)):
            want = np.quantile(sign * close, probs)
            assert [got[k][f"q{i}"] for i in range(5)] == pytest.approx(list(want), abs=1e-12)
            assert got[k].n_valid == len(close)
        assert [got["one"][f"q{i}"] for i in range(5)] == [7.0] * 5


def test_rows_without_a_frame_stay(spark):
    df = spark.createDataFrame([("s", 0, 0, 0.0, 0.0, 1.0, -1.0, 5.0), ("t", 1, 0, None, None, None, None, 6.0)],
                               "scene string, px_col int, px_row int, x0 double, y0 double, dx double, dy double, v double")
    grid = Grid(x0=0.0, y0=0.0, dx=1.0, dy=-1.0, cols=2, rows=2)
    assert sorted((r.scene, r.v) for r in align_to_reference(df, grid, ["scene"], ["v"]).collect()) == [("s", 5.0), ("t", 6.0)]


def test_interval_labels(spark):
    df = spark.createDataFrame([(-1.0, 2.0, 3), (0.0, 1.0, 2), (-0.5, 1.0, 4)], "lo double, hi double, n int")
    got = [r.x for r in df.select(equal_interval_labels(F.col("lo"), F.col("hi"), F.col("n")).alias("x")).collect()]
    assert [tuple(c) for c in got[0]] == [(1, "-1.000 – 0.000", False), (2, "0.000 – 1.000", False), (3, "1.000 – 2.000", False)]
    assert len(got[1]) == 3 and not got[1][0].zero_off
    assert all(c.zero_off for c in got[2]) and got[2][3].label == "0.625 – 1.000"


def test_a_row_is_collected_once_whatever_its_order(spark):
    old = spark.createDataFrame([(1, "a", {"k": "v"})], "id int, t string, m map<string,string>")
    new = [(1, "z", {}), (2, "b", {"k": "1"}), (2, "c", None), (3, None, {})]
    one, two = (sorted((r.id, r.t) for r in collect_new(old, spark.createDataFrame(rows, old.schema), ["id"]).collect() if r.id < 3) for rows in (new, new[::-1]))
    assert one == two and len(one) == 2 and one[0] == (1, "a")


def test_snapshots_are_marked_and_expire(spark, tmp_path):
    schema = "batch_name string, job_id string, observed_at long, status_code string"
    for i in range(4):
        spark.createDataFrame([("b", "j", i, f"s{i}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        intake.stream_job_status(arrivals, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["batch=2", "batch=3"]
    spark.range(1).write.parquet(f"{tmp_path}/out/batch=9")
    (tmp_path / "out/batch=9/_SUCCESS").unlink()
    assert [r.status_code for r in intake.read_job_status(spark, f"{tmp_path}/out").collect()] == ["s3"]


def test_a_batch_of_one_job_rewrites_one_bucket(spark, tmp_path):
    schema, out = "batch_name string, job_id string, observed_at long, status_code string", f"{tmp_path}/out"
    first = [("b", f"j{i}", 1, "new") for i in range(200)] + [("b", None, 1, "new")]
    intake.merge_status(spark.createDataFrame(first, schema), 0, out, buckets=8)
    second = spark.createDataFrame([("b", "j7", 2, "done"), ("b", "j7", 0, "late")], schema)
    for _ in range(2):  # a batch that is run again
        intake.merge_status(second, 1, out, buckets=8)
        assert len(list((tmp_path / "out/batch=0").glob("_bucket=*"))) == 8
        assert len(list((tmp_path / "out/batch=1").glob("_bucket=*"))) == 1
        got = {r.job_id: r.status_code for r in intake.read_job_status(spark, out).collect()}
        assert len(got) == 201 and got["j7"] == "done" and sum(v == "new" for v in got.values()) == 200
    # half a commit is not seen, and the next run of that batch makes it whole
    (tmp_path / "out/batch=1/_SUCCESS").unlink()
    assert {r.status_code for r in intake.read_job_status(spark, out).collect()} == {"new"}
    intake.merge_status(second, 1, out, buckets=8)
    intake.merge_status(spark.createDataFrame([("b", "j7", 3, "gone")], schema), 2, out, buckets=8)
    assert len(list((tmp_path / "out/batch=0").glob("_bucket=*"))) == 7
    assert {r.status_code for r in intake.read_job_status(spark, out).where("job_id = 'j7'").collect()} == {"gone"}
    assert intake.read_job_status(spark, out).count() == 201


def test_the_run_is_cropped_and_plans_only_what_is_asked(spark):
    scenes = spark.createDataFrame([(1, "2024-01-05", 5.0), (2, "2024-03-05", 5.0)], "scene_id int, day string, cloud_pct double").select(
        "scene_id", F.to_date("day").alias("acquired"), "cloud_pct", F.lit("c").alias("collection"),
        *[F.lit(v).alias(c) for c, v in (("west", 0.0), ("south", 0.0), ("east", 10.0), ("north", 10.0))])
    # clear inside the box, clouded outside
    pixels = spark.createDataFrame([(s, x, 1.0, 9 if x > 4 else 4) for s in (1, 2) for x in (1.0, 2.0, 5.0, 6.0)], "scene_id int, x double, y double, scl int").selectExpr(
        "*", "'s2' AS family", "'03.01' AS baseline", "3000 AS nir08", "1000 AS swir22", "0 AS qa_pixel", "'g' AS grid", "CAST(x AS INT) AS px_col", "1 AS px_row",
        "CASE scene_id WHEN 1 THEN DATE '2024-01-05' ELSE DATE '2024-03-05' END AS acquired")
    ask = dict(collection="c", bbox=(0.0, 0.0, 4.0, 4.0), start="2024-01-01", end="2024-12-31", indices=("NBR",), aoi_cloud_max=50.0, fire_date="2024-02-01", xy=("x", "y"))
    out = optical_run(scenes, pixels, **ask, products=("scenes", "fire_scenes", "dnbr"))
    assert set(out) == {"scenes", "fire_scenes", "dnbr"}
    assert sorted((r.scene_id, r.aoi_cloud_pct) for r in out["scenes"].collect()) == [(1, 0.0), (2, 0.0)]
    assert sorted((r.px_col, r.dnbr) for r in out["dnbr"].collect()) == [(1, 0.0), (2, 0.0)]
    assert optical_run(scenes, pixels, **{**ask, "xy": None}, products=("scenes",))["scenes"].count() == 2
    with pytest.raises(ValueError):
        optical_run(scenes, pixels, **ask, products=("amplitude",))


def test_one_median_for_few_and_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, m, float(v)) for k in range(12) for m in (1, 7) for v in rng.random(4 + k % 3 * 2)]
    df = spark.createDataFrame(rows, "px int, month int, value double").withColumn("index", F.lit("NDVI"))
    ask = dict(keys=("index", "px"), dry=(1,), wet=(7,), min_obs=1)
    some = [sorted(map(tuple, seasonal_amplitude(df, **ask, **hot).collect())) for hot in ({}, {"hot_floor": 1, "hot_share": 0.0})]
    assert some[0] == some[1]


def test_white_space_around_dates(spark):
    texts = ["2025-01-02\n", "\t2025-01-02T03:04:05Z ", "  2025/01/02\r\n", "2025-01-02 x", "225-01-002"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(iso_timestamp(F.col("t")).alias("x")).collect()]
    assert got == ["2025-01-02", "2025-01-02T03:04:05Z", "2025-01-02", None, None]


def test_maps_arrive_and_a_batch_may_run_twice(spark, tmp_path):
    schema = "scene_id string, datetime timestamp, properties map<string,string>"
    batch = spark.createDataFrame([("a", None, {"k": "2"}), ("a", None, {"k": "1"}), ("b", None, None)], schema)
    for _ in range(2):
        intake.append_new(batch, f"{tmp_path}/out")
    got = sorted((r.scene_id, r.properties) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", {"k": "1"}), ("b", None)]


def test_a_coefficient_group_that_comes_twice_is_refused(spark):
    one = [1.0] * 6
    table = spark.createDataFrame([(GROUPS[0], one, one, one)] * 2, "grp string, b array<double>, g array<double>, w array<double>")
    pixels = spark.createDataFrame([(GROUPS[0], *one)], "tc_group string, " + ", ".join(f"{b} double" for b in dims.TC_BANDS))
    assert tasseled_cap_from(pixels, table.limit(1)).count() == 1
    with pytest.raises(Exception, match="twice"):
        tasseled_cap_from(pixels, table).collect()
