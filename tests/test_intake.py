"""New scenes kept once by a keyed state."""

from pyspark.sql import functions as F

from eoframe.streaming import intake

SCHEMA = "scene_id string, datetime timestamp, properties map<string,string>"


def _arrive(spark, folder, rows):
    made = spark.createDataFrame(rows, "scene_id string, day string, properties map<string,string>")
    made.select("scene_id", F.col("day").cast("timestamp").alias("datetime"), "properties").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _run(spark, folder):
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = intake.stream_new_scenes(arrivals, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return query


def _table(spark, folder):
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r.scene_id, str(r.datetime)[:10], r.properties) for r in rows), key=str)


def test_scenes_with_maps_in_falling_order_and_repeated_runs(spark, tmp_path):
    _arrive(spark, tmp_path, [("a", "2024-06-02", {"k": "2"}), ("a", "2024-06-01", {"k": "9"}), ("a", "2024-06-01", {"k": "1"}), ("b", None, None)])
    _arrive(spark, tmp_path, [("a", "1999-01-01", {"k": "0"}), ("c", "2020-01-01", {}), (None, "2020-01-01", None), (None, "2019-01-01", None)])
    _run(spark, tmp_path)
    want = [("a", "2024-06-01", {"k": "1"}), ("b", "None", None), ("c", "2020-01-01", {}), (None, "2019-01-01", None)]
    assert _table(spark, tmp_path) == sorted(want, key=str)
    _run(spark, tmp_path)  # nothing arrived
    _arrive(spark, tmp_path, [("d", "1960-01-01", None), ("c", "1950-01-01", None), (None, None, None)])
    _run(spark, tmp_path)
    assert _table(spark, tmp_path) == sorted([*want, ("d", "1960-01-01", None)], key=str)


def test_a_batch_does_not_read_the_table(spark, tmp_path):
    """A batch's input is what arrived; the table may even be unreadable to it."""
    _arrive(spark, tmp_path, [(f"s{i}", "2024-01-01", None) for i in range(500)])
    _run(spark, tmp_path)
    _arrive(spark, tmp_path, [("s7", "2023-01-01", None), ("new", "2023-01-01", None)])
    query = _run(spark, tmp_path)
    plan = query._jsq.explainInternal(False)
    assert "/in" in plan and "/out" not in plan
    assert sum(p.numInputRows for p in query.recentProgress) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 501
