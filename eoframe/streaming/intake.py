"""New scenes and job states as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 32
# A Python call and a state for each key would cost milliseconds a key.
SEEN_BUCKETS = 4096


def append_new(batch: DataFrame, out_path: str, key: Sequence[str] = ("scene_id",), order: Sequence[str] = ("datetime",)) -> None:
    """Append the rows of ``batch`` whose key the Parquet table does not have yet.

    Of rows with the same key in the batch the first by ``order`` (then by all
    columns) stays.  A batch that is run again finds its keys there.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in key]
    rank = F.struct(*order, F.to_json(F.struct(*rest)))  # columns of any type, maps too
    fresh = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])
    fs, folder = _hadoop(spark, out_path)
    if fs.exists(folder):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(out_path).select(*key), list(key), "left_anti")
    fresh.select(*batch.columns).write.mode("append").parquet(out_path)


def _first_of_keys(rank: str, columns: Sequence[str]):
    """State function of :func:`stream_new_scenes` for a bucket: the first row of each key that was never seen."""

    def pick(_bucket, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        known = len(seen)
        best = None
        for piece in pieces:  # rows come in batches, of which one row a new key is held
            fresh = piece[~piece["_key"].isin(seen)] if known else piece
            best = fresh if best is None or not len(best) else pd.concat([best, fresh]) if len(fresh) else best
            best = best.sort_values(rank, kind="stable").drop_duplicates("_key")
        if best is not None and len(best):
            state.update((sorted(seen.union(best["_key"])),))
            yield best[list(columns)]

    return pick


def stream_new_scenes(
    arrivals: DataFrame, out_path: str, checkpoint: str, key: Sequence[str] = ("scene_id",), time: str = "datetime", buckets: int = SEEN_BUCKETS,
) -> StreamingQuery:
    """Append each new scene once to Parquet; run it as often as you like.

    ``arrivals`` is a streaming DataFrame with a timestamp column.  The state
    store under ``checkpoint`` remembers the keys that came, in hash buckets
    spread over the executors, so a batch costs what it brings and the keys of
    the buckets it meets: the table is never read, a scene may come at any time
    and in any order, and none is dropped for its age.  A bucket's keys and its
    new rows are held by one task; choose more ``buckets`` for catalogues of
    hundreds of millions, and keep the number for a checkpoint.
    Rows without a key count as one scene.  Of rows with the same key in a batch
    the first by time (none first), then by all columns as JSON, stays.  The
    file sink's log commits a batch as a whole, and one that is run again writes
    nothing twice; ``spark.read.parquet(out_path)`` follows that log.  The run
    takes what is there and ends.

    A table that :func:`append_new` made has no such state: continue it there.
    """
    timed = arrivals.withColumn(time, F.col(time).cast("timestamp"))
    columns = timed.columns
    # text that sorts as (time, row)
    micros = F.coalesce(F.unix_micros(time) + F.lit(10**18), F.lit(0))
    ranked = timed.withColumn("_rank", F.concat(F.lpad(micros.cast("string"), 20, "0"), F.to_json(F.struct(*columns))))
    # the key as text, in which a NULL is left out and a field has its name
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    keyed = ranked.withColumns({"_key": F.to_json(F.struct(*key), exact), "_bucket": status_bucket(key, buckets)})
    first = keyed.groupBy("_bucket").applyInPandasWithState(
        _first_of_keys("_rank", columns), timed.schema, "seen ARRAY<STRING>", "append", GroupStateTimeout.NoTimeout
    )
    return (
        first.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest_status(observed: DataFrame, key: Sequence[str] = ("batch_name", "job_id")) -> DataFrame:
    """The last observed state of each job; combines before the shuffle."""
    rest = [c for c in observed.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct("observed_at", "status_code"))
    return observed.groupBy(*key).agg(last.alias("_l")).select(*key, *[F.col("_l")[c].alias(c) for c in rest])


def status_bucket(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a job, from its key; NULLs have one too."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _bucket_versions(spark: SparkSession, snapshot_path: str) -> dict[int, list[int]]:
    """Per bucket the marked batches that wrote it, in order; as many entries as buckets and the few versions kept."""
    fs, marks = _hadoop(spark, f"{snapshot_path}/batch=*/_SUCCESS")
    whole = {found.getPath().getParent().getName() for found in fs.globStatus(marks) or ()}
    versions: dict[int, list[int]] = {}
    _, folders = _hadoop(spark, f"{snapshot_path}/batch=*/_bucket=*")
    for found in fs.globStatus(folders) or ():
        batch = found.getPath().getParent().getName()
        if batch in whole:
            versions.setdefault(int(found.getPath().getName().partition("=")[2]), []).append(int(batch.partition("=")[2]))
    return {bucket: sorted(batches) for bucket, batches in versions.items()}


def _bucket_paths(snapshot_path: str, newest: dict[int, int]) -> list[str]:
    return [f"{snapshot_path}/batch={batch}/_bucket={bucket}" for bucket, batch in sorted(newest.items())]


def merge_status(batch: DataFrame, number: int, snapshot_path: str, key: Sequence[str] = ("batch_name", "job_id"), buckets: int = BUCKETS) -> None:
    """Write batch ``number`` of :func:`stream_job_status`: the buckets its jobs fall into, and no other."""
    spark = batch.sparkSession
    rows = latest_status(batch, key).withColumn("_bucket", status_bucket(key, buckets))
    touched = {r["_bucket"] for r in rows.select("_bucket").distinct().collect()}
    versions = _bucket_versions(spark, snapshot_path)
    # a batch that is run again sees what it saw before: nothing of its own number or later
    before = {b: max(n for n in have if n < number) for b, have in versions.items() if min(have) < number}
    old = _bucket_paths(snapshot_path, {b: n for b, n in before.items() if b in touched})
    if old:
        kept = spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", status_bucket(key, buckets))
        rows = latest_status(rows.unionByName(kept), key)
    rows.select(*batch.columns, "_bucket").repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{snapshot_path}/batch={number}")
    left = {n for b, have in versions.items() for n in have if n >= before.get(b, number)}
    for bucket, have in versions.items():
        for n in have:
            if n < before.get(bucket, number):
                part = f"{snapshot_path}/batch={n}"
                fs, gone = _hadoop(spark, f"{part}/_bucket={bucket}" if n in left else part)
                fs.delete(gone, True)


def stream_job_status(
    arrivals: DataFrame, snapshot_path: str, checkpoint: str, key: Sequence[str] = ("batch_name", "job_id"), buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the latest state per job in Parquet, in ``buckets`` parts by a hash of the job.

    A micro-batch reads and rewrites only the buckets its jobs fall into, each as
    a folder of its own batch, so its cost follows the batch and not the table.
    The committer marks the batch when all its buckets are whole; readers
    (:func:`read_job_status`) take the newest marked version of each bucket, so
    none sees half a batch.  A bucket keeps two versions, as a batch may be run
    again from the one before it.  ``buckets`` stays the same for a table; choose
    it so that a bucket fits one task.
    """
    return (
        arrivals.writeStream.foreachBatch(lambda batch, number: merge_status(batch, number, snapshot_path, key, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_job_status(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """The newest whole version of every bucket of :func:`stream_job_status`; FileNotFoundError if there is none."""
    newest = {bucket: max(batches) for bucket, batches in _bucket_versions(spark, snapshot_path).items()}
    if not newest:
        raise FileNotFoundError(f"no snapshot under {snapshot_path}")
    return spark.read.parquet(*_bucket_paths(snapshot_path, newest))
