"""Session helpers shared by the operators that need cluster settings."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` wins.  A temporary folder is set only on a local
    master (tests); on a cluster a machine-local folder would lose data with
    its executor, so there the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="eoframe-checkpoint-"))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, not when the driver happens to collect its garbage.

    For results that are written whole: nobody reads the shuffles behind them again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stable(df: DataFrame) -> DataFrame:
    """A copy of ``df`` whose rows no longer move between partitions.

    Needed wherever a plan reads ``spark_partition_id()`` twice: the range
    bounds are sampled, so the two readers must see the same rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def stable_row_each(df: DataFrame) -> DataFrame:
    """``stable`` for a table of a row per source or the like: one file instead of one for each partition."""
    return stable(df.repartition(1))


def compiled_apart(df: DataFrame) -> DataFrame:
    """``df`` with its steps compiled apart from the steps that follow; no row and no partition moves.

    Spark makes one method of neighbouring narrow steps.  The JVM never compiles
    one above 8000 bytes, so its rows are interpreted, ten times slower, unless
    the session has the setting below.  A coalesce to more partitions than there
    can be ends a method on any session.
    """
    return df.coalesce(2**31 - 1)


# Settings the runs profit from.  Generated methods above 8000 bytes are never
# compiled by the JVM; wide index projections are faster split than interpreted.
# Call-site capture doubles the time to build a large plan in Python.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
