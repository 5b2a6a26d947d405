"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.session import ensure_checkpoint_dir, freed_shuffles, stable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEW = 1_000_000  # short keys that are named to all executors after they are counted; more are joined
NO_ID = -(2**63)  # stands for a null doc_id where a plain long is needed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; a null text counts as empty, other columns are left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text): ``doc_id`` and the hash ``tk`` together name a row up to rows equal in both.

    A null doc_id becomes ``NO_ID``, so that keys compare as plain longs.
    """
    t = texts(docs)
    return t.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tk"), "text")


def real_id(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(NO_ID))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def packed(docs: DataFrame) -> DataFrame:
    """Every row as one struct ``row``, so that extra columns of any name can't clash, with its key."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return d.select(
        "row",
        F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("row.text"), F.lit("")).alias("_text"),
    )


def few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if they are counted to be few."""
    with freed_shuffles(keys.sparkSession):
        return F.broadcast(keys) if keys.count() <= FEW else keys


def kept_rows(rows: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The packed rows of ``rows`` (row, and keys) without those whose key is in ``gone`` and with one row for a key in ``again``.

    Both name keys by the same columns.  The rest is not shuffled where both are
    few; of rows that share a key the least by its JSON stays, which any column
    type has, and they are combined before their shuffle.
    """
    gone, again = stable(gone.distinct()), stable(again.distinct())
    keys = gone.columns

    def on(side: DataFrame) -> tuple[DataFrame, list[Column]]:
        return few(side.select(*[F.col(c).alias(f"_{c}") for c in keys])), [F.col(c) == F.col(f"_{c}") for c in keys]

    left = rows.join(*on(gone), "left_anti") if not gone.isEmpty() else rows
    if again.isEmpty():
        return left.select("row.*")
    single = left.join(*on(again), "left_anti").select("row")
    one = left.join(*on(again), "left_semi").groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(one).select("row.*")


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the shared checkpoint folder, and a function that removes the table.

    For wide intermediate rows that are read more than once; a checkpoint would keep them uncompressed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext._jsc.sc()
    path = f"{context.getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path), lambda: at.getFileSystem(context.hadoopConfiguration()).delete(at, True) and None


def components(edges: DataFrame, salts: int = 16, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node it reaches.

    Alternating large and small stars.  The minimum of a node's neighbours is
    taken per salt first, and goes back by salt, so a node with very many
    neighbours never meets in one task.  Both halves of a round are
    checkpointed, as a plan that reads its own input again and again fills the
    driver; rounds end as soon as all that is left are stars.
    """

    def pair(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def least(e: DataFrame) -> DataFrame:
        # (u, v) -> (u, v, m): m = min of u and its neighbours
        e = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
        whole = F.min("m").over(Window.partitionBy("u"))  # over at most ``salts`` rows
        back = e.groupBy("u", "s").agg(F.min("v").alias("m")).select(F.col("u").alias("bu"), F.col("s").alias("bs"), F.least("u", whole).alias("m"))
        return e.join(back, (F.col("u") == F.col("bu")) & (F.col("s") == F.col("bs"))).select("u", "v", "m")

    def settled(e: DataFrame) -> bool:
        # v < u, so if each u has one v, which is no u itself, that v is the root
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("at"))
        more = ends.groupBy("at.x").agg(F.sum("at.up").alias("up"), F.max("at.down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
        with freed_shuffles(e.sparkSession):
            return more.count() == 0

    e = stable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(rounds):
        if settled(e):
            break
        both = e.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        large = stable(least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        e = stable(least(large).select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
