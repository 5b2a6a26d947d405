"""Pixel tables and products as Parquet, laid out for the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pixels(pixels: DataFrame, path: str, partition_by: Sequence[str] = ("grid",), mode: str = "errorifexists") -> None:
    """Parquet by grid, rows clustered by place: a box filter then skips row groups.

    Range partitioning over (grid, row, column) splits a grid that holds most
    of the pixels over many files.
    """
    keys = [F.col(c) for c in (*partition_by, "px_row", "px_col")]
    (
        pixels.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The table written by :func:`write_pixels`; grid filters prune folders."""
    return spark.read.parquet(path)


def write_kml_corpus(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Markup texts (path, kml) bundled in as few Parquet files as their size asks for."""
    texts.select("path", "kml").write.mode(mode).parquet(path)


def read_kml_corpus(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Whole markup texts as rows (path, kml) for the audit.

    A folder of text files gives a row a file; ``bundled`` reads what
    :func:`write_kml_corpus` wrote.  A file costs milliseconds to open and to
    list whatever it holds, so a corpus of many small texts belongs in bundles.
    """
    if bundled:
        return spark.read.schema("path STRING, kml STRING").parquet(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("kml"))
