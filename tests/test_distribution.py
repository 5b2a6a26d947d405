"""Findings of the fourth round: the distribution of the indices over many pixels, on any session."""

import re

import pytest

from eoframe import dims
from eoframe.operators import pixels as px
from eoframe.plans.catalogue import RUNS
from oracle import SMALL


def largest_method(spark, df):
    """Bytes of the longest method that Spark makes for the plan; the JVM leaves one above 8000 to its interpreter."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    text = debug.codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.mark.parametrize("name", ["index_distribution", "compute_indices"])
def test_methods_of_all_indices_are_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its methods only after its run
    try:
        assert largest_method(spark, RUNS[name](spark, SMALL)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partitions_stay_as_they_are(spark):
    bands = [f"CAST(id % 7 * 500 AS DOUBLE) AS {b}" for b in px.SPECTRAL]
    df = spark.range(0, 100, 1, 7).selectExpr("id", "'s2' AS family", "'04.00' AS baseline", *bands)
    assert px.compute_indices(df, dims.INDEX_NAMES, keep=("id",)).rdd.getNumPartitions() == 7


def test_rows_of_odd_pixels(spark):
    """A family that is not known has no red-edge rows; a value that is no number or out of range is NULL, its raw one stays."""
    bands = {"rededge1": 0.0, "rededge3": 0.0, "nir": 9000.0, "nir08": 5000.0, "red": 1000.0, "swir16": float("nan")}
    names = [n for n in dims.INDEX_NAMES if set(dims.INDEX_BANDS[n]) <= set(bands)]
    rows = [(1, None, "03.01"), (2, "ls", "03.01"), (3, "s2", "03.01")]
    df = spark.createDataFrame([(*r, *bands.values()) for r in rows], ["id", "family", "baseline", *bands])
    got = {(r.id, r["index"]): r for r in px.compute_indices(df, names, keep=("id",)).collect()}
    others = [n for n in names if n not in dims.S2_ONLY]
    assert set(got) == {(i, n) for i in (1, 2) for n in others} | {(3, n) for n in names}
    assert got[3, "NDVI"].value == pytest.approx(0.8) and got[3, "CIre"].value is None
    assert got[3, "MSI"].value is None and got[3, "MSI"].raw != got[3, "MSI"].raw
