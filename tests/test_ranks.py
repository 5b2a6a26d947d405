"""Order statistics and numbering when one group has a third of the rows or more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.operators import ranks, seasonal


def skewed(spark, n=6000):
    """A third of the rows in one group, half of those with one value, some without any."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    v = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 6 == 0, F.lit(0.25)).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(200001)) / 1000.0 - 100.0)
    return spark.range(n).select("id", g.alias("g"), v.cast("double").alias("v"))


@pytest.mark.parametrize("few, rows", [(True, 0), (False, 10**6), (False, 0)])
def test_exact_quantiles_match_numpy(spark, monkeypatch, few, rows):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", rows)
    df = skewed(spark).unionByName(spark.createDataFrame([(1, "void", None)], "id BIGINT, g STRING, v DOUBLE"))
    probs = (0.0, 0.02, 0.25, 0.5, 0.98, 1.0)
    got = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "v", probs, few_groups=few).collect()}
    pdf = df.toPandas()
    assert set(got) == set(pdf.g)
    for g, part in pdf.groupby("g"):
        vals = part.v.dropna().to_numpy()
        assert got[g].n_total == len(part) and got[g].n_valid == len(vals)
        if not len(vals):
            assert got[g].q2 is None
            continue
        want = np.percentile(vals, [100 * p for p in probs])
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(len(probs))], want, rtol=1e-12, atol=1e-12)


def test_value_bucket_never_decreases(spark):
    values = [-1e300, -5.0, -1.0, -1e-9, -1e-300, 0.0, 1e-300, 1e-9, 0.5, 0.50001, 1.0, 7.0, 1e300]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(ranks.value_bucket(F.col("v")).alias("b")).collect()
    b = [r.b for r in rows]
    assert b == sorted(b)


def test_split_hot_keeps_all_rows(spark):
    df = skewed(spark)
    counts = df.groupBy("g").count()
    cold, hot = ranks.split_hot(df, ["g"], ranks.hot_keys(counts, ["g"], F.col("count"), floor=1000, share=0.01))
    assert {r.g for r in hot.select("g").distinct().collect()} == {"hot"}
    assert cold.count() + hot.count() == df.count()
    cold, hot = ranks.split_hot(df, ["g"], ranks.hot_keys(counts, ["g"], F.col("count")))
    assert hot.count() == 0 and cold.count() == df.count()


def test_amplitude_is_the_same_on_both_paths(spark):
    df = skewed(spark).select(F.lit("NDVI").alias("index"), F.col("g").alias("px"), (F.col("id") % 12 + 1).alias("month"), F.col("v").alias("value"))
    usual = seasonal.seasonal_amplitude(df, ("index", "px"))
    split = seasonal.seasonal_amplitude(df, ("index", "px"), hot_floor=0, hot_share=0.0001)
    a = {r.px: r for r in usual.collect()}
    b = {r.px: r for r in split.collect()}
    assert a.keys() == b.keys() and len(a) > 10
    for k in a:
        assert (a[k].n_dry, a[k].n_wet) == (b[k].n_dry, b[k].n_wet)
        if a[k].amplitude is None:
            assert b[k].amplitude is None
        else:
            assert abs(a[k].amplitude - b[k].amplitude) < 1e-9


def test_number_rows_over_a_hot_group(spark):
    df = skewed(spark)
    got = ranks.number_rows(df, ["g"], [F.col("id")], "n", descending=(True,)).toPandas()
    want = df.toPandas().sort_values("id", ascending=False)
    want["n"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == len(want) and (merged.n == merged.n_w).all()


def test_number_rows_without_groups(spark):
    got = ranks.number_rows(spark.range(1000), [], [F.col("id")], "n").collect()
    assert all(r.n == r.id + 1 for r in got) and len(got) == 1000
