"""Second pass over failed metadata, and sample tiles."""

import pytest
from pyspark.sql import functions as F

from eoframe.operators.mosaic import repair_metadata, sample_tiles, version_metadata

SCHEMA = "num long, lon double, lat double, covered boolean, capture string, provider string, sensor string, res double, accuracy double, error string"


def _ok(num, lon, day, provider="P"):
    return (num, lon, 0.0, True, day, provider, "", 1.0, None, None)


def _bad(num, lon):
    return (num, lon, 0.0, False, None, None, None, None, None, "timeout")


def _none(num, lon):
    return (num, lon, 0.0, False, None, None, None, None, None, None)


def _summaries(meta):
    return {r.num: (r.summary, r.failures) for r in version_metadata(meta, F.lit(0.0), F.lit(0.0)).collect()}


def test_only_failed_versions_without_a_date_are_mended(spark):
    first = [_ok(1, 1.0, "2020-01-01"), _bad(1, 2.0), _bad(2, 1.0), _bad(2, 2.0), _bad(3, 1.0), _bad(4, 1.0), _none(5, 1.0), _bad(6, None)]
    # a date for a version that has one; two answers and an error for a point; an answer without an image
    second = [_ok(1, 2.0, "2021-01-01"), _bad(2, 1.0), _ok(2, 1.0, "2022-02-02", "B"), _ok(2, 1.0, "2022-02-02", "A"), _none(3, 1.0),
              _bad(4, 1.0), _ok(5, 1.0, "2023-03-03"), _ok(6, None, "2023-03-03")]
    meta, again = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)
    mended = repair_metadata(meta, again, F.lit(0.0), F.lit(0.0))
    assert _summaries(mended) == {
        1: ("2020-01-01", 1), 2: ("2022-02-02", 1), 3: ("?", 1), 4: ("?", 1), 5: ("—", 0), 6: ("?", 1)}
    assert mended.where("num = 2 AND lon = 1").first().provider == "A"
    assert _summaries(repair_metadata(meta, again.limit(0), F.lit(0.0), F.lit(0.0))) == _summaries(meta)
    assert repair_metadata(meta.limit(0), again, F.lit(0.0), F.lit(0.0)).count() == 0


def test_sample_tiles(spark):
    area = spark.createDataFrame([(7, -1.0, 0.0, 1.0, 2.0)], "area int, west double, south double, east double, north double")
    rows = sample_tiles(area, 2, 30.0).orderBy("point").collect()
    assert [(r.lon, r.lat) for r in rows] == [pytest.approx(p) for p in ((-0.5, 0.5), (-0.5, 1.5), (0.5, 0.5), (0.5, 1.5))]
    assert {r.zoom for r in rows} == {13} and rows[0].tile_key == "13/4084/4084"
    assert sample_tiles(area, 1, 30.0).first().lon == 0.0
