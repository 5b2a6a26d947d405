"""Labels of where a band's scale came from."""

import pytest
from pyspark.sql import functions as F

from eoframe.functions.radiometry import short_number
from eoframe.operators.pixels import radiometry_labels, radiometry_summary

NUMBERS = [0.0001, 2.75e-05, -0.2, 0.0, 1e6, 999999.0, 1234567.0, 10000.0, 123.456789, 1e-300, 9.999999e-5, 100000.0]


@pytest.mark.parametrize("block", [NUMBERS, [-v for v in NUMBERS if v]])
def test_numbers_in_six_digits(spark, block):
    rows = spark.createDataFrame([(v,) for v in block], "v double").select("v", short_number(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{r.v:g}" for r in rows]


def test_labels_per_band_and_one_text_per_scene(spark):
    rows = [(1, "red", "s2", "05.09", None, 0.0001, -0.1), (1, "nir", "s2", "05.09", None, 0.0002, None),
            (2, "red", "s2", "05.09", None, 0.0001, -0.1), (2, "nir", "s2", "05.09", True, None, None), (2, "nir", "s2", "05.09", True, None, None),
            (3, "red", "ls", None, None, None, None), (3, "nir", "s2", "", None, None, None)]
    bands = spark.createDataFrame(rows, "scene_id long, band string, family string, baseline string, boa_applied boolean, scale double, offset double")
    labels = {(r.scene_id, r.band): r.source for r in radiometry_labels(bands, ["scene_id", "band"]).collect()}
    assert len(labels) == 6
    assert labels[1, "nir"] == "raster:bands (escala 0.0002, desplazamiento 0)"
    assert labels[2, "nir"] == "inferencia por línea base '05.09'"
    assert labels[3, "red"] == "constantes internas Landsat C2 (2.75e-05, -0.2)"
    texts = {r.scene_id: r.radiometry for r in radiometry_summary(bands, ["scene_id"]).collect()}
    mixed = "mixta — alguna banda usó respaldo: "
    assert texts == {
        1: "raster:bands (escala y desplazamiento del catálogo)",
        2: mixed + "inferencia por línea base '05.09'",
        3: mixed + "constantes internas Landsat C2 (2.75e-05, -0.2); inferencia por línea base 'desconocida'",
    }
    assert radiometry_summary(bands.limit(0), ["scene_id"]).count() == 0
