"""The scene contract: catalogue items, their bounds, and the way through footprints and back."""

import json

import pytest
from pyspark.sql import functions as F

from eoframe.functions.geo import geojson_bounds
from eoframe.operators import catalog as ca
from eoframe.sources import stac


def envelope(coordinates):
    """All positions of nested coordinates, by recursion."""
    if coordinates and isinstance(coordinates[0], (int, float)):
        return [coordinates[:2]]
    return [p for c in coordinates for p in envelope(c)]


SHAPES = [
    {"type": "Point", "coordinates": [-84.5, 9.25]},
    {"type": "Polygon", "coordinates": [[[1, 2], [3.5, 2], [3.5, -4e0], [1, 2]], [[1.5, 1], [2, 1], [2, 0.5], [1.5, 1]]]},
    {"type": "MultiPolygon", "coordinates": [[[[10, 2, 100], [11, 2, 5.5], [11, 3, 7], [10, 2, 100]]], [[[-10, -2, 1], [0, -1e1, 3], [2, 2, 1], [-10, -2, 1]]]]},
    {"type": "LineString", "coordinates": [[-180, 0], [0, 10], [180, 5]]},
    {"type": "Polygon", "coordinates": [[[-180, -90], [180, -90], [180, 90], [-180, 90], [-180, -90]]]},
]


def test_bounds_against_recursion(spark):
    rows = [(i, json.dumps(g["coordinates"])) for i, g in enumerate(SHAPES)] + [(90, "[]"), (91, None), (92, "broken [1,")]
    got = {r.i: r.b for r in spark.createDataFrame(rows, "i int, g string").select("i", geojson_bounds(F.col("g")).alias("b")).collect()}
    for i, g in enumerate(SHAPES):
        at = envelope(g["coordinates"])
        assert tuple(got[i]) == (min(x for x, _ in at), min(y for _, y in at), max(x for x, _ in at), max(y for _, y in at))
    assert got[90] is got[91] is got[92] is None


def test_bounds_cut_at_the_date_line(spark):
    g = [[[[178.5, 1], [180, 1], [180, 2], [178.5, 1]]], [[[-180, 1], [-179.25, 1], [-180, 2], [-180, 1]]]]
    b = spark.range(1).select(geojson_bounds(F.lit(json.dumps(g))).alias("b")).first().b
    assert tuple(b) == (178.5, 1, -179.25, 2)


@pytest.mark.parametrize("stored", [True, False])
def test_boxes_across_the_date_line(spark, stored):
    boxes = [(10, 20), (-179, -170), (170, 178), (179, -179), (150, -150), (-175, 175), (100, 170)]
    rows = spark.createDataFrame([(i, float(w), float(e), w > e) for i, (w, e) in enumerate(boxes)], "i int, west double, east double, wraps boolean")
    degrees = lambda w, e: {x % 360 for x in range(w, (e if w <= e else e + 360) + 1)}
    for ask in boxes:
        c = ca.intersects(F.col("west"), F.lit(0.0), F.col("east"), F.lit(1.0), (ask[0], 0, ask[1], 1), F.col("wraps") if stored else None)
        plain = c if stored else F.when(F.col("west") > F.col("east"), F.lit(None)).otherwise(c)
        got = {r.i for r in rows.where(plain).collect()}
        want = {i for i, b in enumerate(boxes) if degrees(*b) & degrees(*ask) and (stored or b[0] <= b[1])}
        assert got == want, ask


def test_files_to_footprints_and_back(spark, tmp_path):
    item = {
        "type": "Feature", "id": "a", "collection": "landsat-c2-l2", "geometry": SHAPES[1],
        "properties": {"datetime": "2024-05-06T07:08:09Z", "platform": "landsat-8", "eo:cloud_cover": 12.5, "landsat:wrs_path": "15", "landsat:wrs_row": "53", "proj:epsg": 32616},
        "assets": {"red": {"href": "https://x/red.tif?sig=1"}, "nir08": {"href": "https://x/nir.tif"}},
    }
    bare = {"type": "Feature", "id": "b", "collection": "landsat-c2-l2", "geometry": None, "properties": {}, "assets": {}}
    page = {"type": "FeatureCollection", "features": [item, bare]}
    (tmp_path / "1.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "2.json").write_text("no json")
    scenes = stac.read_scenes(spark, str(tmp_path), "https://c/v1")
    # what search, ranking and footprints ask for is there, and an item without anything has nulls
    found = ca.search_scenes(scenes, "landsat-c2-l2", (0, 0, 2, 2), "2024-01-01", "2024-12-31", 50)
    assert [(r.scene_id, r.grid, r.family, r.west, r.north) for r in found.collect()] == [("a", "P015R053", "ls", 1.0, 2.0)]
    assert scenes.where("scene_id = 'b'").select("west", "wraps").first() == (None, None)
    first = ca.to_footprints(scenes, bounds=True).where("id = 'a'")
    again, rejected = ca.scenes_from_footprints(first)
    assert rejected.count() == 0
    second = ca.to_footprints(again, bounds=True)
    assert second.drop("url_visual").collect() == first.drop("url_visual").collect()
    assert ca.search_scenes(again, "landsat-c2-l2", (0, 0, 2, 2), "2024-01-01", "2024-12-31", 50).count() == 1
