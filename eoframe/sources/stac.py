"""Catalogue answers: GeoJSON feature collections of scene items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.functions.geo import geojson_bounds
from eoframe.functions.text import grid_id

BOUNDS = ("west", "south", "east", "north")

# Properties are a MAP so that unknown ones survive; assets keep their radiometry as JSON text, geometries their coordinates.
PAGE_SCHEMA = (
    "type STRING, features ARRAY<STRUCT<id: STRING, collection: STRING, bbox: ARRAY<DOUBLE>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING, geometries: STRING>, properties: MAP<STRING, STRING>, "
    "assets: MAP<STRING, STRUCT<href: STRING, `raster:bands`: STRING>>>>"
)


def scene_bounds(bbox: Column, geometry: Column) -> Column:
    """STRUCT<west, south, east, north>: a box of four or six numbers, else the envelope of the geometry."""
    far = F.floor(F.size(bbox) / 2).cast("int")  # six numbers have a height after each corner
    corners = [F.get(bbox, F.lit(0)), F.get(bbox, F.lit(1)), F.get(bbox, far), F.get(bbox, far + 1)]
    whole = F.coalesce(F.size(bbox).isin(4, 6) & F.forall(bbox, lambda v: v.isNotNull()), F.lit(False))
    given = F.struct(*[c.alias(n) for c, n in zip(corners, BOUNDS)])
    return F.coalesce(F.when(whole, given), geojson_bounds(F.coalesce(geometry["coordinates"], geometry["geometries"])))


def _items(pages: DataFrame, features: Column, catalog: str | None) -> DataFrame:
    """Scenes in the columns that search, ranking, footprints and assets ask for.

    ``wraps`` tells boxes across the date line (west > east).  The area cloud,
    the share of data and the thumbnail are measured later, so they are NULL.
    """
    item = pages.select(F.explode(features).alias("i")).withColumn("box", scene_bounds(F.col("i.bbox"), F.col("i.geometry")))
    p = F.col("i.properties")
    get = lambda *k: F.coalesce(*[F.nullif(F.try_element_at(p, F.lit(x)), F.lit("")) for x in k])
    platform = F.lower(F.coalesce(get("platform"), F.col("i.collection"), F.lit("")))
    family = F.when(platform.contains("landsat"), F.lit("ls")).otherwise(F.lit("s2"))
    none = F.lit(None)
    grid = grid_id(
        family, none.cast("string"), get("landsat:wrs_path", "wrs_path"), get("landsat:wrs_row", "wrs_row"), get("s2:mgrs_tile"),
        get("mgrs:utm_zone"), get("mgrs:latitude_band"), get("mgrs:grid_square"), get("grid:code"),
    )
    return item.select(
        F.col("i.id").alias("scene_id"),
        F.col("i.collection").alias("collection"),
        F.lit(catalog).cast("string").alias("catalog"),
        get("datetime").alias("datetime"),
        F.try_to_date(F.substring(get("datetime"), 1, 10), "yyyy-MM-dd").alias("acquired"),
        get("eo:cloud_cover").try_cast("double").alias("cloud_pct"),
        none.cast("double").alias("aoi_cloud_pct"),
        none.cast("double").alias("data_pct"),
        get("platform").alias("platform"),
        family.alias("family"),
        grid.alias("grid"),
        get("proj:epsg").try_cast("int").alias("proj_epsg"),
        get("proj:code").alias("proj_code"),
        get("s2:processing_baseline").alias("baseline"),
        get("earthsearch:boa_offset_applied").try_cast("boolean").alias("boa_applied"),
        none.cast("string").alias("thumb"),
        *[F.col(f"box.{c}").alias(c) for c in BOUNDS],
        (F.col("box.west") > F.col("box.east")).alias("wraps"),
        p.alias("properties"),
        F.transform_values("i.assets", lambda _, a: a["href"]).alias("assets"),
        F.transform_values("i.assets", lambda _, a: a["raster:bands"]).alias("raster_bands"),
    )


def read_scenes(spark: SparkSession, path: str, catalog: str | None = None) -> DataFrame:
    """One row per item of the feature collections under ``path`` (one document per file), of the catalogue named."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return _items(pages, F.col("features"), catalog)


def parse_scenes(texts: DataFrame, text: str = "page", catalog: str | None = None) -> DataFrame:
    """One row per item of feature collections held as text; unreadable texts give none."""
    parsed = texts.select(F.from_json(F.col(text), PAGE_SCHEMA, {"mode": "PERMISSIVE"}).alias("page"))
    return _items(parsed, F.col("page.features"), catalog)
