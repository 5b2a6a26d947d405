"""History of a tiled mosaic over an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.operators import mosaic


def mosaic_history(
    versions: DataFrame,
    tilemap: DataFrame,
    tile_pixels: DataFrame,
    meta: DataFrame,
    lon: Column,
    lat: Column,
    compare: bool = True,
    one_per_capture: bool = True,
    start: str | None = None,
    end: str | None = None,
    points: DataFrame | None = None,
    again: DataFrame | None = None,
    current: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Versions that changed over the sample tiles, with hits and capture dates, newest first.

    ``versions``: num, published, pos.  ``tilemap`` and ``tile_pixels`` hold the
    tiles of the sample points, ``meta`` the source-image rows per version and point.

    ``points`` (point, tile_key, as :func:`mosaic.sample_tiles` gives them) keeps
    the tiles that are sampled, counts hits by point instead of by tile and adds
    ``n_unasked``, the points whose source image was not asked for.  ``again``
    holds the answers of a second pass over failed points.  ``current``
    (current_tile, archived_tile; one row) puts the live mosaic in front where
    it differs.
    """
    if points is not None:
        points = points.select("point", "tile_key").distinct()
        sampled = points.select("tile_key").distinct()
        tilemap = tilemap.join(sampled, "tile_key", "left_semi")
    changed = mosaic.changed_versions(tilemap).select("tile_key", "num")
    if compare:
        changed = mosaic.drop_same_photo(tile_pixels.join(changed, ["tile_key", "num"], "left_semi"))
    hits = mosaic.version_hits(changed)
    if points is not None:
        hits = changed.join(points, "tile_key").groupBy("num").agg(F.countDistinct("point").alias("hits"))
    if again is not None:
        meta = mosaic.repair_metadata(meta, again, lon, lat)
    listed = mosaic.filter_published(versions, start, end).join(hits, "num")
    dated = listed.join(mosaic.version_metadata(meta, lon, lat), "num", "left").withColumn(
        "capture", F.coalesce(F.col("summary"), F.lit("—"))
    )
    if points is not None:
        asked = mosaic.nearest_points(meta, lon, lat).groupBy("num").agg(F.count(F.lit(1)).alias("_asked"))
        every = points.agg(F.countDistinct("point")).scalar()
        left = F.greatest(F.lit(0).cast("bigint"), every - F.coalesce(F.col("_asked"), F.lit(0)))
        dated = dated.join(asked, "num", "left").withColumn("n_unasked", left).drop("_asked")
    kept, merged = mosaic.one_per_capture(dated) if one_per_capture else (dated, dated.limit(0))
    if current is not None:
        live = mosaic.add_current_mosaic(kept.where(F.lit(False)), current, one_per_capture, by=())
        kept = live.unionByName(kept, allowMissingColumns=True)
    return {"changed": changed, "versions": kept.orderBy("pos"), "merged": merged}
