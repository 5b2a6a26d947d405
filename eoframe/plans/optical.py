"""From a scene catalogue and a pixel table to index products."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.operators import catalog, pixels as px, seasonal
from eoframe.operators.catalog import band_aliases
from eoframe.operators.grid import Grid, align_scenes, crop_bbox, crop_geographic, crop_polygon


def check_optical(
    start: str,
    end: str,
    family: str,
    indices: Sequence[str],
    dry: Sequence[int],
    wet: Sequence[int],
    amplitude: bool,
    fire_date: str | None,
    bands: Sequence[str] = (),
    max_scenes: int | None = None,
    candidates: int = 3,
    min_obs: int = dims.MIN_OBS,
) -> None:
    """Raise ValueError for arguments no run could serve, before any plan is built."""
    try:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError as e:
        raise ValueError(f"dates are YYYY-MM-DD: {e}") from e
    if first > last:
        raise ValueError("the start date lies after the end date")
    unknown = [i for i in indices if i not in dims.INDEX_NAMES]
    if unknown:
        raise ValueError(f"unknown indices: {unknown}")
    if family == "ls" and (lacking := [i for i in indices if i in dims.S2_ONLY]):
        raise ValueError(f"Landsat has no red edge: {lacking}")
    if amplitude:
        if not indices:
            raise ValueError("the amplitude needs an index")
        if not dry or not wet:
            raise ValueError("both seasons need months")
        if both := sorted(set(dry) & set(wet)):
            raise ValueError(f"months in both seasons: {both}")
    if any(not 1 <= m <= 12 for m in (*dry, *wet)):
        raise ValueError("months run from 1 to 12")
    if fire_date is not None:
        if "NBR" not in indices:
            raise ValueError("burn severity needs NBR")
        try:
            date.fromisoformat(fire_date)
        except ValueError as e:
            raise ValueError("the fire date is YYYY-MM-DD") from e
    assets = [a[0] for b in bands if (a := band_aliases(b, family))]
    if len(set(assets)) != len(assets):
        raise ValueError("two of the bands are the same asset on this sensor")
    for name, value in (("max_scenes", max_scenes), ("candidates", candidates), ("min_obs", min_obs)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be 1 or more")


def select_scenes(
    scenes: DataFrame,
    pixels: DataFrame,
    collection: str,
    bbox: Sequence[float],
    start: str,
    end: str,
    cloud_max: float = 70.0,
    aoi_cloud_max: float = 100.0,
    max_scenes: int | None = None,
    candidates: int = 3,
    order: str = "desc",
) -> DataFrame:
    """The scenes to work on, with the cloud measured over the area.

    The cheap choice by catalogue cloud comes first, so only the pixels of the
    candidates are read for the measurement.
    """
    if order in ("anual", "mensual"):
        found = catalog.search_scenes(scenes, collection, bbox, start, end, cloud_max, direction="asc")
        best = catalog.top_per_period(found, order, candidates)
        chosen = (best if max_scenes is None else catalog.latest_periods(best, max_scenes)).drop("period", "rank")
    else:
        chosen = catalog.search_scenes(scenes, collection, bbox, start, end, cloud_max, max_scenes, order)
    chosen = chosen.drop("aoi_cloud_pct", "data_pct")
    seen = pixels.join(chosen.select("scene_id"), "scene_id", "left_semi")
    measured = chosen.join(px.aoi_cloud(seen).drop("n_total", "n_valid"), "scene_id", "left")
    if order in ("anual", "mensual"):
        measured = catalog.best_per_period(measured, order)
    return catalog.filter_aoi_cloud(measured, aoi_cloud_max)


def on_common_grid(
    values: DataFrame, chosen: DataFrame, frames: DataFrame, dry: Sequence[int], pixel: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(values on the frame of the first dry scene, counts of values without a usable frame)."""
    if not {"px_col", "px_row"} <= set(pixel):
        raise ValueError("a common grid needs px_col and px_row among the pixel columns")
    columns = ("x0", "y0", "dx", "dy", "cols", "rows", "epsg")
    usable = frames.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    first = usable.join(chosen.select("scene_id", "acquired"), "scene_id").orderBy(
        ~F.month("acquired").isin(*dry), "acquired", "scene_id"
    ).select(*columns).first()  # one row
    if first is None:
        raise ValueError("no chosen scene has a frame")
    grid = Grid(first.x0, first.y0, first.dx, first.dy, first.cols, first.rows)
    placed = values.join(frames.select("scene_id", "x0", "y0", "dx", "dy", "epsg"), "scene_id", "left")
    by = ["index", "scene_id", "acquired", *[c for c in pixel if c not in ("px_col", "px_row")]]
    # cells of one name are one place now, whichever grid a pixel came from
    by = [c for c in by if c != "grid"]
    moved, rejected = align_scenes(placed, grid, first.epsg, by, ["value"])
    return (moved.withColumn("grid", F.lit("reference")) if "grid" in pixel else moved), rejected


def optical_run(
    scenes: DataFrame,
    pixels: DataFrame,
    collection: str,
    bbox: Sequence[float],
    start: str,
    end: str,
    indices: Sequence[str] = ("NDVI",),
    family: str = "s2",
    cloud_max: float = 70.0,
    aoi_cloud_max: float = 100.0,
    max_scenes: int | None = None,
    candidates: int = 3,
    order: str = "desc",
    amplitude: bool = False,
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    min_obs: int = dims.MIN_OBS,
    fire_date: str | None = None,
    assessment: str = "inicial",
    pixel_area_m2: float | None = None,
    pixel: Sequence[str] = ("grid", "px_col", "px_row"),
    work_path: str | None = None,
    xy: tuple[str, str] | None = None,
    rings: list[list[tuple[float, float]]] | None = None,
    products: Sequence[str] | None = None,
    xy_epsg: int | None = None,
    frames: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scenes, index values and the asked products, each a lazy DataFrame.

    ``xy`` names the pixel columns in the units of ``bbox``: pixels outside the
    box (and outside the polygon ``rings``) are cut off before anything is
    measured.  With ``xy_epsg`` those columns are in that UTM code while ``bbox``
    and ``rings`` are in degrees, as the scenes' boxes are.

    ``frames`` (scene_id, x0, y0, dx, dy, cols, rows, epsg) has the raster frame
    of each scene; then index values come on the frame of the first dry scene
    (the first scene if none is dry), whatever zone the others are in, and
    ``unplaced`` counts the values of scenes without a usable frame.  The frame
    is looked up when the run is planned.  Only the outputs in ``products`` (None: all the arguments give)
    are planned; the statistics among them run jobs for their bucket lists.

    With ``work_path`` the index values are written there once and all
    products read them; otherwise each product computes what it needs.
    """
    check_optical(start, end, family, indices, dry, wet, amplitude, fire_date, (), max_scenes, candidates, min_obs)
    if rings and not xy:
        raise ValueError("a polygon needs the pixel columns it is measured in")
    if xy and xy_epsg is not None:
        pixels = crop_geographic(pixels, bbox, xy_epsg, *xy, rings)
    elif xy:
        pixels = crop_polygon(crop_bbox(pixels, bbox, *xy), rings, *xy) if rings else crop_bbox(pixels, bbox, *xy)
    chosen = select_scenes(
        scenes, pixels, collection, bbox, start, end, cloud_max, aoi_cloud_max, max_scenes, candidates, order
    )
    used = pixels.join(chosen.select("scene_id"), "scene_id", "left_semi")
    values = px.compute_indices(used, list(indices), keep=(*pixel, "scene_id", "acquired"))
    unplaced = None
    if frames is not None:
        values, unplaced = on_common_grid(values, chosen, frames, dry, pixel)
    values = values.withColumn("month", F.month("acquired"))
    if work_path:
        values.write.mode("errorifexists").partitionBy("index").parquet(work_path)
        values = scenes.sparkSession.read.parquet(work_path)
    makers: dict[str, Callable[[], DataFrame]] = {
        "scenes": lambda: chosen, "values": lambda: values, "distribution": lambda: seasonal.index_distribution(values),
    }
    if unplaced is not None:
        makers["unplaced"] = lambda: unplaced
    if amplitude:
        amp = cache(lambda: seasonal.seasonal_amplitude(values, ("index", *pixel), dry, wet, min_obs))
        makers |= {
            "amplitude": amp,
            "observations": lambda: seasonal.observation_summary(amp()),
            "empty_cause": lambda: seasonal.empty_product_cause(amp(), min_obs),
            "orphan_months": lambda: seasonal.orphan_months(values, dry, wet),
        }
    if "NDVI" in indices:
        makers["ndvi_classes"] = lambda: seasonal.ndvi_classes(values)
    if fire_date:
        nbr = values.where(F.col("index") == "NBR")
        # one row per scene tells the dates; the pixels of other scenes are not read for it
        picks = seasonal.pick_fire_scenes(chosen, fire_date, assessment)
        burnt = cache(lambda: seasonal.dnbr(nbr, picks, pixel))
        makers |= {"fire_scenes": lambda: picks, "dnbr": burnt, "dnbr_classes": lambda: seasonal.dnbr_classes(burnt(), pixel_area_m2)}
    if unknown := sorted(set(products or ()) - set(makers)):
        raise ValueError(f"no such outputs: {unknown}")
    return {name: make() for name, make in makers.items() if products is None or name in products}
