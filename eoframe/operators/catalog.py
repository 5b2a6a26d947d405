"""Scene catalogue: search, best scenes per period, gaps, names, bands and assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions.text import platform_prefix
from eoframe.operators.ranks import number_rows


BOUNDS = ("west", "south", "east", "north", "wraps")


def period_of(acquired: Column, strategy: str) -> Column:
    """Year for 'anual', 'YYYY-MM' for anything else; too short a date has none."""
    text = acquired.cast("string")
    key = F.substring(text, 1, 4 if strategy == "anual" else 7)
    return F.when(F.length(text) >= 7, key)


def intersects(
    west: Column, south: Column, east: Column, north: Column, bbox: Sequence[float], wraps: Column | None = None
) -> Column:
    """Whether a box meets ``bbox``; either may cross the date line, which ``west > east`` says.

    ``wraps`` is that fact as a stored column; with it the whole condition is
    made of comparisons with literals, which reach the Parquet scan.
    """
    w, s, e, n = (F.lit(float(v)) for v in bbox)
    level = (south <= n) & (north >= s)
    both, one = (west <= e) & (east >= w), (west <= e) | (east >= w)
    if bbox[0] > bbox[2]:  # a box asked for across the date line meets every box that crosses it too
        return level & (one if wraps is None else wraps | one)
    return level & (both if wraps is None else (~wraps & both) | (wraps & one))


def search_scenes(
    scenes: DataFrame,
    collection: str,
    bbox: Sequence[float],
    start: str,
    end: str,
    max_cloud: float,
    limit: int | None = None,
    direction: str = "desc",
) -> DataFrame:
    """Scenes of a collection over a box and date range, cloud strictly below the limit.

    All conditions are plain comparisons, so they reach the Parquet scan.
    ``limit`` is the size of the answer asked for; Spark keeps a top-n per
    task and never sorts the whole table.
    """
    last_moment = F.date_add(F.lit(end).cast("date"), 1)
    found = scenes.where(
        (F.col("collection") == collection)
        & intersects(*[F.col(c) for c in ("west", "south", "east", "north")], bbox, F.col("wraps") if "wraps" in scenes.columns else None)
        & (F.col("acquired") >= F.lit(start).cast("date"))
        & (F.col("acquired") < last_moment)
        & (F.col("cloud_pct") < float(max_cloud))
    )
    when = F.col("acquired").asc() if direction == "asc" else F.col("acquired").desc()
    ordered = found.orderBy(when, F.col("scene_id").asc())
    return ordered if limit is None else ordered.limit(limit)


def filter_aoi_cloud(scenes: DataFrame, max_pct: float) -> DataFrame:
    """Keep scenes that are unmeasured or not above the limit; 100 keeps all."""
    if max_pct >= 100.0:
        return scenes
    c = F.col("aoi_cloud_pct")
    return scenes.where(c.isNull() | (c < 0) | (c <= max_pct))


def top_per_period(scenes: DataFrame, strategy: str, n: int) -> DataFrame:
    """The ``n`` least cloudy scenes of each year or month; a missing cloud counts as 100.

    Spark trims each task to ``n`` rows per period before the shuffle, so a
    period with most of the rows does not weigh on one task.
    """
    ranked = scenes.withColumn("period", period_of(F.col("acquired"), strategy)).where("period IS NOT NULL")
    best = Window.partitionBy("period").orderBy(
        F.coalesce(F.col("cloud_pct"), F.lit(100.0)), F.col("acquired"), F.col("scene_id")
    )
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def best_per_period(scenes: DataFrame, strategy: str) -> DataFrame:
    """One scene per period: least cloud over the area; unmeasured ones only if alone."""
    measured = F.coalesce(F.when(F.col("aoi_cloud_pct") >= 0, F.col("aoi_cloud_pct")), F.lit(999.0))
    best = Window.partitionBy("period").orderBy(measured, F.col("acquired"), F.col("scene_id"))
    return (
        scenes.withColumn("period", period_of(F.col("acquired"), strategy))
        .where("period IS NOT NULL")
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_periods(grouped: DataFrame, max_n: int) -> DataFrame:
    """Rows of the ``max_n`` most recent periods.

    Periods are made distinct first; the calendar bounds them, and the kept
    list has at most ``max_n`` rows.
    """
    recent = grouped.select("period").distinct().orderBy(F.col("period").desc()).limit(max_n)
    return grouped.join(F.broadcast(recent), "period", "left_semi")


def expected_periods(scenes: DataFrame, start: str, end: str, strategy: str, floor_year: int | None) -> DataFrame:
    """One row per year or month that ``start`` to ``end`` touches, none before the floor."""
    unit, shape = ("year", "yyyy") if strategy == "anual" else ("month", "yyyy-MM")
    begin = F.trunc(F.lit(start).cast("date"), unit)
    if floor_year:
        begin = F.greatest(begin, F.make_date(F.lit(floor_year), F.lit(1), F.lit(1)))
    last = F.trunc(F.lit(end).cast("date"), unit)
    days = F.when(begin <= last, F.sequence(begin, last, F.expr(f"INTERVAL 1 {unit}")))
    return scenes.sparkSession.range(1).select(F.explode(days).alias("day")).select(F.date_format("day", shape).alias("period"))


def empty_periods(
    scenes: DataFrame, start: str, end: str, strategy: str, floor_year: int | None = dims.FLOOR_YEAR
) -> DataFrame:
    """Years or months of the range without a scene; years before the floor are not expected."""
    present = scenes.select(period_of(F.col("acquired"), strategy).alias("period")).distinct()
    return expected_periods(scenes, start, end, strategy, floor_year).join(present, "period", "left_anti")


def retrieved_range(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """First and last date found, and whether all fall in one year though more was asked."""
    several = start[:4] != end[:4]
    return scenes.agg(F.min("acquired").alias("first"), F.max("acquired").alias("last"), F.count(F.lit(1)).alias("n")).withColumn(
        "one_year_only", F.coalesce((F.year("first") == F.year("last")) & F.lit(several), F.lit(False))
    )


def name_collisions(scenes: DataFrame) -> DataFrame:
    """Month and grid cells with several scenes, one row per date with its count.

    Long rows instead of a list per cell: no group is ever gathered.
    """
    per_day = scenes.groupBy(
        F.substring(F.col("acquired").cast("string"), 1, 7).alias("year_month"),
        F.coalesce(F.nullif(F.col("grid"), F.lit("")), F.lit("NA")).alias("grid"),
        "acquired",
    ).agg(F.count(F.lit(1)).alias("n_on_date"))
    # at most 31 dates per cell from here on
    cell = Window.partitionBy("year_month", "grid")
    return per_day.withColumn("n_scenes", F.sum("n_on_date").over(cell)).where(F.col("n_scenes") > 1)


def output_names(scenes: DataFrame, suffix: str) -> DataFrame:
    """File name per scene; later scenes of one base name get their day, then a counter.

    Arrival order is (acquired, scene_id).  The first of a base is found by an
    aggregate, the counters by :func:`number_rows`: both hold for a base that
    has most of the rows.
    """
    text = F.col("acquired").cast("string")
    base = F.concat_ws(
        "_",
        platform_prefix(F.col("platform"), F.col("family")),
        F.coalesce(F.nullif(F.translate(F.substring(text, 1, 7), "-", "_"), F.lit("")), F.lit("0000_00")),
        F.coalesce(F.nullif(F.col("grid"), F.lit("")), F.lit("NA")),
        F.lit(suffix),
    )
    named = scenes.withColumns({"_base": base, "_day": F.coalesce(F.nullif(F.substring(text, 9, 2), F.lit("")), F.lit("00"))})
    numbered = number_rows(named, ["_base", "_day"], [F.col("acquired"), F.col("scene_id")], "_nth")
    # a base covers one month, so it has at most 31 days; its first scene sits in the first day
    first_day = named.groupBy("_base").agg(F.min("_day").alias("_first"))
    joined = numbered.join(first_day, "_base")
    in_first = F.col("_day") == F.col("_first")
    nth = F.when(in_first, F.col("_nth") - 1).otherwise(F.col("_nth"))
    name = (
        F.when(nth == 0, F.concat(F.col("_base"), F.lit(".tif")))
        .when(nth == 1, F.concat(F.col("_base"), F.lit("_d"), F.col("_day"), F.lit(".tif")))
        .otherwise(
            F.concat(F.col("_base"), F.lit("_d"), F.col("_day"), F.lit("_"), nth.cast("string"), F.lit(".tif"))
        )
    )
    return joined.select(*scenes.columns, name.alias("file_name"))


def contact_sheet_order(scenes: DataFrame) -> DataFrame:
    """Scenes by cloud over the area, unmeasured last, with their colour band."""
    c = F.when(F.col("aoi_cloud_pct") >= 0, F.col("aoi_cloud_pct"))
    band = F.when(c <= 10, F.lit("green")).when(c <= 30, F.lit("amber")).otherwise(F.lit("red"))
    return scenes.withColumn("cloud_band", band).orderBy(c.asc_nulls_last(), F.col("scene_id"))


def check_footprint_provenance(footprints: DataFrame, catalog: str, collection: str) -> DataFrame:
    """One row: how many footprints, and how many of another catalogue or collection.

    All rows are checked, not only the first.  A missing column gives NULL
    (a warning, not an error).  ``verdict``: ok, empty, catalog, collection.
    """
    def strange(column: str, wanted: str) -> Column:
        if column not in footprints.columns:
            return F.lit(None).cast("bigint")
        value = F.regexp_replace(F.trim(F.coalesce(F.col(column), F.lit(""))), "/+$", "")
        return F.count_if((value != "") & (value != wanted.rstrip("/")))

    out = footprints.agg(
        F.count(F.lit(1)).alias("n"),
        strange("catalogo", catalog).alias("other_catalog"),
        strange("coleccion", collection).alias("other_collection"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("n") == 0, F.lit("empty"))
        .when(F.col("other_catalog") > 0, F.lit("catalog"))
        .when(F.col("other_collection") > 0, F.lit("collection"))
        .otherwise(F.lit("ok")),
    )


def aoi_bbox(features: DataFrame) -> DataFrame:
    """Envelope of a layer with west, south, east, north; an empty layer gives NULLs."""
    return features.agg(
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )


def suspicious_extent(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A side longer than ten degrees is the whole layer, hardly a work area."""
    widest = F.greatest(F.abs(east - west), F.abs(north - south))
    return F.coalesce(widest > 10.0, F.lit(False))


def collect_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows plus the incoming ones not yet there; running it again changes nothing.

    Of incoming rows with one key the same one stays in every run.
    """
    rest = [c for c in incoming.columns if c not in key]
    if rest:
        row = F.struct(*rest)
        one = incoming.groupBy(*key).agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias("_r"))
        one = one.select(*key, *[F.col("_r")[c].alias(c) for c in rest])
    else:
        one = incoming.distinct()
    return existing.unionByName(one.join(existing, list(key), "left_anti"))


# ------------------------------------------------------------- bands and assets


def band_aliases(band: str, family: str) -> tuple[str, ...]:
    """Asset names to try: an unknown band is its own name on Sentinel-2, nothing on Landsat."""
    for k, _, s2, _, _, ls, _ in dims.BANDS:
        if k == band:
            return ls if family == "ls" else s2
    return () if family == "ls" else (band,)


def _first_link(assets: Column, names: Sequence[str]) -> Column:
    tries = [F.nullif(F.try_element_at(assets, F.lit(a)), F.lit("")) for a in names]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def resolve_asset(assets: Column, band: str, family: Column) -> Column:
    """Link of the first alias present with a non-empty one; ``assets`` maps name to link."""
    def first(fam: str) -> Column:
        return _first_link(assets, band_aliases(band, fam))

    return F.when(family == "ls", first("ls")).otherwise(first("s2"))


def scale_offset(raster_bands: Column) -> Column:
    """STRUCT<scale, offset> of the first entry of a raster:bands JSON text, NULL without scale."""
    scale = F.get_json_object(raster_bands, "$[0].scale").try_cast("double")
    offset = F.get_json_object(raster_bands, "$[0].offset")
    return F.when(
        scale.isNotNull() & (offset.isNull() | offset.try_cast("double").isNotNull()),
        F.struct(scale.alias("scale"), F.coalesce(offset.try_cast("double"), F.lit(0.0)).alias("offset")),
    )


def _lookup(key: Column, family: Column, s2: dict, ls: dict, s2_else: Column, ls_else: Column) -> Column:
    def pick(table: dict, missing: Column) -> Column:
        table = {k: v for k, v in table.items() if v is not None}
        pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(pairs, key), missing)

    return F.when(family == "ls", pick(ls, ls_else)).otherwise(pick(s2, s2_else))


def band_label(key: Column) -> Column:
    """What a band is on each sensor, e.g. 'rojo — S2 B04 10 m · Landsat red 30 m'."""
    def part(sensor: str, name: Column, res: Column) -> Column:
        return F.coalesce(F.format_string(f"{sensor} %s %s m", name, res), F.lit(f"{sensor} no"))

    columns = zip(*[(k, name, n2, str(r2), ls[0] if ls else None, str(rl)) for k, name, _, n2, r2, ls, rl in dims.BANDS])
    keys, *facts = [F.array(*[F.lit(x) for x in c]) for c in columns]
    at = F.array_position(keys, key).cast("int") - 1
    name, s2, s2_res, ls, ls_res = [F.get(f, at) for f in facts]
    sensors = F.concat_ws(" · ", F.when(s2.isNull(), F.lit("S2 no")).otherwise(part("S2", s2, s2_res)), F.when(ls.isNull(), F.lit("Landsat no")).otherwise(part("Landsat", ls, ls_res)))
    return F.when(at >= 0, F.concat_ws(" — ", name, sensors)).otherwise(key)


def band_suffix(key: Column, family: Column) -> Column:
    """File suffix of a band on a sensor, as the band dimension has it; 'X' if the sensor lacks the band."""
    of_band = F.create_map(*[x for k, *both in dims.BAND_SUFFIXES for x in (F.lit(k), F.struct(*[F.lit(v).alias(n) for n, v in zip(("s2", "ls"), both)]))])
    found = F.try_element_at(of_band, key)
    return F.coalesce(F.when(family == "ls", found["ls"]).otherwise(found["s2"]), F.lit("X"))


def native_res(key: Column, family: Column) -> Column:
    """Metres per pixel: 30 on Landsat, the band's own on Sentinel-2, 10 if unknown."""
    s2 = {k: float(r2) for k, _, _, _, r2, _, _ in dims.BANDS}
    ls = {k: dims.LANDSAT_RES for k in s2}
    return _lookup(key, family, s2, ls, F.lit(dims.DEFAULT_S2_RES), F.lit(dims.LANDSAT_RES))


def first_alias(key: Column, family: Column) -> Column:
    s2 = {k: a[0] for k, _, a, _, _, _, _ in dims.BANDS}
    ls = {k: (a[0] if a else None) for k, _, _, _, _, a, _ in dims.BANDS}
    return _lookup(key, family, s2, ls, key, F.lit(None).cast("string"))


def duplicate_bands(requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Different band keys of one request that read the same asset on its sensor.

    Keys are made distinct first; a band dimension of twelve bounds the list.
    """
    return (
        requests.select(*by, "band", first_alias(F.col("band"), F.col("family")).alias("asset"))
        .where("asset IS NOT NULL")
        .distinct()
        .groupBy(*by, "asset")
        .agg(F.array_join(F.array_sort(F.collect_list("band")), ",").alias("bands"), F.count(F.lit(1)).alias("n_bands"))
        .where(F.col("n_bands") > 1)
    )


def vetoed_composites(missing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per request and composite: the bands the sensor lacks, or '' when available.

    ``missing`` has ``by`` and an ARRAY<STRING> ``absent``; the eight
    composites are a literal array, so there is no join.
    """
    table = F.array(
        *[F.struct(F.lit(n).alias("composite"), F.array(*[F.lit(x) for x in b]).alias("bands")) for n, b in dims.COMPOSITES]
    )
    lacking = F.filter(F.col("c.bands"), lambda b: F.array_contains(F.col("absent"), b))
    return (
        missing.select(*by, "absent", F.explode(table).alias("c"))
        .select(*by, F.col("c.composite").alias("composite"), lacking.alias("_lacking"))
        .select(*by, "composite", F.array_join("_lacking", ",").alias("lacking"), (F.size("_lacking") == 0).alias("available"))
    )


def pack_assets(assets: Column, family: Column) -> Column:
    """Compact JSON of the supported bands under their first alias, links without signature.

    Landsat's one near infrared serves two band keys and is listed once.
    """
    def packed(fam: str) -> Column:
        pairs = {}
        for k in dims.BAND_KEYS:
            names = band_aliases(k, fam)
            if names and names[0] not in pairs:
                pairs[names[0]] = F.substring_index(_first_link(assets, names), "?", 1)
        links = F.create_map(*[x for name, link in pairs.items() for x in (F.lit(name), link)])
        return F.to_json(F.map_filter(links, lambda _, v: v.isNotNull()))

    return F.when(family == "ls", packed("ls")).otherwise(packed("s2"))


def scenes_from_footprints(footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes, rejected) of a reviewed footprint table.

    Rows whose ``assets`` text is unreadable or empty are rejected and kept
    apart, never lost.  ``assets`` maps names to links, as :func:`resolve_asset`
    wants it; collection, catalogue and bounds are there when the table has them.
    With all of them the scenes are as :func:`eoframe.sources.stac.read_scenes`
    gives them, so they can be searched and written again.
    """
    links = F.from_json(F.col("assets"), "MAP<STRING,STRING>", {"mode": "PERMISSIVE"})
    parsed = footprints.withColumn("_links", links)
    usable = F.coalesce(F.size("_links") > 0, F.lit(False))
    clock = F.coalesce(F.nullif(F.col("hora_utc"), F.lit("")), F.lit("00:00:00"))
    scenes = parsed.where(usable).select(
        F.col("id").alias("scene_id"),
        F.concat(F.coalesce(F.col("fecha"), F.lit("")), F.lit("T"), clock, F.lit("Z")).alias("datetime"),
        F.col("nubes_pct").alias("cloud_pct"),
        F.col("nubes_aoi").alias("aoi_cloud_pct"),
        F.col("datos_pct").alias("data_pct"),
        F.col("plataforma").alias("platform"),
        F.col("tile").alias("grid"),
        F.col("epsg"),
        F.col("epsg").alias("proj_epsg"),
        F.lit(None).cast("string").alias("proj_code"),
        F.when(F.lower("plataforma").contains("landsat"), F.lit("ls")).otherwise(F.lit("s2")).alias("family"),
        F.try_to_date(F.col("fecha"), "yyyy-MM-dd").alias("acquired"),
        *[F.col(own).alias(name) for own, name in (("coleccion", "collection"), ("catalogo", "catalog"), ("thumb", "thumb")) if own in footprints.columns],
        *[F.col(c) for c in BOUNDS if c in footprints.columns],
        F.col("_links").alias("assets"),
    )
    rejected = parsed.where(~usable).drop("_links")
    return scenes, rejected


def to_footprints(scenes: DataFrame, bounds: bool = False) -> DataFrame:
    """The fifteen footprint columns, with ``bounds`` also the box, for a second pass that searches again.

    Missing cloud becomes 0.0 here, unmeasured area values -1.0; the EPSG code
    comes from ``proj_epsg``, else from ``proj_code`` without its prefix, else 0.
    """
    code = F.regexp_replace(F.coalesce(F.col("proj_code"), F.lit("0")), "EPSG:", "").try_cast("int")
    epsg = F.coalesce(F.nullif(F.col("proj_epsg"), F.lit(0)), code, F.lit(0))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return scenes.select(
        text("scene_id").alias("id"),
        F.substring(text("datetime"), 1, 10).alias("fecha"),
        F.substring(text("datetime"), 12, 8).alias("hora_utc"),
        F.coalesce(F.col("cloud_pct"), F.lit(0.0)).alias("nubes_pct"),
        F.coalesce(F.col("aoi_cloud_pct"), F.lit(-1.0)).alias("nubes_aoi"),
        F.coalesce(F.col("data_pct"), F.lit(-1.0)).alias("datos_pct"),
        text("platform").alias("plataforma"),
        text("grid").alias("tile"),
        epsg.alias("epsg"),
        text("thumb").alias("thumb"),
        F.when(text("thumb").startswith("/"), F.concat(F.lit("file://"), text("thumb")))
        .when(text("thumb") != "", F.concat(F.lit("file:///"), text("thumb")))
        .otherwise(F.lit(""))
        .alias("thumb_url"),
        F.coalesce(resolve_asset(F.col("assets"), "visual", F.col("family")), F.lit("")).alias("url_visual"),
        pack_assets(F.col("assets"), F.col("family")).alias("assets"),
        F.col("collection").alias("coleccion"),
        F.col("catalog").alias("catalogo"),
        *([F.col(c) for c in BOUNDS] if bounds else []),
    )
