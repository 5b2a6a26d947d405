"""History of a tiled mosaic: versions, local changes, same-photo removal, capture dates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions.geo import sample_points, tile_of, zoom_for_resolution
from eoframe.functions.text import epoch_ms_date
from eoframe.operators.ranks import number_rows
from eoframe.session import stable


def read_versions(entries: DataFrame) -> DataFrame:
    """Version rows of configuration entries (key, title, url, meta_url), newest first.

    Keys that are not whole numbers are skipped.  The publication date is the
    text in the last parentheses of the title without the word 'Wayback'.
    """
    number = F.when(F.trim("key").rlike(r"^[+-]?\d{1,9}$"), F.trim("key").try_cast("int"))
    title = F.coalesce(F.col("title"), F.lit(""))
    inner = F.regexp_extract(title, r"(?s)^.*\((.*?)\)[^)]*$", 1)
    published = F.trim(F.replace(inner, F.lit("Wayback"), F.lit("")))
    rows = entries.select(
        number.alias("num"),
        published.alias("published"),
        title.alias("title"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("meta_url"), F.lit("")).alias("meta_url"),
    ).where(F.col("num").isNotNull())
    return version_order(rows)


def version_order(versions: DataFrame) -> DataFrame:
    """Adds ``pos``: 0 for the newest, by (published, num) descending."""
    newest = number_rows(versions, [], [F.col("published"), F.col("num")], "_nth", descending=(True, True))
    return newest.withColumn("pos", F.col("_nth") - 1).drop("_nth")


def filter_published(versions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Publication date inside the bounds, both inclusive and optional."""
    kept = versions
    if start:
        kept = kept.where(F.col("published") >= start)
    if end:
        kept = kept.where(F.col("published") <= end)
    return kept


def sample_tiles(areas: DataFrame, n: int, res_m: float) -> DataFrame:
    """The n x n sample points of each area and their tiles, at the zoom of its middle.

    ``areas``: west, south, east, north and any columns of its own.  Adds point
    (from 0), lon, lat, zoom and tile_key, ``zoom/row/col``.
    """
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    zoomed = areas.withColumn("zoom", zoom_for_resolution(F.lit(float(res_m)), (F.col("south") + F.col("north")) / 2.0))
    spots = zoomed.select("*", F.posexplode(sample_points(*sides, n)).alias("point", "_at"))
    tile = tile_of(F.col("_at.lon"), F.col("_at.lat"), F.col("zoom"))
    return spots.select(
        *areas.columns, "zoom", "point", F.col("_at.lon").alias("lon"), F.col("_at.lat").alias("lat"),
        F.concat_ws("/", "zoom", tile["row"], tile["col"]).alias("tile_key"),
    )


# ------------------------------------------------------------- folds over tiles


def changed_versions(tilemap: DataFrame) -> DataFrame:
    """Versions with a local change, per tile, from the newest on.

    ``tilemap``: tile_key, pos (0 is newest), num, has_data, select_pos,
    select_num (NULL or 0: itself), size_bytes.  The walk goes on with the
    version after the one a cell names, newer or older.  A cell without data, a
    missing cell, a version met before or a target without a position ends it;
    such a target is still reported.  Of several cells of one tile and position
    the least (num, then what it names) counts.

    Each cell points to one cell, so the walk is found by doubling: cells met
    within 2^k steps and pointers 2^k steps long give those of 2^(k+1).  It takes
    as many rounds as the longest walk has binary digits, each two joins on (tile,
    position), so a tile with most of the rows is spread like any other.  A cell
    met again keeps its first step, and a round that meets no new cell is the last.
    """
    redirect = F.coalesce(F.col("select_num"), F.lit(0)) != 0
    place, target = F.col("pos").cast("long"), F.col("select_pos").cast("long")
    # a redirect to no listed version has no target, so nothing follows it
    cell = F.struct(
        F.when(redirect, F.col("select_num")).otherwise(F.col("num")).cast("long").alias("num"),
        F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"),
        (F.when(redirect, target).otherwise(place) + 1).alias("to"),
        F.coalesce(F.col("has_data"), F.lit(False)).alias("has_data"),
    )
    first = F.min_by(cell, F.struct(F.col("num").cast("long"), cell))
    cells = tilemap.groupBy("tile_key", place.alias("pos")).agg(first.alias("c")).select("tile_key", "pos", "c.*")
    cells = stable(cells.where("has_data").drop("has_data"))

    def at(tile: str, pos: str, other_pos: str) -> Column:
        return F.col("tile_key").eqNullSafe(F.col(tile)) & (F.col(pos) == F.col(other_pos))

    there = cells.select(F.col("tile_key").alias("there"), F.col("pos").alias("there_pos"))
    jumps = stable(cells.select("tile_key", "pos", "to").join(there, at("there", "to", "there_pos"), "left_semi"))
    met = cells.where("pos = 0").select("tile_key", "pos", F.lit(0).cast("long").alias("steps"))
    length = 1
    while True:
        jump = jumps.select(F.col("tile_key").alias("from_tile"), F.col("pos").alias("from_pos"), F.col("to").alias("next"))
        reached = met.join(jump, at("from_tile", "pos", "from_pos")).groupBy("tile_key", F.col("next").alias("pos")).agg((F.min("steps") + length).alias("steps"))
        known = met.select(F.col("tile_key").alias("known"), F.col("pos").alias("known_pos"))
        fresh = stable(reached.join(known, at("known", "pos", "known_pos"), "left_anti"))
        if fresh.isEmpty():
            break
        met = met.unionByName(fresh)
        jumps = stable(jumps.join(jump, at("from_tile", "to", "from_pos")).select("tile_key", "pos", F.col("next").alias("to")))
        length *= 2
    walk = met.select(F.col("tile_key").alias("walk"), F.col("pos").alias("walk_pos"), "steps")
    return cells.join(walk, at("walk", "pos", "walk_pos")).select(
        "tile_key", (F.col("steps") + 1).cast("int").alias("step"), "num", "size_bytes"
    )


def same_photo(a: Column, b: Column, threshold: float = dims.SAME_PHOTO_THRESHOLD) -> Column:
    """Equal shape and mean absolute difference strictly below the threshold; NULL is never equal."""
    gap = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )
    mean = F.try_divide(gap, F.size(a))
    return F.coalesce((F.size(a) == F.size(b)) & (mean < threshold), F.lit(False))


def _distance(a, b) -> float:
    """Mean absolute difference, infinite for different shapes."""
    if len(a) != len(b):
        return float("inf")
    return float(np.mean(np.abs(np.asarray(a, dtype="int32") - np.asarray(b, dtype="int32"))))


_MARK_COLUMNS = ["tile_key", "num", "kept", "is_state", "px"]


def _mark_pieces(threshold: float):
    """Decide all rows of a sorted piece that do not depend on an earlier piece.

    A row surely starts a new photo when it cannot be decoded, follows one
    that could not, changes shape, or lies at least two thresholds from the
    row before it: that row is itself within one threshold of the kept image.
    Until the first such row a tile that may continue from an earlier piece
    stays open.  The image kept last goes along as the state for the next piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, first_tile, is_open, kept_px, kept_num, before = None, True, False, None, None, None
        for batch in batches:
            out = []
            for key, num, px in zip(batch.tile_key, batch.num, batch.px):
                if tile is None or key != tile:
                    first_tile = tile is None
                    tile, is_open, kept_px, kept_num, before = key, first_tile, None, None, None
                if px is None:
                    out.append((key, num, True, False, None))
                    is_open, kept_px, kept_num, before = False, None, num, None
                    continue
                if is_open and before is not None and _distance(px, before) >= 2 * threshold:
                    is_open, kept_px = False, None
                before = px
                if is_open:
                    out.append((key, num, None, False, px))
                    continue
                keep = kept_px is None or not _distance(px, kept_px) < threshold
                out.append((key, num, keep, False, None))
                if keep:
                    kept_px, kept_num = px, num
            yield pd.DataFrame(out, columns=_MARK_COLUMNS).astype({"kept": "object"})
        if tile is not None and not is_open:
            yield pd.DataFrame([(tile, kept_num, True, True, kept_px)], columns=_MARK_COLUMNS).astype({"kept": "object"})

    return run


def _close_open_rows(threshold: float):
    """Decide the open rows of each tile in order, with the states met on the way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, kept_px = None, None
        for batch in batches:
            out = []
            for key, num, is_state, px in zip(batch.tile_key, batch.num, batch.is_state, batch.px):
                if key != tile:
                    tile, kept_px = key, None
                if is_state:
                    kept_px = px
                    continue
                keep = kept_px is None or not _distance(px, kept_px) < threshold
                if keep:
                    kept_px = px
                out.append((key, num, keep))
            yield pd.DataFrame(out, columns=["tile_key", "num", "kept"])

    return run


def drop_same_photo(tile_pixels: DataFrame, threshold: float = dims.SAME_PHOTO_THRESHOLD) -> DataFrame:
    """Versions of a tile that differ from the image kept last, oldest to newest.

    ``tile_pixels``: tile_key, num (rising with time), px (NULL: not decodable;
    such a version is kept and resets the memory).  Result: tile_key, num.

    The comparison is with the last *kept* image, so it is a fold, yet a tile
    with most of the rows is cut: pieces of the sorted table decide on their
    own whatever they can, and only rows that truly depend on an earlier piece
    go through the second, streaming pass.
    """
    key_type = dict(tile_pixels.dtypes)["tile_key"]
    px_type = dict(tile_pixels.dtypes)["px"]
    rows = tile_pixels.select("tile_key", F.col("num").cast("long").alias("num"), "px")
    marks = stable(
        rows.repartitionByRange("tile_key", "num")
        .sortWithinPartitions("tile_key", "num")
        .mapInPandas(
            _mark_pieces(threshold),
            f"tile_key {key_type}, num BIGINT, kept BOOLEAN, is_state BOOLEAN, px {px_type}",
        )
    )
    decided = marks.where(F.col("kept") & ~F.col("is_state")).select("tile_key", "num")
    waiting = marks.where(F.col("kept").isNull() | F.col("is_state"))
    closed = (
        waiting.select("tile_key", "num", "is_state", "px")
        .repartition("tile_key")
        .sortWithinPartitions("tile_key", "num", "is_state")
        .mapInPandas(_close_open_rows(threshold), f"tile_key {key_type}, num BIGINT, kept BOOLEAN")
    )
    return decided.unionByName(closed.where("kept").select("tile_key", "num"))


def version_hits(found: DataFrame) -> DataFrame:
    """In how many sample points each version turns up, newest first."""
    return (
        found.groupBy("num").agg(F.countDistinct("tile_key").alias("hits")).orderBy(F.col("num").desc())
    )


# ------------------------------------------------------------------ capture dates


def tile_metadata(responses: DataFrame, text: str = "response") -> DataFrame:
    """Source-image metadata out of a JSON response; an error stays as a value.

    ``covered`` is false when the service knows no image at the point.
    """
    schema = (
        "features ARRAY<STRUCT<attributes: STRUCT<SRC_DATE2: STRING, NICE_DESC: STRING, SRC_DESC: STRING, "
        "SAMP_RES: DOUBLE, SRC_ACC: DOUBLE>>>, error STRING"
    )
    r = F.from_json(F.col(text), schema)
    a = F.get(r["features"], F.lit(0))["attributes"]
    covered = F.coalesce(F.size(r["features"]) > 0, F.lit(False))
    return responses.withColumns(
        {
            "covered": covered,
            "capture": F.when(covered, epoch_ms_date(a["SRC_DATE2"])),
            "provider": F.when(covered, F.trim(F.coalesce(a["NICE_DESC"], F.lit("")))),
            "sensor": F.when(covered, F.trim(F.coalesce(a["SRC_DESC"], F.lit("")))),
            "res": F.when(covered, a["SAMP_RES"]),
            "accuracy": F.when(covered, a["SRC_ACC"]),
            "error": F.when(r.isNull(), F.lit("unreadable")).otherwise(r["error"]),
        }
    )


def nearest_points(points: DataFrame, lon: Column, lat: Column, k: int = dims.META_POINTS, by: Sequence[str] = ("num",)) -> DataFrame:
    """The ``k`` points nearest to a centre by planar distance, with their ``rank``.

    Spark keeps ``k`` rows per task and group before the shuffle.
    """
    gap = (F.col("lon") - lon) * (F.col("lon") - lon) + (F.col("lat") - lat) * (F.col("lat") - lat)
    w = Window.partitionBy(*by).orderBy("_gap", "lon", "lat")
    return (
        points.withColumn("_gap", gap)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .drop("_gap")
    )


def version_metadata(meta: DataFrame, lon: Column, lat: Column, k: int = dims.META_POINTS) -> DataFrame:
    """Per version over its nearest points: dates, sources, resolution, failures, summary text.

    Groups hold at most ``k`` rows, so listing them is safe.
    """
    near = nearest_points(meta, lon, lat, k)
    failed = F.col("error").isNotNull()
    usable = F.col("covered") & ~failed
    plain = F.when(F.col("provider") != "", F.col("provider"))
    both = (F.col("sensor") != "") & (F.col("sensor") != F.col("provider"))
    source = F.when(
        both, F.when(plain.isNotNull(), F.concat(plain, F.lit(" ("), F.col("sensor"), F.lit(")"))).otherwise(F.col("sensor"))
    ).otherwise(plain)
    per = near.groupBy("num").agg(
        F.array_sort(F.collect_set(F.when(usable, F.col("capture")))).alias("dates"),
        F.array_sort(F.collect_list(F.when(usable & source.isNotNull(), F.struct("rank", source.alias("s"))))).alias("_src"),
        F.min(F.when(usable & F.col("res").isNotNull(), F.struct("rank", "res"))).getField("res").alias("res"),
        F.min(F.when(usable & F.col("accuracy").isNotNull(), F.struct("rank", "accuracy"))).getField("accuracy").alias("accuracy"),
        F.count_if(failed).alias("failures"),
    )
    n = F.size("dates")
    first, last = F.get("dates", F.lit(0)), F.get("dates", n - 1)
    summary = (
        F.when((n == 0) & (F.col("failures") > 0), F.lit("?"))
        .when(n == 0, F.lit("—"))
        .when(n == 1, first)
        .otherwise(F.concat(first, F.lit("…"), last, F.lit(" ("), n.cast("string"), F.lit(")")))
    )
    return per.select(
        "num",
        F.array_join("dates", ",").alias("dates"),
        F.array_join(F.array_distinct(F.transform("_src", lambda x: x["s"])), " / ").alias("sources"),
        "res",
        "accuracy",
        "failures",
        summary.alias("summary"),
    )


_ANSWER = ("covered", "capture", "provider", "sensor", "res", "accuracy", "error")


def repair_metadata(meta: DataFrame, again: DataFrame, lon: Column, lat: Column, k: int = dims.META_POINTS) -> DataFrame:
    """The nearest points of each version, failed ones answered from a second pass.

    Only versions with a failure and no capture date are mended, and only where
    ``again`` brings one of their dates; all others keep their first answers.
    ``again`` has num, lon, lat and the columns of an answer, in any number of
    rows a point: an answer beats an error, then the least one counts.
    Rows without a place keep what they have.
    """
    failed, dated = F.col("error").isNotNull(), F.col("covered") & F.col("error").isNull() & F.col("capture").isNotNull()
    near = nearest_points(meta, lon, lat, k).drop("rank").select("num", "lon", "lat", *_ANSWER)
    version = Window.partitionBy("num")  # at most k rows each
    near = near.withColumn("_open", failed & (F.count_if(dated).over(version) == 0))
    second = again.where(failed.eqNullSafe(F.lit(False))).groupBy("num", "lon", "lat").agg(
        F.min(F.struct(*_ANSWER)).alias("_second")
    )
    met = near.join(second, ["num", "lon", "lat"], "left")
    answered = F.col("_open") & F.col("_second").isNotNull()
    comes = answered & F.col("_second.covered") & F.col("_second.capture").isNotNull()
    met = met.withColumn("_mend", answered & (F.count_if(comes).over(version) > 0))
    return met.select("num", "lon", "lat", *[F.when(F.col("_mend"), F.col("_second")[c]).otherwise(F.col(c)).alias(c) for c in _ANSWER])


def one_per_capture(versions: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, merged): one version per clean capture date, the one published last.

    Captures that are no full date are never merged.  ``merged`` names for
    every dropped version the one kept in its place.  The kept version is a
    running minimum, not a list, so a date with most of the versions is fine.
    """
    by = list(by)
    clean = F.coalesce(F.col("capture").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    dated, loose = versions.where(clean), versions.where(~clean)
    others = [c for c in versions.columns if c not in (*by, "capture")]
    best = dated.groupBy(*by, "capture").agg(
        F.min_by(F.struct(*others), "pos").alias("_best"), (F.count(F.lit(1)) - 1).alias("n_equivalent")
    )
    kept = best.select(*by, "capture", *[F.col("_best")[c].alias(c) for c in others], "n_equivalent")
    kept = kept.unionByName(loose.withColumn("n_equivalent", F.lit(0).cast("bigint"))).select(*versions.columns, "n_equivalent")
    names = best.select(*by, "capture", F.col("_best")["num"].alias("kept_num"))
    merged = dated.join(names, [*by, "capture"]).where(F.col("num") != F.col("kept_num"))
    return kept, merged.select(*by, "capture", "kept_num", "num", "published")


def add_current_mosaic(versions: DataFrame, tiles: DataFrame, grouped: bool = True, by: Sequence[str] = ("tile_key",)) -> DataFrame:
    """Put the live mosaic in front unless its tile equals the newest archived one.

    ``tiles``: by, current_tile, archived_tile (binary).  Equal tiles still add
    it when captures are not grouped; a tile that cannot be compared adds it.
    """
    equal = F.sha2(F.col("current_tile"), 256) == F.sha2(F.col("archived_tile"), 256)
    wanted = F.coalesce(~equal, F.lit(True)) | F.lit(not grouped)
    live = tiles.where(wanted).select(
        *by,
        F.lit(None).cast("long").alias("num"),
        F.lit("vigente").alias("published"),
        F.lit("n/d").alias("capture"),
        F.lit(-1).cast("long").alias("pos"),
    )
    return live.unionByName(versions.select(*by, F.col("num").cast("long"), "published", "capture", F.col("pos").cast("long")))
