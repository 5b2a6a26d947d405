"""Crops, resampling and alignment of pixel tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.functions.geo import let, odd_crossings, point_in_polygon, reproject, ring_edges, utm_angles, utm_forward, utm_inverse, utm_plane, utm_sphere


@dataclass(frozen=True)
class Grid:
    """A raster frame: origin at the first pixel's outer corner, steps along x and y."""

    x0: float
    y0: float
    dx: float
    dy: float
    cols: int
    rows: int


def crop_bbox(pixels: DataFrame, bbox: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """Pixel centres inside a box; plain comparisons that reach the Parquet scan."""
    w, s, e, n = (float(v) for v in bbox)
    return pixels.where(F.col(x).between(w, e) & F.col(y).between(s, n))


# Edges a pixel is held against as literals; longer outlines are cut into strips.
LITERAL_EDGES = 16

# Rows of the strip table per edge; an entry is 32 bytes, so 500 000 of them stay below 20 MB.
_PER_EDGE = 4
STRIP_BROADCAST = 500_000


def _strip_count(edges: np.ndarray) -> int:
    """The finest power of two of strips in which all edges together have at most ``_PER_EDGE`` entries each.

    One strip always qualifies, so the bound holds for every outline.
    """
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    bottom, height = low.min(), high.max() - low.min()
    strips = 1
    while strips < len(edges):
        scale = 2 * strips / height
        entries = (np.floor((high - bottom) * scale) - np.floor((low - bottom) * scale) + 1).sum()
        if not entries <= _PER_EDGE * len(edges):
            break
        strips *= 2
    return strips


def crop_polygon(
    pixels: DataFrame, rings: list[list[tuple[float, float]]], x: str = "x", y: str = "y", literal: int = LITERAL_EDGES
) -> DataFrame:
    """Pixel centres inside the cut line by the even-odd rule; its box is a pushed-down filter of its own.

    Points without a place are outside, and so is everything for an outline without height.

    Outlines of more than ``literal`` edges are cut into horizontal strips: an
    edge is listed in each strip it passes through, and a pixel meets the edges of its own
    strip only.  Both ways use one expression, so their answers are the same.
    The strip table has at most four entries an edge; below ``STRIP_BROADCAST``
    entries it is broadcast and no pixel moves, beyond that the join is left to
    Spark's own size checks.
    """
    edges = [e for e in ring_edges(rings) if e[1] != e[3]]  # a level edge is never crossed
    xs = [p[0] for r in rings for p in r]
    ys = [p[1] for r in rings for p in r]
    boxed = crop_bbox(pixels, (min(xs), min(ys), max(xs), max(ys)), x, y)
    if not edges:
        return boxed.where(F.lit(False))
    if len(edges) <= literal:
        return boxed.where(point_in_polygon(F.col(x), F.col(y), rings))
    known = np.array(edges, dtype=float)
    bottom = float(known[:, [1, 3]].min())
    scale = _strip_count(known) / (float(known[:, [1, 3]].max()) - bottom)

    def strip(v: Column) -> Column:
        # never decreases with v, so the strips of an edge's ends enclose those of its points
        return F.floor((v - F.lit(bottom)) * F.lit(scale))

    table = pixels.sparkSession.createDataFrame(pd.DataFrame(known, columns=["x1", "y1", "x2", "y2"]))
    e = {c: F.col(c) for c in table.columns}
    listed = (
        table.select(
            F.array(*e.values()).alias("_edge"),
            F.explode(F.sequence(strip(F.least(e["y1"], e["y2"])), strip(F.greatest(e["y1"], e["y2"])))).alias("_strip"),
        )
        .groupBy("_strip")
        .agg(F.collect_list("_edge").alias("_edges"))
    )
    if _PER_EDGE * len(edges) <= STRIP_BROADCAST:
        listed = F.broadcast(listed)
    met = boxed.withColumn("_strip", strip(F.col(y))).join(listed, "_strip")
    return met.where(odd_crossings(F.col(x), F.col(y), F.col("_edges"))).select(*pixels.columns)


def resample_average(pixels: DataFrame, k: int, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of k x k blocks, NULLs left out; combines before the shuffle."""
    return pixels.groupBy(
        *by, F.floor(F.col("px_col") / k).alias("px_col"), F.floor(F.col("px_row") / k).alias("px_row")
    ).agg(*[F.avg(v).alias(v) for v in values])


def _cells(lo: Column, hi: Column, count: int) -> Column:
    """Cell numbers lo..hi inside 0..count-1 as an array, empty if there are none."""
    lo = F.greatest(lo.cast("int"), F.lit(0))
    hi = F.least(hi.cast("int"), F.lit(count - 1))
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))


def _onto(pixels: DataFrame, cols: Column, rows: Column, extra: Sequence[str]) -> DataFrame:
    wide = pixels.withColumns({"_tc": cols, "_tr": rows}).where((F.size("_tc") > 0) & (F.size("_tr") > 0))
    return wide.select(*extra, F.explode("_tc").alias("t_col"), "_tr").select(*extra, "t_col", F.explode("_tr").alias("t_row"))


def resample_nearest(
    pixels: DataFrame, source: Grid | None, target: Grid, by: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Value of the source pixel that holds each target centre; classes are never mixed.

    Each source pixel names the target cells it covers, so there is no join
    and no shuffle.  Without ``source`` the frame is read from columns x0, y0,
    dx, dy of the rows.
    """
    x0, y0, dx, dy = _frame(source)

    def covered(pos: Column, o: Column, d: Column, to: float, td: float, n: int) -> Column:
        a = ((o + pos * d) - to) / td - 0.5
        b = ((o + (pos + 1) * d) - to) / td - 0.5
        return _cells(F.ceil(F.least(a, b)), F.ceil(F.greatest(a, b)) - 1, n)

    cols = covered(F.col("px_col"), x0, dx, target.x0, target.dx, target.cols)
    rows = covered(F.col("px_row"), y0, dy, target.y0, target.dy, target.rows)
    keep = [*by, *values]
    return _onto(pixels, cols, rows, keep).select(*by, F.col("t_col").alias("px_col"), F.col("t_row").alias("px_row"), *values)


def _frame(source: Grid | None) -> tuple[Column, Column, Column, Column]:
    if source is None:
        return tuple(F.col(c) for c in ("x0", "y0", "dx", "dy"))
    return tuple(F.lit(float(v)) for v in (source.x0, source.y0, source.dx, source.dy))


def resample_bilinear(
    pixels: DataFrame, source: Grid | None, target: Grid, by: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Bilinear values on the target grid, weighted over the valid neighbours.

    Source pixels spread to the target centres less than one source step away
    and the weights meet in one grouping that combines before the shuffle;
    nothing is joined.  A target without a valid neighbour has no row.
    """
    x0, y0, dx, dy = _frame(source)

    def reached(pos: Column, o: Column, d: Column, to: float, td: float, n: int) -> Column:
        centre = o + (pos + 0.5) * d
        a = ((centre - F.abs(d)) - to) / td - 0.5
        b = ((centre + F.abs(d)) - to) / td - 0.5
        return _cells(F.floor(F.least(a, b)), F.ceil(F.greatest(a, b)), n)

    placed = pixels.withColumns({"_sx": x0 + (F.col("px_col") + 0.5) * dx, "_sy": y0 + (F.col("px_row") + 0.5) * dy, "_dx": dx, "_dy": dy})
    cols = reached(F.col("px_col"), x0, dx, target.x0, target.dx, target.cols)
    rows = reached(F.col("px_row"), y0, dy, target.y0, target.dy, target.rows)
    spread = _onto(placed, cols, rows, [*by, *values, "_sx", "_sy", "_dx", "_dy"])
    tx = F.lit(target.x0) + (F.col("t_col") + 0.5) * F.lit(target.dx)
    ty = F.lit(target.y0) + (F.col("t_row") + 0.5) * F.lit(target.dy)
    wx = F.greatest(F.lit(0.0), 1.0 - F.abs((tx - F.col("_sx")) / F.col("_dx")))
    wy = F.greatest(F.lit(0.0), 1.0 - F.abs((ty - F.col("_sy")) / F.col("_dy")))
    weighted = spread.withColumn("_w", wx * wy).where(F.col("_w") > 0)
    out = weighted.groupBy(*by, F.col("t_col").alias("px_col"), F.col("t_row").alias("px_row")).agg(
        *[
            F.try_divide(F.sum(F.col(v) * F.col("_w")), F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v)
            for v in values
        ]
    )
    some = F.lit(False)
    for v in values:
        some = some | F.col(v).isNotNull()
    return out.where(some)


def align_to_reference(stack: DataFrame, reference: Grid, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """All scenes on the reference grid: equal frames pass through, the others are resampled.

    ``stack`` carries its frame per row (x0, y0, dx, dy).
    """
    same = (
        (F.col("x0") == reference.x0)
        & (F.col("y0") == reference.y0)
        & (F.col("dx") == reference.dx)
        & (F.col("dy") == reference.dy)
    )
    # a row without a frame stays on the reference grid, as one whose frame is the reference's
    same = F.coalesce(same, F.lit(True))
    inside = F.col("px_col").between(0, reference.cols - 1) & F.col("px_row").between(0, reference.rows - 1)
    untouched = stack.where(same & inside).select(
        *by, F.col("px_col").cast("int").alias("px_col"), F.col("px_row").cast("int").alias("px_row"), *values
    )
    return untouched.unionByName(resample_bilinear(stack.where(~same), None, reference, by, values))


FRAME = ("x0", "y0", "dx", "dy", "epsg")


def reproject_bilinear(stack: DataFrame, target: Grid, epsg: int, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Pixels of any frame and UTM zone on one grid: bilinear values weighted over the valid neighbours.

    Rows carry ``FRAME``.  The corners one source step around a pixel, mapped
    forward, tell the target cells that may use it; the centre of each of these,
    mapped back, tells its weight in the steps of the source.  So no pixel is
    joined, and the weights meet in one grouping that combines before its shuffle.
    """
    x0, y0, dx, dy, code = (F.col(c) for c in FRAME)
    to = F.lit(epsg)
    placed = stack.withColumns({"_sx": x0 + (F.col("px_col") + 0.5) * dx, "_sy": y0 + (F.col("px_row") + 0.5) * dy})

    def reached(at: Column, o: float, d: float, n: int) -> Column:
        # one cell more on either side: the edges between corners are curved by less than that
        a, b = (F.array_min(at) - o) / d - 0.5, (F.array_max(at) - o) / d - 0.5
        return let(F.struct(F.floor(F.least(a, b)).alias("a"), F.ceil(F.greatest(a, b)).alias("b")), lambda r: _cells(r["a"] - 1, r["b"] + 1, n))

    around = F.array(*[F.struct((F.col("_sx") + a * F.abs(dx)).alias("x"), (F.col("_sy") + b * F.abs(dy)).alias("y")) for a in (-1, 1) for b in (-1, 1)])
    corners = F.transform(around, lambda p: reproject(p["x"], p["y"], code, to))
    cells = let(corners, lambda c: F.struct(reached(c["x"], target.x0, target.dx, target.cols).alias("c"), reached(c["y"], target.y0, target.dy, target.rows).alias("r")))
    keep = [*by, *values, "_sx", "_sy", "dx", "dy", "epsg"]
    spread = placed.select(*keep, cells.alias("_cells")).select(*keep, F.explode("_cells.c").alias("t_col"), "_cells")
    spread = spread.select(*keep, "t_col", F.explode("_cells.r").alias("t_row"))
    tx, ty = F.lit(target.x0) + (F.col("t_col") + 0.5) * F.lit(target.dx), F.lit(target.y0) + (F.col("t_row") + 0.5) * F.lit(target.dy)

    def weight(t: Column) -> Column:
        steps = [F.abs((t[c] - F.col(f"_s{c}")) / F.col(f"d{c}")) for c in ("x", "y")]
        return F.greatest(F.lit(0.0), 1.0 - steps[0]) * F.greatest(F.lit(0.0), 1.0 - steps[1])

    weighted = spread.withColumn("_w", let(reproject(tx, ty, to, code), weight)).where(F.col("_w") > 0)
    out = weighted.groupBy(*by, F.col("t_col").alias("px_col"), F.col("t_row").alias("px_row")).agg(
        *[F.try_divide(F.sum(F.col(v) * F.col("_w")), F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v) for v in values]
    )
    return out.where(F.coalesce(*[F.col(v) for v in values]).isNotNull())


def align_scenes(
    stack: DataFrame, reference: Grid, epsg: int, by: Sequence[str], values: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(pixels on the reference grid, rejected scenes with their row counts).

    Rows carry ``FRAME``.  Those of the reference's own frame pass through, others
    are reprojected; rows of an unknown place (a NULL in the frame, or a code
    that is neither UTM nor 4326) can't be placed and are counted by ``by``.
    """
    code = F.col("epsg")
    known = (code == 4326) | (F.floor(code / 100).isin(326, 327) & (code % 100).between(1, 60))
    placed = F.coalesce(known & F.col("x0").isNotNull() & F.col("y0").isNotNull() & (F.col("dx") != 0) & (F.col("dy") != 0), F.lit(False))
    same = (F.col("x0") == reference.x0) & (F.col("y0") == reference.y0) & (F.col("dx") == reference.dx) & (F.col("dy") == reference.dy) & (code == epsg)
    inside = F.col("px_col").between(0, reference.cols - 1) & F.col("px_row").between(0, reference.rows - 1)
    untouched = stack.where(placed & same & inside).select(
        *by, F.col("px_col").cast("int").alias("px_col"), F.col("px_row").cast("int").alias("px_row"), *values
    )
    moved = reproject_bilinear(stack.where(placed & ~same), reference, epsg, by, values)
    rejected = stack.where(~placed).groupBy(*by).agg(F.count("*").alias("n_rows"))
    return untouched.unionByName(moved), rejected


def crop_geographic(
    pixels: DataFrame, bbox: Sequence[float], epsg: int, x: str = "x", y: str = "y", rings: list[list[tuple[float, float]]] | None = None
) -> DataFrame:
    """Pixels of a UTM code inside a box, and a cut line, in degrees.

    The box is the envelope of points along its edges in the pixels' code; it is
    made of literals only, which fold to four numbers that reach the scan.
    """
    edge = [utm_forward(lon, lat, F.lit(epsg)) for lon, lat in _edge_points(*[F.lit(float(v)) for v in bbox])]
    xs, ys = [p["x"] for p in edge], [p["y"] for p in edge]
    boxed = pixels.where(F.col(x).between(F.least(*xs), F.greatest(*xs)) & F.col(y).between(F.least(*ys), F.greatest(*ys)))
    if not rings:
        return boxed
    at = utm_inverse(F.col(x), F.col(y), F.lit(epsg))
    placed = boxed.withColumn("_at", at)
    return crop_polygon(placed, rings, "_at.lon", "_at.lat").drop("_at")


def _edge_points(w: Column, s: Column, e: Column, n: Column, steps: int = 8) -> list[tuple[Column, Column]]:
    points = []
    for i in range(steps + 1):
        f = F.lit(i / steps)
        points += [(w + f * (e - w), s), (w + f * (e - w), n), (w, s + f * (n - s)), (e, s + f * (n - s))]
    return points


def project_points(points: DataFrame, lon: str = "lon", lat: str = "lat", epsg: str = "epsg") -> DataFrame:
    """Adds x, y in the UTM code of the row; an unknown code gives NULL."""
    return points.withColumn("_xy", utm_forward(F.col(lon), F.col(lat), F.col(epsg))).select(
        "*", F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y")
    ).drop("_xy")


def project_bbox(boxes: DataFrame, steps: int = 8) -> DataFrame:
    """Adds x_min, y_min, x_max, y_max: envelope of points along the edges in the row's UTM code.

    The points are columns, worked out in three steps that each read the
    columns of the one before, so nothing is exploded or shuffled and no value
    is computed twice.
    """
    epsg = F.col("epsg")
    points = _edge_points(*[F.col(c) for c in ("west", "south", "east", "north")], steps)
    names = range(len(points))
    angles = [utm_angles(lon, lat, epsg) for lon, lat in points]
    out = boxes.select("*", *[c.alias(f"_{k}{i}") for i in names for k, c in zip(("t", "lam"), angles[i])])
    sphere = [utm_sphere(F.col(f"_t{i}"), F.col(f"_lam{i}")) for i in names]
    out = out.select(*boxes.columns, *[c.alias(f"_{k}{i}") for i in names for k, c in zip(("xi", "eta"), sphere[i])])
    plane = [utm_plane(F.col(f"_xi{i}"), F.col(f"_eta{i}"), epsg) for i in names]
    out = out.select(*boxes.columns, *[c[k].alias(f"_{k}{i}") for i, c in enumerate(plane) for k in ("x", "y")])
    ends = [fn(*[F.col(f"_{k}{i}") for i in names]).alias(f"{k}_{end}") for end, fn in (("min", F.least), ("max", F.greatest)) for k in ("x", "y")]
    return out.select(*boxes.columns, *ends)
