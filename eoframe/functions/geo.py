"""Grids, tiles, boxes and map projection as column math."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eoframe import dims

# Metres per degree and the Web-Mercator pixel at zoom 0
M_PER_DEG_LON = 111320.0
M_PER_DEG_LAT = 110574.0
M_PER_DEG_LAT_AREA = 110570.0
MERCATOR_PIXEL = 156543.03392
MERCATOR_MAX_LAT = 85.05


def _clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def output_size(west: Column, south: Column, east: Column, north: Column, width: int) -> Column:
    """STRUCT<width, height> that keeps the true proportion; a degenerate box is square."""
    dx, dy = F.abs(east - west), F.abs(north - south)
    corrected = dx * F.greatest(F.lit(0.05), F.cos(F.radians((south + north) / 2.0)))
    height = F.bround(F.lit(float(width)) * (dy / F.nullif(corrected, F.lit(0.0)))).cast("int")
    flat = (dx <= 0) | (dy <= 0)
    return F.struct(
        F.lit(int(width)).alias("width"),
        F.when(flat, F.lit(int(width))).otherwise(F.greatest(F.lit(16), F.least(height, F.lit(4096)))).alias("height"),
    )


def metres_per_pixel(west: Column, south: Column, east: Column, north: Column, cols: Column, rows: Column) -> Column:
    """STRUCT<mx, my> at the centre of an image in degrees, NULL if degenerate."""
    w, h = east - west, north - south
    sound = (cols > 0) & (rows > 0) & (w > 0) & (h > 0)
    cos_lat = F.cos(F.radians(_clip((north + south) / 2.0, -89.9, 89.9)))
    return F.when(
        sound,
        F.struct(
            (w * M_PER_DEG_LON * cos_lat / F.nullif(cols, F.lit(0))).alias("mx"),
            (h * M_PER_DEG_LAT / F.nullif(rows, F.lit(0))).alias("my"),
        ),
    )


def tile_of(lon: Column, lat: Column, zoom: Column) -> Column:
    """STRUCT<col, row> of the Web-Mercator tile that holds a point."""
    side = F.pow(F.lit(2.0), zoom)
    rad = F.radians(_clip(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    down = (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0
    return F.struct(
        F.floor((lon + 180.0) / 360.0 * side).alias("col"), F.floor(down * side).alias("row")
    )


def zoom_for_resolution(res_m: Column, lat: Column) -> Column:
    """Zoom whose pixel is not larger than ``res_m``, within 0..23."""
    z = F.ceil(F.log2(F.lit(MERCATOR_PIXEL) * F.cos(F.radians(lat)) / res_m))
    return F.greatest(F.lit(0), F.least(F.lit(23), z)).cast("int")


def zoom_resolution(zoom: Column, lat: Column) -> Column:
    return F.lit(MERCATOR_PIXEL) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def sample_points(west: Column, south: Column, east: Column, north: Column, n: int) -> Column:
    """ARRAY<STRUCT<lon, lat>> of n x n cell centres; n of one or less gives the centre."""
    side = F.greatest(F.lit(n), F.lit(1))

    def centre(low: Column, high: Column, cell: Column) -> Column:
        return F.when(side == 1, (low + high) / 2.0).otherwise(low + (cell + 0.5) / side * (high - low))

    numbers = F.sequence(F.lit(0), side * side - 1)
    return F.transform(numbers, lambda k: F.struct(
        centre(west, east, F.floor(k / side)).alias("lon"), centre(south, north, k % side).alias("lat")))


def pixel_dimensions(west: Column, south: Column, east: Column, north: Column, res_m: Column) -> Column:
    """STRUCT<width_px, height_px> of a box in degrees, at least one each."""
    cos_lat = F.cos(F.radians((south + north) / 2.0))
    return F.struct(
        F.greatest(F.lit(1.0), F.abs(east - west) * M_PER_DEG_LON * cos_lat / res_m).alias("width_px"),
        F.greatest(F.lit(1.0), F.abs(north - south) * M_PER_DEG_LAT_AREA / res_m).alias("height_px"),
    )


def estimate_volume(
    west: Column, south: Column, east: Column, north: Column, indices: list[str], amplitude: bool, n_dates: Column, family: str,
    stretch: bool = False,
) -> Column:
    """STRUCT<gib, width_px, height_px> of the most demanding index.

    Without indices a stretch holds three copies of one band, and plain bands
    hold nothing.  Advice for sizing partitions before a run; nothing is refused
    here.
    """
    finest = {key: dims.LANDSAT_RES if family == "ls" else float(res) for key, _, _, _, res, _, _ in dims.BANDS}
    kinds = [F.struct(F.lit(min(finest[b] for b in dims.INDEX_BANDS[i])).alias("res"), F.lit(len(dims.INDEX_BANDS[i]) + 2.0).alias("copies")) for i in indices]
    if not kinds:
        res = dims.LANDSAT_RES if family == "ls" else dims.DEFAULT_S2_RES
        kinds = [F.struct(F.lit(float(res)).alias("res"), F.lit(3.0 if stretch else 0.0).alias("copies"))]
    least = F.greatest(n_dates, F.lit(1)) * 2.0 + 8.0 if amplitude and indices else F.lit(0.0)

    def need(kind: Column) -> Column:
        d = pixel_dimensions(west, south, east, north, kind["res"])
        gib = d["width_px"] * d["height_px"] * 4.0 * F.greatest(kind["copies"], least) / float(1024**3)
        return F.struct(gib.alias("gib"), d["width_px"].alias("width_px"), d["height_px"].alias("height_px"))

    return F.array_max(F.transform(F.array(*kinds), need))


def pixel_area(dx: Column, dy: Column) -> Column:
    """Square metres per pixel, NULL when the grid is in degrees."""
    return F.when(F.abs(dx) >= 0.01, F.abs(dx * dy))


def same_frame(
    x0: Column, y0: Column, dx: Column, dy: Column, cols: Column, rows: Column,
    west: Column, south: Column, east: Column, north: Column, tolerance_px: float = 1.0,
) -> Column:
    """Does a raster cover the asked box, all four edges within the tolerance?"""
    worst = F.greatest(
        F.abs(x0 - west), F.abs(x0 + cols * dx - east), F.abs(y0 - north), F.abs(y0 + rows * dy - south)
    )
    return worst <= F.abs(dx) * tolerance_px


# ------------------------------------------------------------------ projection

# WGS84 and the scale of the UTM projection
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm_angles(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(t, lam) of a point for :func:`utm_sphere`: tangent of the conformal latitude, longitude from the middle of the zone."""
    n = _FLAT / (2 - _FLAT)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s)), F.radians(lon - (epsg % 100 * 6 - 183))


def utm_sphere(t: Column, lam: Column) -> tuple[Column, Column]:
    """(xi, eta) on the conformal sphere, for :func:`utm_plane`."""
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def utm_plane(xi: Column, eta: Column, epsg: Column) -> Column:
    """STRUCT<x, y> in a UTM code, NULL for another code."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    hemisphere = F.floor(epsg / 100)
    known = hemisphere.isin(326, 327) & (epsg % 100).between(1, 60)
    x, y = eta, xi
    for j, a in enumerate(alpha, start=1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = F.when(hemisphere == 327, F.lit(10000000.0)).otherwise(F.lit(0.0))
    return F.when(
        known,
        F.struct((F.lit(500000.0) + x * _K0 * radius).alias("x"), (north + y * _K0 * radius).alias("y")),
    )


def utm_forward(lon: Column, lat: Column, epsg: Column, bound: bool = False) -> Column:
    """STRUCT<x, y> of WGS84 degrees in a UTM code (326zz north, 327zz south), else NULL.

    Series of Krueger to the third order: below a millimetre inside a zone.
    ``bound`` is for use inside a lambda function, where no subexpression is
    shared: each step is bound to a variable, for written out it would be
    computed in each term of the next one.  Literals fold only without it.
    """
    if not bound:
        return utm_plane(*utm_sphere(*utm_angles(lon, lat, epsg)), epsg)
    start = F.struct(*[c.alias(k) for k, c in zip(("t", "lam"), utm_angles(lon, lat, epsg))])
    sphere = let(start, lambda p: F.struct(*[c.alias(k) for k, c in zip(("xi", "eta"), utm_sphere(p["t"], p["lam"]))]))
    return let(sphere, lambda p: utm_plane(p["xi"], p["eta"], epsg))


def utm_inverse(x: Column, y: Column, epsg: Column) -> Column:
    """STRUCT<lon, lat> of a point in a UTM code, NULL for another code; undoes :func:`utm_forward` below a millimetre."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * _K0
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    zone, hemisphere = epsg % 100, F.floor(epsg / 100)
    known = hemisphere.isin(326, 327) & zone.between(1, 60)
    eta = (x - F.lit(500000.0)) / F.lit(radius)
    xi = (y - F.when(hemisphere == 327, F.lit(10000000.0)).otherwise(F.lit(0.0))) / F.lit(radius)
    to_xi, to_eta = xi, eta
    for j, b in enumerate(beta, start=1):
        to_xi = to_xi - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        to_eta = to_eta - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(to_xi) / F.cosh(to_eta))
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(to_eta), F.cos(to_xi))
    return F.when(known, F.struct((F.degrees(lam) + (zone * 6 - 183)).alias("lon"), F.degrees(phi).alias("lat")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reproject(x: Column, y: Column, source: Column, target: Column) -> Column:
    """STRUCT<x, y> of a point of one code in another (UTM, or 4326 in degrees); equal codes change nothing."""
    flat = F.struct(x.alias("lon"), y.alias("lat"))
    at = F.when(source == 4326, flat).otherwise(utm_inverse(x, y, source))

    def onto(p: Column) -> Column:
        return F.when(target == 4326, F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).otherwise(utm_forward(p["lon"], p["lat"], target, bound=True))

    # the point in degrees is bound to a variable: written out, it would stand in each term of the second series
    far = let(at, onto)
    return F.when(source == target, F.struct(x.alias("x"), y.alias("y"))).otherwise(far)


_NUMBER = r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?"
_POSITION = rf"\[\s*({_NUMBER})\s*,\s*({_NUMBER})\s*(?:,\s*{_NUMBER}\s*)*\]"


def geojson_bounds(geometry: Column) -> Column:
    """STRUCT<west, south, east, north> of the text of a GeoJSON geometry or of its coordinates; NULL without a position.

    A position is an innermost array of numbers, so points, polygons, their
    collections and heights need no recursion.  A geometry cut at the date line
    touches both its sides and leaves more than half of the circle free between
    them; its box has west > east, as boxes of items across the date line do.
    """
    xs, ys = (F.regexp_extract_all(geometry, F.lit(_POSITION), F.lit(g)).cast("array<double>") for g in (1, 2))
    at = F.array_sort(F.array_distinct(xs))
    low, high = F.get(at, F.lit(0)), F.get(at, F.size(at) - 1)
    # the widest stretch without a position between the two sides, as (width, its west end, its east end)
    gaps = F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.struct((b - a).alias("w"), a.alias("a"), b.alias("b")))
    widest = F.array_max(gaps)
    cut = F.coalesce((low == -180) & (high == 180) & (F.size(at) > 2) & (widest["w"] > 180), F.lit(False))
    return F.when(
        F.size(at) > 0,
        F.struct(
            F.when(cut, widest["b"]).otherwise(low).alias("west"), F.array_min(ys).alias("south"),
            F.when(cut, widest["a"]).otherwise(high).alias("east"), F.array_max(ys).alias("north"),
        ),
    )


def ring_edges(rings: Sequence[Sequence[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    """Edges (x1, y1, x2, y2) of all rings, each closed."""
    edges = []
    for ring in rings:
        closed = ring if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]]
        edges += [tuple(float(v) for v in (*a, *b)) for a, b in zip(closed, closed[1:])]
    return edges


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray to the right of (x, y) meets an odd number of ``edges``, an array of arrays x1, y1, x2, y2."""
    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = (F.get(e, F.lit(i)) for i in range(4))
        straddles = (y1 > y) != (y2 > y)
        at = (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
        return F.coalesce(straddles & (x < at), F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))


def point_in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings (holes and several parts included).

    A box test comes first; the edges are one literal array, folded only for
    the points inside the box.  For outlines of many points see
    :func:`eoframe.operators.grid.crop_polygon`.
    """
    edges = ring_edges(rings)
    xs = [v for e in edges for v in (e[0], e[2])]
    ys = [v for e in edges for v in (e[1], e[3])]
    table = F.array(*[F.array(*[F.lit(v) for v in e]) for e in edges])
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return F.when(box, odd_crossings(x, y, table)).otherwise(F.lit(False))
