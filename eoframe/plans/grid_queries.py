"""Queries over boxes, tiles, crops and resampled pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.functions import geo
from eoframe.operators import grid as gr
from eoframe.operators.grid import Grid
from eoframe.plans.registry import query
from eoframe.plans.views import Tables, r, rs, with_views

BOX = ("west", "south", "east", "north")
_COS = "cos(radians((south + north) / 2.0E0))"


def boxes(t: Tables) -> DataFrame:
    """Scene boxes of varying size: the cloud value stretches them."""
    return t.view("scenes").select(
        "scene_id", "west", "south", (F.col("west") + F.coalesce("cloud_pct", F.lit(0.0)) / 10.0).alias("east"),
        (F.col("south") + F.coalesce("aoi_cloud_pct", F.lit(0.0)) / 20.0).alias("north"))


_BOXES = "WITH b AS (SELECT scene_id, west, south, west + coalesce(cloud_pct, 0.0E0) / 10.0E0 AS east, south + coalesce(aoi_cloud_pct, 0.0E0) / 20.0E0 AS north FROM scenes) "


def sides():
    return tuple(F.col(c) for c in BOX)



@query(with_views(_BOXES + f"""
, h AS (SELECT *, 512.0E0 * (abs(north - south) / nullif(abs(east - west) * greatest(0.05E0, {_COS}), 0.0E0)) AS h FROM b)
SELECT scene_id, 512 AS width, CAST(CASE WHEN abs(east - west) <= 0 OR abs(north - south) <= 0 THEN 512
  ELSE greatest(16, least(round_even(h, 0), 4096)) END AS INT) AS height FROM h""", "scenes"))
def output_size(t: Tables) -> DataFrame:
    return boxes(t).select("scene_id", geo.output_size(*sides(), 512).alias("s")).select("scene_id", "s.width", "s.height")


@query(with_views(_BOXES + f"""
SELECT scene_id, CASE WHEN east > west AND north > south THEN {rs(f'(east - west) * 111320.0E0 * {_COS} / 640', 6)} END AS mx,
  CASE WHEN east > west AND north > south THEN {rs('(north - south) * 110574.0E0 / 480', 6)} END AS my FROM b""", "scenes"))
def metres_per_pixel(t: Tables) -> DataFrame:
    m = geo.metres_per_pixel(*sides(), F.lit(640), F.lit(480))
    return boxes(t).select("scene_id", m.alias("m")).select("scene_id", r("m.mx", 6).alias("mx"), r("m.my", 6).alias("my"))


_TILE = "floor({lat} * pow(2.0E0, {z}))".format(
    lat="((1.0E0 - ln(tan(radians(greatest(-85.05E0, least(85.05E0, lat)))) + 1.0E0 / cos(radians(greatest(-85.05E0, least(85.05E0, lat))))) / pi()) / 2.0E0)", z="zoom")


def spots(t: Tables) -> DataFrame:
    """World-wide points out of the line items."""
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_extendedprice") * 100).cast("bigint") % 36000 / 100.0 - 180.0).alias("lon"),
        (F.col("l_orderkey") % 1790 / 10.0 - 89.5).alias("lat"), (F.col("l_linenumber") * 3).cast("int").alias("zoom"))


_SPOTS = """WITH p AS (SELECT l_orderkey, l_linenumber, trunc(l_extendedprice * 100)::BIGINT % 36000 / 100.0E0 - 180.0E0 AS lon,
  l_orderkey % 1790 / 10.0E0 - 89.5E0 AS lat, CAST(l_linenumber * 3 AS INT) AS zoom FROM lineitem) """


@query(_SPOTS + f"""
SELECT l_orderkey, l_linenumber, CAST(floor((lon + 180.0E0) / 360.0E0 * pow(2.0E0, zoom)) AS BIGINT) AS col, CAST({_TILE} AS BIGINT) AS row FROM p""")
def tile_of(t: Tables) -> DataFrame:
    tile = geo.tile_of(F.col("lon"), F.col("lat"), F.col("zoom"))
    return spots(t).select("l_orderkey", "l_linenumber", tile.alias("t")).select("l_orderkey", "l_linenumber", "t.col", "t.row")


@query(_SPOTS + f"""
SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(23, ceil(log2(156543.03392E0 * cos(radians(lat)) / (l_linenumber * 0.7E0))))) AS INT) AS zoom,
  {rs('156543.03392E0 * cos(radians(lat)) / pow(2.0E0, zoom)', 6)} AS res FROM p""")
def zoom_for_resolution(t: Tables) -> DataFrame:
    z = geo.zoom_for_resolution(F.col("l_linenumber") * 0.7, F.col("lat"))
    return spots(t).select("l_orderkey", "l_linenumber", z.alias("zoom"), r(geo.zoom_resolution(F.col("zoom"), F.col("lat")), 6).alias("res"))


@query(with_views(_BOXES + f"""
SELECT scene_id, {rs('west + (i + 0.5E0) / 3 * (east - west)')} AS lon, {rs('south + (j + 0.5E0) / 3 * (north - south)')} AS lat
FROM b CROSS JOIN range(0, 3) AS a(i) CROSS JOIN range(0, 3) AS c(j)""", "scenes"))
def sample_points(t: Tables) -> DataFrame:
    rows = boxes(t).select("scene_id", F.explode(geo.sample_points(*sides(), 3)).alias("p"))
    return rows.select("scene_id", r("p.lon").alias("lon"), r("p.lat").alias("lat"))


@query(with_views(_BOXES + f"""
SELECT scene_id, {rs(f'greatest(1.0E0, abs(east - west) * 111320.0E0 * {_COS} / 30.0E0)', 6)} AS width_px,
  {rs('greatest(1.0E0, abs(north - south) * 110570.0E0 / 30.0E0)', 6)} AS height_px FROM b""", "scenes"))
def pixel_dimensions(t: Tables) -> DataFrame:
    d = geo.pixel_dimensions(*sides(), F.lit(30.0))
    return boxes(t).select("scene_id", d.alias("d")).select("scene_id", r("d.width_px", 6).alias("width_px"), r("d.height_px", 6).alias("height_px"))


_WIDE = "greatest(1.0E0, abs(east - west) * 111320.0E0 * " + _COS + " / {0}E0) * greatest(1.0E0, abs(north - south) * 110570.0E0 / {0}E0) * 4.0E0 * {1} / 1073741824.0E0"


@query(with_views(_BOXES + f"""
SELECT scene_id, {rs('greatest(' + _WIDE.format('10.0', '28.0E0') + ', ' + _WIDE.format('20.0', '28.0E0') + ')', 6)} AS gib FROM b""", "scenes"))
def estimate_volume(t: Tables) -> DataFrame:
    v = geo.estimate_volume(*sides(), ["NDVI", "NDMI", "TCB"], True, F.lit(10), "s2")
    return boxes(t).select("scene_id", r(v["gib"], 6).alias("gib"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_tax / 4) >= 0.01E0 THEN abs(l_tax / 4 * -l_quantity) END AS area FROM lineitem")
def pixel_area(t: Tables) -> DataFrame:
    area = geo.pixel_area(F.col("l_tax") / 4, -F.col("l_quantity"))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", area.alias("area"))


@query("""SELECT l_orderkey, l_linenumber, greatest(abs(l_quantity - 25.0E0), abs(l_quantity + 100 * 20.0E0 - 2030.0E0),
  abs(l_linenumber * 5.0E0 - 20.0E0), abs(l_linenumber * 5.0E0 - 2000.0E0 + 1985.0E0)) <= 20.0E0 AS same FROM lineitem""")
def same_frame(t: Tables) -> DataFrame:
    same = geo.same_frame(F.col("l_quantity"), F.col("l_linenumber") * 5.0, F.lit(20.0), F.lit(-20.0), F.lit(100), F.lit(100),
                          F.lit(25.0), F.lit(-1985.0), F.lit(2030.0), F.lit(20.0))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", same.alias("same"))


# ------------------------------------------------------------------------ crops

RING = [(3.0, 2.0), (46.5, 1.0), (40.0, 30.0), (22.0, 12.0), (5.0, 38.5)]


def centres(t: Tables) -> DataFrame:
    return t.view("obs").select("l_orderkey", "l_linenumber", (F.col("px_col") + 0.5).alias("x"), (F.col("px_row") + 0.5).alias("y"))


_CENTRES = "WITH c AS (SELECT l_orderkey, l_linenumber, px_col + 0.5E0 AS x, px_row + 0.5E0 AS y FROM obs) "
_CROSSINGS = " + ".join(
    f"CASE WHEN ({y1}E0 > y) <> ({y2}E0 > y) AND x < ({x2 - x1}E0) * (y - {y1}E0) / nullif({y2 - y1}E0, 0.0E0) + {x1}E0 THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]))


@query(with_views(_CENTRES + "SELECT * FROM c WHERE x BETWEEN 10.0E0 AND 30.25E0 AND y BETWEEN 5.0E0 AND 20.5E0", "obs"))
def crop_bbox(t: Tables) -> DataFrame:
    return gr.crop_bbox(centres(t), (10.0, 5.0, 30.25, 20.5))


@query(with_views(_CENTRES + f"SELECT * FROM c WHERE ({_CROSSINGS}) % 2 = 1", "obs"))
def crop_polygon(t: Tables) -> DataFrame:
    return gr.crop_polygon(centres(t), [RING])


# an outline of 1802 points, ragged on both sides
OUTLINE = ([(3.0 + (i * 7 % 13) / 3.0, i / 24.0) for i in range(901)]
           + [(46.5 - (i * 5 % 11) / 7.0, i / 24.0) for i in range(900, -1, -1)])


@query(with_views(_CENTRES + """,
v AS (SELECT CAST(i AS INT) AS i, i / 24.0E0 AS y, 3.0E0 + (i * 7 % 13) / 3.0E0 AS l, 46.5E0 - (i * 5 % 11) / 7.0E0 AS r FROM range(0, 901) AS n(i)),
e AS (SELECT a.l AS x1, a.y AS y1, b.l AS x2, b.y AS y2, a.y AS lo, b.y AS hi FROM v AS a JOIN v AS b ON b.i = a.i + 1
  UNION ALL SELECT b.r, b.y, a.r, a.y, a.y, b.y FROM v AS a JOIN v AS b ON b.i = a.i + 1),
k AS (SELECT *, row_number() OVER () AS no FROM c),
n AS (SELECT k.no, k.l_orderkey, k.l_linenumber, k.x, k.y, count(*) AS crossed FROM k JOIN e ON k.y >= e.lo AND k.y < e.hi
  WHERE k.x < (x2 - x1) * (k.y - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, x, y FROM n WHERE crossed % 2 = 1""", "obs"))
def crop_outline(t: Tables) -> DataFrame:
    return gr.crop_polygon(centres(t), [OUTLINE])


# ------------------------------------------------------------------- resampling

def raster(t: Tables) -> DataFrame:
    """One red value per scene and pixel; the second red of a pixel and scene is averaged."""
    return t.view("obs").groupBy("scene_id", "px_col", "px_row").agg(F.avg("red").alias("v"))


_RASTER = "WITH s AS (SELECT scene_id, px_col, px_row, avg(red) AS v FROM obs GROUP BY scene_id, px_col, px_row)"
SOURCE = Grid(0.0, 0.0, 20.0, 20.0, 50, 60)
TARGET = Grid(7.0, 3.0, 15.0, 15.0, 60, 40)


@query(with_views(f"""
SELECT scene_id, CAST(px_col // 4 AS BIGINT) AS px_col, CAST(px_row // 4 AS BIGINT) AS px_row, {rs('avg(red)', 6)} AS red, {rs('avg(nir)', 6)} AS nir
FROM obs GROUP BY scene_id, px_col // 4, px_row // 4""", "obs"))
def resample_average(t: Tables) -> DataFrame:
    means = gr.resample_average(t.view("obs"), 4, ["scene_id"], ["red", "nir"])
    return means.withColumns({"red": r("red", 6), "nir": r("nir", 6)})


_TARGETS = """, t AS (SELECT CAST(c AS INT) AS c, CAST(q AS INT) AS q, 7.0E0 + (c + 0.5E0) * 15.0E0 AS x, 3.0E0 + (q + 0.5E0) * 15.0E0 AS y
  FROM range(0, 60) AS a(c) CROSS JOIN range(0, 40) AS b(q))"""


@query(with_views(_RASTER + _TARGETS + """
SELECT s.scene_id, t.c AS px_col, t.q AS px_row, s.v FROM s JOIN t ON s.px_col = floor(t.x / 20.0E0) AND s.px_row = floor(t.y / 20.0E0)""", "obs"))
def resample_nearest(t: Tables) -> DataFrame:
    return gr.resample_nearest(raster(t), SOURCE, TARGET, ["scene_id"], ["v"])


_BILINEAR = """, n AS (SELECT s.scene_id, t.c, t.q, s.v, (1.0E0 - abs(t.x - (s.px_col + 0.5E0) * 20.0E0) / 20.0E0) * (1.0E0 - abs(t.y - (s.px_row + 0.5E0) * 20.0E0) / 20.0E0) AS w
  FROM s JOIN t ON abs(t.x - (s.px_col + 0.5E0) * 20.0E0) < 20.0E0 AND abs(t.y - (s.px_row + 0.5E0) * 20.0E0) < 20.0E0)
"""


@query(with_views(_RASTER + _TARGETS + _BILINEAR + f"""
SELECT scene_id, c AS px_col, q AS px_row, {rs('sum(v * w) / sum(w)', 6)} AS v FROM n GROUP BY scene_id, c, q""", "obs"))
def resample_bilinear(t: Tables) -> DataFrame:
    return gr.resample_bilinear(raster(t), SOURCE, TARGET, ["scene_id"], ["v"]).withColumn("v", r("v", 6))


@query(with_views(_RASTER.replace(" FROM obs GROUP", " FROM obs GROUP") + _TARGETS.replace("FROM range(0, 60)", "FROM range(0, 60)") + """
, n AS (SELECT s.scene_id, t.c, t.q, s.v, (1.0E0 - abs(t.x - (s.px_col + 0.5E0) * 20.0E0) / 20.0E0) * (1.0E0 - abs(t.y - (s.px_row + 0.5E0) * 20.0E0) / 20.0E0) AS w
  FROM s JOIN t ON abs(t.x - (s.px_col + 0.5E0) * 20.0E0) < 20.0E0 AND abs(t.y - (s.px_row + 0.5E0) * 20.0E0) < 20.0E0 WHERE s.scene_id % 2 = 1)
""" + f"SELECT scene_id, c AS px_col, q AS px_row, {rs('sum(v * w) / sum(w)', 6)} AS v FROM n GROUP BY scene_id, c, q "
    + f"UNION ALL SELECT scene_id, CAST(px_col AS INT), CAST(px_row AS INT), {rs('v', 6)} FROM s WHERE scene_id % 2 = 0 AND px_col < 60 AND px_row < 40", "obs"))
def align_to_reference(t: Tables) -> DataFrame:
    odd = F.col("scene_id") % 2 == 1
    frame = {c: F.when(odd, F.lit(float(getattr(SOURCE, c)))).otherwise(F.lit(float(getattr(TARGET, c)))) for c in ("x0", "y0", "dx", "dy")}
    aligned = gr.align_to_reference(raster(t).withColumns(frame), TARGET, ["scene_id"], ["v"])
    return aligned.withColumn("v", r("v", 6))


# ------------------------------------------------------------------- projection

def _utm_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """Another derivation for the check: Redfearn's power series of the transverse Mercator projection."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = f"radians({lat})", f"radians({lon} - ({zone * 6 - 183}))"
    n = f"({a!r} / sqrt(1.0E0 - {e2!r} * sin({phi}) * sin({phi})))"
    t, c, al = f"(tan({phi}) * tan({phi}))", f"({ep2!r} * cos({phi}) * cos({phi}))", f"({lam} * cos({phi}))"
    m = (f"{a!r} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * {phi} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * {phi}) "
         f"+ {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * {phi}) - {35 * e2**3 / 3072!r} * sin(6 * {phi}))")
    x = (f"500000.0E0 + {k0} * {n} * ({al} + (1 - {t} + {c}) * pow({al}, 3) / 6.0E0 + "
         f"(5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {ep2!r}) * pow({al}, 5) / 120.0E0)")
    y = (f"{k0} * ({m} + {n} * tan({phi}) * (pow({al}, 2) / 2.0E0 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({al}, 4) / 24.0E0 "
         f"+ (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {ep2!r}) * pow({al}, 6) / 720.0E0))")
    return x, y


_UX, _UY = _utm_sql("lon", "lat", 16)


@query(with_views(f"""
WITH p AS (SELECT scene_id, west AS lon, south AS lat FROM scenes)
SELECT scene_id, {rs(_UX, 1)} AS x, {rs(_UY, 1)} AS y FROM p""", "scenes"))
def project_points(t: Tables) -> DataFrame:
    points = t.view("scenes").select("scene_id", F.col("west").alias("lon"), F.col("south").alias("lat"), F.lit(32616).alias("epsg"))
    return gr.project_points(points).select("scene_id", r("x", 1).alias("x"), r("y", 1).alias("y"))


def _krueger_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """The projection by its own series, which holds far from the middle of the zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * k0
    e = 2 * n**0.5 / (1 + n)
    lam = f"radians({lon} - ({zone * 6 - 183}))"
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1.0E0 + {t} * {t}))"
    terms = [(n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 2), (13 * n**2 / 48 - 3 * n**3 / 5, 4), (61 * n**3 / 240, 6)]
    x = " + ".join([eta, *[f"{c!r} * cos({m} * {xi}) * sinh({m} * {eta})" for c, m in terms]])
    y = " + ".join([xi, *[f"{c!r} * sin({m} * {xi}) * cosh({m} * {eta})" for c, m in terms]])
    return f"(500000.0E0 + {radius!r} * ({x}))", f"({radius!r} * ({y}))"


_BX, _BY = _krueger_sql("lon", "lat", 16)


@query(with_views(_BOXES + f"""
, f AS (SELECT scene_id, west, south, east - west AS w, north - south AS h, CAST(i AS DOUBLE) / 8 AS f FROM b CROSS JOIN range(0, 9) AS k(i)),
p AS (SELECT scene_id, west + f * w AS lon, south AS lat FROM f UNION ALL SELECT scene_id, west + f * w, south + h FROM f
  UNION ALL SELECT scene_id, west, south + f * h FROM f UNION ALL SELECT scene_id, west + w, south + f * h FROM f),
q AS (SELECT scene_id, CASE WHEN scene_id % 3 <> 0 THEN {_BX} END AS x, CASE WHEN scene_id % 3 <> 0 THEN {_BY} END AS y FROM p)
SELECT scene_id, {rs('min(x)', 3)} AS x_min, {rs('min(y)', 3)} AS y_min, {rs('max(x)', 3)} AS x_max, {rs('max(y)', 3)} AS y_max FROM q GROUP BY scene_id""", "scenes"))
def project_bbox(t: Tables) -> DataFrame:
    b = boxes(t).withColumn("epsg", F.when(F.col("scene_id") % 3 == 0, F.lit(0)).otherwise(F.lit(32616)))
    return gr.project_bbox(b).select("scene_id", *[r(c, 3).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


