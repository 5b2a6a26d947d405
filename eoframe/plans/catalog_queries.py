"""Queries over the scene catalogue, bands and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import text as tx
from eoframe.operators import catalog as ca
from eoframe.plans.registry import query
from eoframe.plans.views import Tables, with_views

BOX = (-84.1, 9.9, -84.0, 10.0)


def grid_column():
    none = F.lit(None).cast("string")
    return tx.grid_id(F.col("family"), none, F.col("wrs_path"), F.col("wrs_row"), none, none, none, none,
                      F.concat(F.lit("G"), F.col("wrs_path").cast("string")))


GRID_SQL = ("CASE WHEN family = 'ls' THEN concat('P', lpad(CAST(wrs_path AS STRING), 3, '0'), 'R', lpad(CAST(wrs_row AS STRING), 3, '0')) "
            "ELSE concat('G', CAST(wrs_path AS STRING)) END")
PREFIX_SQL = ("CASE platform WHEN 'landsat-5' THEN 'Lands5' WHEN 'landsat-7' THEN 'Lands7' WHEN 'landsat-8' THEN 'Lands8' "
              "WHEN 'Sentinel-2A' THEN 'Sent2A' ELSE 'Sent2' END")


def scenes(t: Tables) -> DataFrame:
    return t.view("scenes").withColumn("grid", grid_column())


_FOUND = """
WITH f AS (SELECT scene_id, acquired, cloud_pct FROM scenes WHERE collection = 'sentinel-2-l2a'
  AND west <= -84.0E0 AND east >= -84.1E0 AND south <= 10.0E0 AND north >= 9.9E0
  AND acquired >= DATE '2019-01-01' AND acquired < DATE '2024-01-01' AND cloud_pct < 70)
"""


@query(with_views(_FOUND + "SELECT * FROM f", "scenes"))
def search_scenes(t: Tables) -> DataFrame:
    found = ca.search_scenes(scenes(t), "sentinel-2-l2a", BOX, "2019-01-01", "2023-12-31", 70.0)
    return found.select("scene_id", "acquired", "cloud_pct")


@query(with_views(_FOUND + "SELECT * FROM f ORDER BY acquired DESC, scene_id LIMIT 20", "scenes"))
def search_scenes_newest(t: Tables) -> DataFrame:
    found = ca.search_scenes(scenes(t), "sentinel-2-l2a", BOX, "2019-01-01", "2023-12-31", 70.0, limit=20)
    return found.select("scene_id", "acquired", "cloud_pct")


@query(with_views("SELECT scene_id, aoi_cloud_pct FROM scenes WHERE aoi_cloud_pct IS NULL OR aoi_cloud_pct <= 30", "scenes"))
def filter_aoi_cloud(t: Tables) -> DataFrame:
    return ca.filter_aoi_cloud(scenes(t), 30.0).select("scene_id", "aoi_cloud_pct")


_TOP = """
WITH r AS (SELECT scene_id, acquired, substr(CAST(acquired AS STRING), 1, {n}) AS period,
  row_number() OVER (PARTITION BY substr(CAST(acquired AS STRING), 1, {n})
    ORDER BY coalesce(cloud_pct, 100), acquired, scene_id) AS rank FROM scenes)
SELECT scene_id, acquired, period, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""


@query(with_views(_TOP.format(n=7), "scenes"))
def top_per_period(t: Tables) -> DataFrame:
    return ca.top_per_period(scenes(t), "mensual", 3).select("scene_id", "acquired", "period", "rank")


@query(with_views(_TOP.format(n=4), "scenes"))
def top_per_year(t: Tables) -> DataFrame:
    return ca.top_per_period(scenes(t), "anual", 3).select("scene_id", "acquired", "period", "rank")


_BEST = """
WITH r AS (SELECT scene_id, acquired, aoi_cloud_pct, substr(CAST(acquired AS STRING), 1, 7) AS period,
  row_number() OVER (PARTITION BY substr(CAST(acquired AS STRING), 1, 7)
    ORDER BY coalesce(aoi_cloud_pct, 999), acquired, scene_id) AS rank FROM scenes),
b AS (SELECT scene_id, acquired, aoi_cloud_pct, period FROM r WHERE rank = 1)
"""


@query(with_views(_BEST + "SELECT * FROM b", "scenes"))
def best_per_period(t: Tables) -> DataFrame:
    return ca.best_per_period(scenes(t), "mensual").select("scene_id", "acquired", "aoi_cloud_pct", "period")


@query(with_views(_TOP.format(n=7).replace("SELECT scene_id, acquired, period, CAST(rank", "SELECT scene_id, period, CAST(rank")
                  + " AND period IN (SELECT DISTINCT period FROM r ORDER BY period DESC LIMIT 20)", "scenes"))
def latest_periods(t: Tables) -> DataFrame:
    top = ca.top_per_period(scenes(t), "mensual", 3)
    return ca.latest_periods(top, 20).select("scene_id", "period", "rank")


@query(with_views("""
WITH e AS (SELECT concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0')) AS period
  FROM range(2017, 2026) AS a(y) CROSS JOIN range(1, 13) AS b(m))
SELECT period FROM e WHERE period BETWEEN '2016-03' AND '2025-06'
  AND period NOT IN (SELECT substr(CAST(acquired AS STRING), 1, 7) FROM scenes WHERE aoi_cloud_pct <= 2)""", "scenes"))
def empty_periods(t: Tables) -> DataFrame:
    return ca.empty_periods(scenes(t).where("aoi_cloud_pct <= 2"), "2016-03-01", "2025-06-30", "mensual")


@query(with_views("""
SELECT min(acquired) AS first, max(acquired) AS last, count(*) AS n,
  year(min(acquired)) = year(max(acquired)) AS one_year_only FROM scenes""", "scenes"))
def retrieved_range(t: Tables) -> DataFrame:
    return ca.retrieved_range(scenes(t), "2018-01-01", "2024-12-31")


@query(with_views(f"""
WITH g AS (SELECT substr(CAST(acquired AS STRING), 1, 7) AS year_month, {GRID_SQL} AS grid, acquired FROM scenes),
d AS (SELECT year_month, grid, acquired, count(*) AS n_on_date FROM g GROUP BY year_month, grid, acquired),
w AS (SELECT *, CAST(sum(n_on_date) OVER (PARTITION BY year_month, grid) AS BIGINT) AS n_scenes FROM d)
SELECT * FROM w WHERE n_scenes > 1""", "scenes"))
def name_collisions(t: Tables) -> DataFrame:
    return ca.name_collisions(scenes(t))


@query(with_views(f"""
WITH b AS (SELECT scene_id, acquired, concat({PREFIX_SQL}, '_', replace(substr(CAST(acquired AS STRING), 1, 7), '-', '_'), '_',
    {GRID_SQL}, '_NDVI') AS base, substr(CAST(acquired AS STRING), 9, 2) AS dd FROM scenes),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY acquired, scene_id) AS rn FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY base, dd ORDER BY acquired, scene_id)
    - CASE WHEN dd = min(dd) OVER (PARTITION BY base) THEN 1 ELSE 0 END AS nth FROM n)
SELECT scene_id, CASE WHEN rn = 1 THEN concat(base, '.tif') WHEN nth = 1 THEN concat(base, '_d', dd, '.tif')
  ELSE concat(base, '_d', dd, '_', CAST(nth AS STRING), '.tif') END AS file_name FROM m""", "scenes"))
def output_names(t: Tables) -> DataFrame:
    return ca.output_names(scenes(t), "NDVI").select("scene_id", "file_name")


@query(with_views("""
SELECT scene_id, aoi_cloud_pct, CASE WHEN aoi_cloud_pct <= 10 THEN 'green' WHEN aoi_cloud_pct <= 30 THEN 'amber' ELSE 'red' END AS cloud_band
FROM scenes""", "scenes"))
def contact_sheet_order(t: Tables) -> DataFrame:
    return ca.contact_sheet_order(scenes(t)).select("scene_id", "aoi_cloud_pct", "cloud_band")


@query(with_views("SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM scenes", "scenes"))
def aoi_bbox(t: Tables) -> DataFrame:
    return ca.aoi_bbox(scenes(t))


@query("""SELECT c_custkey, greatest(abs(c_acctbal / 500.0E0), abs(c_acctbal / 900.0E0 - 1.0E0)) > 10.0E0 AS suspicious FROM customer""")
def suspicious_extent(t: Tables) -> DataFrame:
    bal = F.col("c_acctbal")
    odd = ca.suspicious_extent(F.lit(0.0), F.lit(1.0), bal / 500.0, bal / 900.0)
    return t.table("customer").select("c_custkey", odd.alias("suspicious"))


@query(with_views(f"SELECT scene_id, {GRID_SQL} AS grid FROM scenes", "scenes"))
def grid_id(t: Tables) -> DataFrame:
    return scenes(t).select("scene_id", "grid")


@query(with_views(f"SELECT scene_id, platform, {PREFIX_SQL} AS prefix FROM scenes", "scenes"))
def platform_prefix(t: Tables) -> DataFrame:
    return scenes(t).select("scene_id", "platform", tx.platform_prefix(F.col("platform"), F.col("family")).alias("prefix"))


@query(with_views("""
SELECT scene_id, acquired FROM scenes WHERE aoi_cloud_pct <= 50
UNION ALL SELECT scene_id, acquired FROM scenes WHERE NOT coalesce(aoi_cloud_pct <= 50, false) AND cloud_pct <= 60""", "scenes"))
def collect_new(t: Tables) -> DataFrame:
    s = scenes(t).select("scene_id", "acquired", "cloud_pct", "aoi_cloud_pct")
    done = s.where("aoi_cloud_pct <= 50")
    return ca.collect_new(done, s.where("cloud_pct <= 60"), ["scene_id"]).select("scene_id", "acquired")


# ------------------------------------------------------------- bands and assets

# asset maps out of the scene catalogue: aliases vary, some links are empty, some signed
_S2_ASSETS = ("visual", "blue", "B04", "nir", "B8A", "B11", "swir22", "scl")
_LS_ASSETS = ("blue", "green", "red", "nir08", "swir16", "qa_pixel")


def _links(names, every: int):
    pairs = []
    for i, n in enumerate(names):
        empty = (F.col("scene_id") + i) % every == 0
        signed = F.when((F.col("scene_id") + i) % 4 == 1, F.lit("?sig=abc")).otherwise(F.lit(""))
        url = F.concat(F.lit(f"https://x/{n}/"), F.col("scene_id").cast("string"), F.lit(".tif"), signed)
        pairs += [F.lit(n), F.when(empty, F.lit("")).otherwise(url)]
    return F.create_map(*pairs)


def with_assets(t: Tables) -> DataFrame:
    return scenes(t).withColumn(
        "assets", F.when(F.col("family") == "ls", _links(_LS_ASSETS, 5)).otherwise(_links(_S2_ASSETS, 7)))


def _link_sql(names, name: str, every: int) -> str:
    i = names.index(name)
    return (f"CASE WHEN (scene_id + {i}) % {every} = 0 THEN NULL ELSE concat('https://x/{name}/', CAST(scene_id AS STRING), '.tif', "
            f"CASE WHEN (scene_id + {i}) % 4 = 1 THEN '?sig=abc' ELSE '' END) END")


def _asset_sql(band: str) -> str:
    s2 = [a for a in ca.band_aliases(band, "s2") if a in _S2_ASSETS]
    ls = [a for a in ca.band_aliases(band, "ls") if a in _LS_ASSETS]
    one = lambda names, found, every: f"coalesce({', '.join([_link_sql(names, a, every) for a in found] + ['CAST(NULL AS STRING)'])})"
    return f"CASE WHEN family = 'ls' THEN {one(_LS_ASSETS, ls, 5)} ELSE {one(_S2_ASSETS, s2, 7)} END"


_ASKED = ("visual", "red", "nir", "nir08", "rededge1", "scl", "swir16", "visual-10m")


@query(with_views("SELECT scene_id, family, " + ", ".join(f"{_asset_sql(b)} AS \"{b}\"" for b in _ASKED) + " FROM scenes", "scenes"))
def resolve_asset(t: Tables) -> DataFrame:
    links = {b: ca.resolve_asset(F.col("assets"), b, F.col("family")) for b in _ASKED}
    return with_assets(t).select("scene_id", "family", *[v.alias(b) for b, v in links.items()])


def _packed_sql() -> str:
    def pack(family: str) -> str:
        parts, seen = [], set()
        names = _LS_ASSETS if family == "ls" else _S2_ASSETS
        for k in dims.BAND_KEYS:
            aliases = ca.band_aliases(k, family)
            if not aliases or aliases[0] in seen or not [a for a in aliases if a in names]:
                continue
            seen.add(aliases[0])
            url = f"split_part({_asset_sql(k)}, '?', 1)"
            parts.append(f"CASE WHEN {_asset_sql(k)} IS NULL THEN NULL ELSE concat('\"{aliases[0]}\":\"', {url}, '\"') END")
        return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"

    return f"CASE WHEN family = 'ls' THEN {pack('ls')} ELSE {pack('s2')} END"


@query(with_views(f"SELECT scene_id, {_packed_sql()} AS assets FROM scenes", "scenes"))
def pack_assets(t: Tables) -> DataFrame:
    return with_assets(t).select("scene_id", ca.pack_assets(F.col("assets"), F.col("family")).alias("assets"))


def as_footprint_input(t: Tables) -> DataFrame:
    even = F.col("scene_id") % 2 == 0
    return with_assets(t).withColumns({
        "datetime": F.concat(F.col("acquired").cast("string"), F.lit("T10:11:12Z")),
        "data_pct": F.when(F.col("aoi_cloud_pct").isNotNull(), F.lit(100.0)),
        "proj_epsg": F.when(even, F.lit(32616)),
        "proj_code": F.when(F.col("scene_id") % 3 == 0, F.lit("EPSG:32617")),
        "thumb": F.when(even, F.lit("/tmp/a.png")),
        "catalog": F.lit("https://c/v1/"),
    })


@query(with_views(f"""
SELECT CAST(scene_id AS STRING) AS id, CAST(acquired AS STRING) AS fecha, '10:11:12' AS hora_utc,
  coalesce(cloud_pct, 0.0E0) AS nubes_pct, coalesce(aoi_cloud_pct, -1.0E0) AS nubes_aoi,
  CASE WHEN aoi_cloud_pct IS NULL THEN -1.0E0 ELSE 100.0E0 END AS datos_pct, platform AS plataforma, {GRID_SQL} AS tile,
  CAST(CASE WHEN scene_id % 2 = 0 THEN 32616 WHEN scene_id % 3 = 0 THEN 32617 ELSE 0 END AS INT) AS epsg,
  CASE WHEN scene_id % 2 = 0 THEN '/tmp/a.png' ELSE '' END AS thumb,
  CASE WHEN scene_id % 2 = 0 THEN 'file:///tmp/a.png' ELSE '' END AS thumb_url,
  coalesce({_asset_sql('visual')}, '') AS url_visual, {_packed_sql()} AS assets, collection AS coleccion, 'https://c/v1/' AS catalogo
FROM scenes""", "scenes"))
def to_footprints(t: Tables) -> DataFrame:
    return ca.to_footprints(as_footprint_input(t))


def damaged_footprints(t: Tables) -> DataFrame:
    k = F.col("id").cast("bigint")
    return ca.to_footprints(as_footprint_input(t)).withColumns({
        "assets": F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit('{"half": [')).when(k % 17 == 0, F.lit("{}")).otherwise(F.col("assets")),
        "hora_utc": F.when(k % 5 == 0, F.lit("")).otherwise(F.col("hora_utc")),
    })


_DAMAGED = "(scene_id % 11 = 0 OR scene_id % 13 = 0 OR scene_id % 17 = 0)"


@query(with_views(f"""
SELECT CAST(scene_id AS STRING) AS scene_id, concat(CAST(acquired AS STRING), 'T',
    CASE WHEN scene_id % 5 = 0 THEN '00:00:00' ELSE '10:11:12' END, 'Z') AS datetime, coalesce(cloud_pct, 0.0E0) AS cloud_pct,
  {GRID_SQL} AS grid, split_part({_asset_sql('blue')}, '?', 1) AS blue_link
FROM scenes WHERE NOT {_DAMAGED}""", "scenes"))
def scenes_from_footprints(t: Tables) -> DataFrame:
    good, _ = ca.scenes_from_footprints(damaged_footprints(t))
    return good.select("scene_id", "datetime", "cloud_pct", "grid", F.try_element_at("assets", F.lit("blue")).alias("blue_link"))


@query(with_views(f"SELECT CAST(scene_id AS STRING) AS id, CAST(acquired AS STRING) AS fecha FROM scenes WHERE {_DAMAGED}", "scenes"))
def rejected_footprints(t: Tables) -> DataFrame:
    _, bad = ca.scenes_from_footprints(damaged_footprints(t))
    return bad.select("id", "fecha")


@query(with_views("""
SELECT count(*) AS n, count(CASE WHEN scene_id % 50 = 0 THEN 1 END) AS other_catalog,
  count(CASE WHEN collection <> 'sentinel-2-l2a' THEN 1 END) AS other_collection,
  CASE WHEN count(CASE WHEN scene_id % 50 = 0 THEN 1 END) > 0 THEN 'catalog' ELSE 'collection' END AS verdict FROM scenes""", "scenes"))
def check_footprint_provenance(t: Tables) -> DataFrame:
    rows = scenes(t).select(
        F.when(F.col("scene_id") % 50 == 0, F.lit("https://other/")).otherwise(F.lit("https://c/v1/ ")).alias("catalogo"),
        F.col("collection").alias("coleccion"))
    return ca.check_footprint_provenance(rows, "https://c/v1", "sentinel-2-l2a")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS scale,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 0.0E0 ELSE -l_tax + 0.0E0 END AS "offset" FROM lineitem""")
def scale_offset(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    scale = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"scale":'), F.col("l_discount").cast("string")))
    offset = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"offset":'), (-F.col("l_tax") + 0.0).cast("string")))
    text = F.concat(F.lit("[{"), F.concat_ws(",", F.nullif(scale, F.lit("")), F.nullif(offset, F.lit(""))), F.lit("}]"))
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", ca.scale_offset(text).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "s.scale", "s.offset")


def band_requests(t: Tables) -> DataFrame:
    """Bands asked for per order: every line item names one of the twelve (or an unknown one)."""
    keys = F.array(*[F.lit(k) for k in (*dims.BAND_KEYS, "thermal")])
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("request"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("ls")).otherwise(F.lit("s2")).alias("family"),
        F.element_at(keys, ((F.col("l_partkey") + F.col("l_linenumber")) % 13 + 1).cast("int")).alias("band"))


_BAND_DIM = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{k}' AS band, '{s2[0]}' AS s2_alias, {('NULL' if not ls else repr(ls[0]))} AS ls_alias, '{n2}' AS s2_band, {float(r2)}E0 AS s2_res, "
    f"{repr(label + f' — S2 {n2} {r2} m · ' + (f'Landsat {ls[0]} {rl} m' if ls else 'Landsat no'))} AS label"
    for i, (k, label, s2, n2, r2, ls, rl) in enumerate(dims.BANDS))
_REQUESTS = f"""WITH dim AS ({_BAND_DIM}), q AS (SELECT l_orderkey AS request, CASE WHEN l_orderkey % 2 = 0 THEN 'ls' ELSE 's2' END AS family,
  coalesce(dim.band, 'thermal') AS band, s2_alias, ls_alias, s2_band, s2_res, label
  FROM lineitem LEFT JOIN dim ON (l_partkey + l_linenumber) % 13 = pos)
"""


@query(_REQUESTS + """
SELECT request, band, family, coalesce(label, band) AS label,
  CASE WHEN family = 'ls' THEN CASE WHEN ls_alias IS NULL THEN 'X' WHEN ls_alias = 'qa_pixel' THEN 'QA' ELSE upper(ls_alias) END
    ELSE coalesce(s2_band, 'X') END AS suffix,
  CASE WHEN family = 'ls' THEN 30.0E0 ELSE coalesce(s2_res, 10.0E0) END AS res FROM q""")
def band_dimension(t: Tables) -> DataFrame:
    k, f = F.col("band"), F.col("family")
    return band_requests(t).select("request", "band", "family", ca.band_label(k).alias("label"),
                                   ca.band_suffix(k, f).alias("suffix"), ca.native_res(k, f).alias("res"))


@query(_REQUESTS + """, a AS (SELECT DISTINCT request, band, CASE WHEN family = 'ls' THEN ls_alias ELSE coalesce(s2_alias, band) END AS asset FROM q)
SELECT request, asset, string_agg(band, ',' ORDER BY band) AS bands, count(*) AS n_bands FROM a WHERE asset IS NOT NULL
GROUP BY request, asset HAVING count(*) > 1""")
def duplicate_bands(t: Tables) -> DataFrame:
    return ca.duplicate_bands(band_requests(t), ["request"])


_COMPOSITE_DIM = " UNION ALL ".join(f"SELECT '{n}' AS composite, '{b[0]}' AS b0, '{b[1]}' AS b1, '{b[2]}' AS b2" for n, b in dims.COMPOSITES)


@query(f"""WITH c AS ({_COMPOSITE_DIM}), o AS (SELECT o_orderkey AS request, CASE o_custkey % 3 WHEN 0 THEN 'nir08' WHEN 1 THEN 'green' ELSE 'rededge1' END AS x,
  CASE WHEN o_custkey % 2 = 0 THEN 'swir22' ELSE 'rededge2' END AS y FROM orders)
SELECT request, composite, concat_ws(',', CASE WHEN b0 IN (x, y) THEN b0 END, CASE WHEN b1 IN (x, y) THEN b1 END, CASE WHEN b2 IN (x, y) THEN b2 END) AS lacking,
  NOT (b0 IN (x, y) OR b1 IN (x, y) OR b2 IN (x, y)) AS available FROM o CROSS JOIN c""")
def vetoed_composites(t: Tables) -> DataFrame:
    x = F.element_at(F.array(F.lit("nir08"), F.lit("green"), F.lit("rededge1")), (F.col("o_custkey") % 3 + 1).cast("int"))
    y = F.when(F.col("o_custkey") % 2 == 0, F.lit("swir22")).otherwise(F.lit("rededge2"))
    asked = t.table("orders").select(F.col("o_orderkey").alias("request"), F.array(x, y).alias("absent"))
    return ca.vetoed_composites(asked, ["request"])


# ------------------------------------------------------------------ set operations

_SEASON_DATES = "CASE WHEN month(acquired) IN (12, 1, 2, 3, 4) THEN 'dry' ELSE 'wet' END"


@query(with_views("SELECT DISTINCT acquired FROM scenes", "scenes"))
def season_date_union(t: Tables) -> DataFrame:
    s = scenes(t)
    dry = F.month("acquired").isin(*dims.DRY_MONTHS)
    return s.where(dry).select("acquired").union(s.where(~dry).select("acquired")).distinct()


def months_of(t: Tables, condition: str) -> DataFrame:
    return scenes(t).where(condition).select("grid", F.month("acquired").alias("month")).distinct()


_MONTHS = f"SELECT {GRID_SQL} AS grid, CAST(month(acquired) AS INT) AS month FROM scenes"


@query(with_views(f"{_MONTHS} EXCEPT {_MONTHS} WHERE aoi_cloud_pct <= 5", "scenes"))
def month_difference(t: Tables) -> DataFrame:
    return months_of(t, "true").subtract(months_of(t, "aoi_cloud_pct <= 5"))


@query(with_views(f"{_MONTHS} WHERE aoi_cloud_pct <= 20 INTERSECT {_MONTHS} WHERE cloud_pct <= 20", "scenes"))
def month_overlap(t: Tables) -> DataFrame:
    return months_of(t, "aoi_cloud_pct <= 20").intersect(months_of(t, "cloud_pct <= 20"))


# ----------------------------------------------------------------------- names

@query(with_views("""
SELECT scene_id, 'Indice NDVI' AS producto, CASE WHEN family = 'ls' THEN 'Landsat' ELSE 'Sentinel-2' END AS sensor,
  CASE WHEN family = 'ls' THEN 'Collection 2 Level-2 — reflectancia de superficie' ELSE 'L2A — reflectancia de superficie' END AS nivel,
  CAST(acquired AS STRING) AS fecha, CASE WHEN cloud_pct IS NULL THEN false ELSE true END AS has_cloud,
  CASE WHEN cloud_pct IS NULL THEN 7 ELSE 8 END AS n_keys FROM scenes""", "scenes"))
def provenance(t: Tables) -> DataFrame:
    extra = F.create_map(F.lit("fecha_adquisicion"), F.col("acquired").cast("string"), F.lit("nube"), F.col("cloud_pct").cast("string"))
    p = tx.provenance(F.lit("Indice NDVI"), F.col("family"), F.col("collection"), extra, radiometry=F.lit(" "))
    get = lambda k: F.try_element_at("p", F.lit(k))
    return scenes(t).select("scene_id", p.alias("p")).select(
        "scene_id", get("PRODUCTO").alias("producto"), get("SENSOR").alias("sensor"), get("NIVEL_PROCESAMIENTO").alias("nivel"),
        get("FECHA_ADQUISICION").alias("fecha"), get("NUBE").isNotNull().alias("has_cloud"), F.size("p").alias("n_keys"))
