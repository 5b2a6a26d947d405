"""Queries over months, dates, links, documents, report tables, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import text as tx
from eoframe.operators import catalog as ca
from eoframe.operators import report as rp
from eoframe.plans.optical_queries import indices
from eoframe.plans.registry import query
from eoframe.plans.views import Tables, with_views
from eoframe.session import ensure_checkpoint_dir
from eoframe.sources import manifest as mf
from eoframe.sources import stac
from eoframe.streaming import intake

# ---------------------------------------------------------------------- months

_MONTH_TEXT = ("concat(CAST(l_linenumber AS STRING), ', ', CAST(l_suppkey % 14 AS STRING), ';', "
               "CASE WHEN l_partkey % 7 = 0 THEN 'x' WHEN l_partkey % 7 = 1 THEN '' ELSE CAST(l_partkey % 12 + 1 AS STRING) END)")


def month_texts(t: Tables) -> DataFrame:
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.expr(_MONTH_TEXT).alias("text"))


def _joined(c):
    return F.array_join(F.transform(c, lambda m: m.cast("string")), ",")


_TOKENS = "WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey % 14 AS b, l_partkey % 7 AS k, l_partkey % 12 + 1 AS c FROM lineitem) "


@query(_TOKENS + """
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 OR b NOT BETWEEN 1 AND 12 THEN ''
  WHEN k = 1 THEN concat(CAST(l_linenumber AS STRING), ',', CAST(b AS STRING))
  ELSE concat(CAST(l_linenumber AS STRING), ',', CAST(b AS STRING), ',', CAST(c AS STRING)) END AS months FROM s""")
def parse_months(t: Tables) -> DataFrame:
    return month_texts(t).select("l_orderkey", "l_linenumber", _joined(tx.parse_months(F.col("text"))).alias("months"))


@query(_TOKENS + """
SELECT l_orderkey, l_linenumber, concat_ws(',', CAST(l_linenumber AS STRING), CASE WHEN b BETWEEN 1 AND 12 AND b <> l_linenumber THEN CAST(b AS STRING) END,
  CASE WHEN k > 1 AND c <> l_linenumber AND c <> b THEN CAST(c AS STRING) END) AS months FROM s""")
def parse_months_lenient(t: Tables) -> DataFrame:
    return month_texts(t).select("l_orderkey", "l_linenumber", _joined(tx.parse_months_lenient(F.col("text"), dims.DRY_MONTHS)).alias("months"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 <> 0 AND value > user_id / 2.0E0 THEN user_id / 2.0E0 END AS lo,
  CASE WHEN event_id % 9 <> 0 AND value > user_id / 2.0E0 THEN value END AS hi FROM events""")
def parse_limits(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), (F.col("user_id") / 2.0).cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit(" ;")).otherwise(F.lit(", ")),
                    F.when(F.col("event_id") % 9 == 0, F.lit("abc")).otherwise(F.col("value").cast("string")))
    rows = t.table("events").select("event_id", tx.parse_limits(text).alias("l"))
    return rows.select("event_id", "l.lo", "l.hi")


@query("""
WITH m AS (SELECT DISTINCT o_custkey, CAST(month(o_orderdate) AS INT) AS m FROM orders),
c AS (SELECT o_custkey, count(*) AS n, string_agg(lpad(CAST(m AS STRING), 2, '0'), '.' ORDER BY m) AS listed,
  string_agg(lpad(CAST(m AS STRING), 2, '0'), '' ORDER BY m) AS radar FROM m GROUP BY o_custkey),
s AS (SELECT a.o_custkey, count(*) AS starts, min(a.m) AS first FROM m AS a LEFT JOIN m AS b ON a.o_custkey = b.o_custkey AND b.m = (a.m + 10) % 12 + 1
  WHERE b.m IS NULL GROUP BY a.o_custkey)
SELECT c.o_custkey, CASE WHEN n = 12 THEN '01-12' WHEN starts = 1 THEN concat(lpad(CAST(first AS STRING), 2, '0'), '-', lpad(CAST((first + n - 2) % 12 + 1 AS STRING), 2, '0'))
  ELSE listed END AS code, radar FROM c LEFT JOIN s ON c.o_custkey = s.o_custkey""")
def month_code(t: Tables) -> DataFrame:
    months = t.table("orders").select("o_custkey", F.month("o_orderdate").alias("m")).distinct().groupBy("o_custkey").agg(F.collect_list("m").alias("ms"))
    return months.select("o_custkey", tx.month_code(F.col("ms")).alias("code"), tx.month_code_radar(F.col("ms")).alias("radar"))


# ----------------------------------------------------------------------- dates

_ISO = """CASE event_id % 6 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10) WHEN 1 THEN substr(CAST(ts AS STRING), 1, 10)
  WHEN 2 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8))
  WHEN 3 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), 'Z') END"""


@query(f"SELECT event_id, {_ISO} AS iso FROM events")
def iso_timestamp(t: Tables) -> DataFrame:
    return t.view("raw_dates").select("event_id", tx.iso_timestamp(F.col("raw_date")).alias("iso"))


@query(f"SELECT count(*) AS n, count({_ISO}) AS n_usable, count(*) - count({_ISO}) AS n_unusable FROM events")
def timestamp_coverage(t: Tables) -> DataFrame:
    return rp.timestamp_coverage(t.view("raw_dates"), "raw_date")


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 2, 3) THEN CAST(ts AS DATE) END AS day FROM events")
def lenient_date(t: Tables) -> DataFrame:
    return t.view("raw_dates").select("event_id", tx.lenient_date(F.col("raw_date")).alias("day"))


@query("""
SELECT event_id, CASE WHEN event_id % 8 = 0 THEN '—' WHEN event_id % 8 = 1 THEN '2011-02-03'
  ELSE CAST(DATE '1970-01-01' + CAST(floor((event_id * 123456789 - 400000000000) / 86400000.0E0) AS INT) AS STRING) END AS day FROM events""")
def epoch_ms_date(t: Tables) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 8 == 0, F.lit("")).when(k % 8 == 1, F.lit("2011-02-03T10:00")).otherwise((k * 123456789 - 400000000000).cast("string"))
    return t.table("events").select("event_id", tx.epoch_ms_date(text).alias("day"))


# ----------------------------------------------------------------------- links

@query("""SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN concat(substr(url, 1, strpos(url, '?') - 1), '?<firma oculta>') ELSE url END AS shown FROM pages""")
def strip_signature(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", tx.strip_signature(F.col("url")).alias("shown"))


@query("""
WITH c AS (SELECT doc_id, list_filter(string_split(text, ''), lambda c: contains(' "<>\\^`{|}[]', c) OR unicode(c) > 126 OR unicode(c) < 32) AS l FROM documents)
SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda c, i: list_position(l, c) = i), ''), '') AS bad FROM c""")
def unsafe_href(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", tx.unsafe_href(F.col("text")).alias("bad"))


KML_SQL = with_views(r"""
WITH v AS (SELECT page_id, kml, list_sum(list_transform(regexp_extract_all(kml, '(?s)<coordinates[^>]*>(.*?)</coordinates>', 1),
    lambda b: len(regexp_extract_all(b, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')))) AS n FROM kml_docs)
SELECT page_id, CAST((length(kml) - length(replace(kml, '<Placemark', ''))) // 10 AS BIGINT) AS n_placemarks,
  CAST((length(kml) - length(replace(kml, '<GroundOverlay', ''))) // 14 AS BIGINT) AS n_overlays,
  CAST(coalesce(n, 0) AS BIGINT) AS n_vertices, false AS too_many_features, coalesce(n, 0) > 250000 AS too_many_vertices FROM v""", "kml_docs")


@query(KML_SQL)
def kml_audit(t: Tables) -> DataFrame:
    return rp.kml_audit(t.view("kml_docs")).drop("url", "kml")


@query("""
SELECT event_id, CASE WHEN value BETWEEN 5.0E0 AND 95.0E0 THEN CAST(least(6, greatest(1, ceil((value - 5.0E0) / 15.0E0))) AS INT) END AS class_no FROM events""")
def equal_interval_class(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", tx.equal_interval_class(F.col("value"), 5.0, 95.0, 6).alias("class_no"))


# ---------------------------------------------------------------------- tables

@query("""
SELECT concat('F', CAST(o_orderkey AS STRING), '.tif') AS file, o_orderpriority AS product, CAST(CAST(o_orderdate AS DATE) AS STRING) AS dates,
  CASE WHEN o_custkey % 5 = 0 THEN '—' ELSE 'Landsat' END AS sensor, CASE WHEN o_custkey % 7 = 0 THEN '—' ELSE 'SCL' END AS mask, '—' AS radiometry FROM orders""")
def product_inventory(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    rows = t.table("orders").select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("file"), F.col("o_orderpriority").alias("product"),
        F.to_date("o_orderdate").alias("dates"), F.when(c % 5 != 0, F.lit("Landsat")).alias("sensor"),
        F.when(c % 7 == 0, F.lit("")).otherwise(F.lit("SCL")).alias("mask"), F.lit(None).cast("string").alias("radiometry"))
    return rp.product_inventory(rows)


@query(with_views("""
WITH g(pos, index, measures, high, low, caution) AS (VALUES
  (0, 'NDVI', 'amount of green vegetation', 'dense, active green cover', 'little or no green vegetation', 'saturates over dense canopy, and does not tell how much cover there is from the state it is in'),
  (1, 'SAVI', 'green vegetation with bare-soil correction', 'much green cover', 'little vegetation', 'differs from NDVI only over visible soil; saturates like it'),
  (2, 'EVI2', 'vigour without saturation', 'much green biomass, also where NDVI no longer rises', 'little vegetation', 'runs from 0 to about 0.9 over vegetation; calibrated on MODIS with a red to blue ratio of 2.08'),
  (3, 'NDMI', 'water held by the canopy', 'moist canopy', 'dry canopy, or little of it', 'over sparse cover it reads soil moisture; a low value may be drought or missing vegetation'),
  (4, 'NBR', 'standing vegetation against char', 'standing vegetation', 'burnt surface or bare soil', 'one date does not measure severity; that takes the difference of two dates, with thresholds of its own'),
  (5, 'MSI', 'moisture stress', 'dry or stressed canopy', 'moist canopy', 'inverted: high is dry; no upper bound, and high over bare soil without any plant'),
  (6, 'NDRE', 'relative chlorophyll, red edge', 'more chlorophyll than the rest of the scene', 'less chlorophyll: senescence or deficiency', 'compare inside one scene only, it is no content of chlorophyll; Sentinel-2 alone has the band'),
  (7, 'CIre', 'relative chlorophyll as a ratio', 'more chlorophyll than the rest of the scene', 'less chlorophyll', 'compare inside one scene only; no upper bound, noisy over sparse cover; Sentinel-2 alone has the band'),
  (8, 'TCB', 'brightness', 'bare soil, sand, rock, built surface', 'water, dense canopy, shadow', 'coefficients belong to one sensor; two of the four sets were derived from top-of-atmosphere reflectance'),
  (9, 'TCG', 'greenness', 'vegetation', 'no vegetation', 'coefficients belong to one sensor'),
  (10, 'TCW', 'wetness', 'water in canopy and soil, shadow', 'dry', 'shadow reads as wetness; coefficients belong to one sensor')),
present AS (""" + " UNION ".join(f"SELECT index FROM idx_{n.lower()}" for n in dims.INDEX_NAMES) + """)
SELECT * FROM g WHERE index IN (SELECT index FROM present)""", *[f"idx_{n.lower()}" for n in dims.INDEX_NAMES]))
def guide_rows(t: Tables) -> DataFrame:
    rows = indices(t).withColumn("index", F.when(F.col("index") == "MSI", F.lit("AMPL_MSI")).otherwise(F.col("index")))
    return rp.guide_rows(rows)


# --------------------------------------------------------------------- sources

_ACQ = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 23 YEAR AS DATE)"


@query(f"""
SELECT CAST(o_orderkey AS STRING) AS scene_id, {_ACQ} AS acquired, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 10000.0E0 END AS cloud_pct,
  o_orderpriority AS platform, CAST(32616 AS INT) AS proj_epsg, -84.5E0 AS west, 10.5E0 AS north,
  concat('https://x/', CAST(o_orderkey AS STRING), '?s=1') AS red_link FROM orders""")
def read_scenes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    day = F.add_months(F.to_date("o_orderdate"), 276).cast("string")
    props = F.create_map(
        F.lit("datetime"), F.concat(day, F.lit("T10:00:00Z")), F.lit("platform"), F.col("o_orderpriority"), F.lit("proj:epsg"), F.lit("32616"),
        F.lit("eo:cloud_cover"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_totalprice") / 10000.0).cast("string")))
    item = F.struct(k.alias("id"), F.array(F.lit(-84.5), F.lit(9.5), F.lit(-84.0), F.lit(10.5)).alias("bbox"), props.alias("properties"),
                    F.create_map(F.lit("red"), F.struct(F.concat(F.lit("https://x/"), k, F.lit("?s=1")).alias("href"))).alias("assets"))
    page = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(item).alias("features")))
    scenes = stac.parse_scenes(t.table("orders").select(page.alias("page")))
    return scenes.select("scene_id", "acquired", "cloud_pct", "platform", "proj_epsg", "west", "north", F.col("assets")["red"].alias("red_link"))


def scene_files(t: Tables) -> str:
    """A folder of feature collections, a hundred suppliers' scenes to a file: boxes of four and six numbers, and none."""
    k = F.col("s_suppkey")
    lon, lat = (k * 7 % 300 - 150).cast("double"), (k * 11 % 120 - 60).cast("double")
    corner = lambda x, y: F.array(x, y)
    ring = lambda w, s, e, n: F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))
    date_line = F.array(F.array(ring(F.lit(179.0), lat, F.lit(180.0), lat + 1)), F.array(ring(F.lit(-180.0), lat, F.lit(-179.5), lat + 1)))
    one = F.to_json(F.array(ring(lon, lat, lon + 2, lat + 1)))
    geometry = (
        F.when(k % 4 == 2, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(date_line), F.lit("}")))
        .when(k % 8 == 5, F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":'), one, F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), one, F.lit("}")))
    )
    box = F.when(k % 4 == 0, F.array(lon, lat, lon + 2, lat + 1)).when(k % 4 == 3, F.array(lon, lat, F.lit(5.0), lon + 2, lat + 1, F.lit(90.0)))
    props = F.create_map(
        F.lit("datetime"), F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15T10:00:00Z")), F.lit("platform"), F.lit("sentinel-2b"),
        F.lit("eo:cloud_cover"), (k % 100).cast("string"), F.lit("s2:mgrs_tile"), F.concat(F.lit("T"), (k % 60).cast("string")), F.lit("proj:code"), F.lit("EPSG:32616"))
    rest = F.to_json(F.struct(
        k.cast("string").alias("id"), F.when(k % 5 == 0, F.lit("landsat-c2-l2")).otherwise(F.lit("sentinel-2-l2a")).alias("collection"), box.alias("bbox"),
        props.alias("properties"), F.create_map(F.lit("red"), F.struct(F.concat(F.lit("https://x/"), k.cast("string"), F.lit("?s=1")).alias("href"))).alias("assets")))
    item = F.concat(F.expr("substring(rest, 1, length(rest) - 1)"), F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))
    items = t.table("supplier").select(F.floor(k / 100).alias("page"), rest.alias("rest"), geometry.alias("geometry")).select("page", item.alias("item"))
    pages = items.groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))
    folder = scratch(t, "pages")
    pages.write.partitionBy("page").text(folder)
    return folder


_SCENE_FILES = """
WITH k AS (SELECT s_suppkey AS k, CAST(s_suppkey * 7 % 300 - 150 AS DOUBLE) AS lon, CAST(s_suppkey * 11 % 120 - 60 AS DOUBLE) AS lat FROM supplier),
s AS (SELECT k, CAST(k AS STRING) AS scene_id, CASE WHEN k % 5 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection,
  concat('2024-0', CAST(k % 9 + 1 AS STRING), '-15') AS day, CAST(k % 100 AS DOUBLE) AS cloud_pct, concat('T', CAST(k % 60 AS STRING)) AS grid,
  CASE WHEN k % 4 = 2 THEN 179.0E0 ELSE lon END AS west, lat AS south, CASE WHEN k % 4 = 2 THEN -179.5E0 ELSE lon + 2 END AS east, lat + 1 AS north FROM k)
"""


@query(_SCENE_FILES + """SELECT scene_id, CAST(day AS DATE) AS acquired, cloud_pct, grid, west, south, east, north, 's2' AS family FROM s
WHERE collection = 'sentinel-2-l2a' AND cloud_pct < 70 AND west <= 90 AND east >= -90 AND west <= east AND south <= 50 AND north >= -50
  AND day BETWEEN '2024-02-01' AND '2024-08-31'""")
def search_scene_files(t: Tables) -> DataFrame:
    """From catalogue files to a search; items without a box have the envelope of their geometry."""
    scenes = stac.read_scenes(t.spark, scene_files(t))
    found = ca.search_scenes(scenes, "sentinel-2-l2a", (-90, -50, 90, 50), "2024-02-01", "2024-08-31", 70.0)
    return found.select("scene_id", "acquired", "cloud_pct", "grid", "west", "south", "east", "north", "family")


@query(_SCENE_FILES + """SELECT scene_id, concat(day, 'T10:00:00Z') AS datetime, -1.0E0 AS aoi_cloud_pct, grid, CAST(32616 AS INT) AS proj_epsg,
  concat('https://x/', scene_id) AS red_link, 'https://c/v1/' AS catalog, west, east FROM s
WHERE collection = 'sentinel-2-l2a' AND cloud_pct < 70 AND (west > east OR west <= -149 OR east >= 149)""")
def footprint_round_trip(t: Tables) -> DataFrame:
    """Catalogue files to reviewed footprints and back, then a search across the date line and its links."""
    footprints = ca.to_footprints(stac.read_scenes(t.spark, scene_files(t), "https://c/v1/"), bounds=True)
    scenes, _ = ca.scenes_from_footprints(footprints)
    found = ca.search_scenes(scenes, "sentinel-2-l2a", (149, -90, -149, 90), "2024-01-01", "2024-12-31", 70.0)
    return found.select(
        "scene_id", "datetime", "aoi_cloud_pct", "grid", "proj_epsg", ca.resolve_asset(F.col("assets"), "red", F.col("family")).alias("red_link"), "catalog", "west", "east")


def manifests(t: Tables) -> DataFrame:
    """One manifest text per order; every job of it is a line item."""
    job = F.struct(F.col("l_linenumber").cast("string").alias("job_id"), F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("granule"),
                   F.col("l_returnflag").alias("status_code"))
    head = F.struct(F.concat(F.lit("rtc_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("nombre_lote"),
                    F.lit(2020).alias("anio"), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("meses_seca"),
                    F.array(job).alias("trabajos"))
    return t.table("lineitem").select(F.to_json(head).alias("manifest"))


@query("""
SELECT concat('rtc_', CAST(l_orderkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS batch_name, CAST(l_linenumber AS STRING) AS job_id,
  concat('G', CAST(l_partkey AS STRING)) AS granule, l_returnflag AS status_code FROM lineitem""")
def read_order_manifest_jobs(t: Tables) -> DataFrame:
    return mf.parse_manifests(manifests(t))[1].drop("expiration_time")


@query("""
SELECT concat('rtc_', CAST(l_orderkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS nombre_lote, CAST(2020 AS INT) AS anio,
  CASE WHEN l_suppkey % 2 = 0 THEN '1,2' ELSE '12,1,2,3,4' END AS dry, '5,6,7,8,9,10,11' AS wet FROM lineitem""")
def read_order_manifest(t: Tables) -> DataFrame:
    orders = mf.parse_manifests(manifests(t))[0]
    return orders.select("nombre_lote", "anio", F.array_join("meses_seca", ",").alias("dry"), F.array_join("meses_lluvia", ",").alias("wet"))


# --------------------------------------------------------------------- streams

def scratch(t: Tables, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"


def _stream(t: Tables, table: str) -> DataFrame:
    return (t.spark.readStream.schema(t.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir))


@query("SELECT o_custkey AS scene_id FROM orders GROUP BY o_custkey")
def stream_new_scenes(t: Tables) -> DataFrame:
    """Orders arrive as repeated announcements of a customer's scene; each scene is kept once."""
    folder = scratch(t, "scenes")
    arrivals = _stream(t, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderdate").alias("datetime"))
    intake.stream_new_scenes(arrivals, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("scene_id")


@query("""
WITH j AS (SELECT concat('rtc_', CAST(user_id AS STRING)) AS batch_name, CAST(user_id % 7 AS BIGINT) AS job_id, event_type AS status_code, ts AS observed_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events)
SELECT batch_name, job_id, status_code FROM j WHERE rn = 1""")
def stream_job_status(t: Tables) -> DataFrame:
    folder = scratch(t, "jobs")
    arrivals = _stream(t, "events").select(F.concat(F.lit("rtc_"), F.col("user_id").cast("string")).alias("batch_name"),
                                           (F.col("user_id") % 7).alias("job_id"), F.col("event_type").alias("status_code"), F.col("ts").alias("observed_at"))
    intake.stream_job_status(arrivals, f"{folder}/out", f"{folder}/state").awaitTermination()
    return intake.read_job_status(t.spark, f"{folder}/out").select("batch_name", "job_id", "status_code")
