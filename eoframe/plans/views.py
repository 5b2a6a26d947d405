"""Earth-observation views over the test tables, one SQL text for both engines.

The texts are standard SQL; ``{orders}`` and the like stand for a table.
Dates move forward by 23 years so that they fall in the satellite era.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe import dims

_SHIFTED = "CAST(CAST({} AS DATE) + INTERVAL 23 YEAR AS DATE)"

# Sums depend on row order in the last bits, so results are cut to a fixed
# number of decimals; the odd threshold is one no decimal value sits on.
_OFF_GRID = 0.4142135


def r(value: Column | str, digits: int = 9) -> Column:
    """A double cut to ``digits`` decimals, the same way in both engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * F.lit(10.0**digits) + F.lit(_OFF_GRID)) / F.lit(10.0**digits)


def rs(expression: str, digits: int = 9) -> str:
    """The SQL text of :func:`r`."""
    return f"floor(({expression}) * 1E{digits} + {_OFF_GRID}E0) / 1E{digits}"


BASE_VIEWS = {
    # scene catalogue: one row per order
    "scenes": f"""
SELECT o_orderkey AS scene_id, {_SHIFTED.format('o_orderdate')} AS acquired,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) END AS cloud_pct,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 53) % 101 AS DOUBLE) END AS aoi_cloud_pct,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'landsat-5' WHEN '2-HIGH' THEN 'landsat-7'
    WHEN '3-MEDIUM' THEN 'landsat-8' WHEN '4-NOT SPECIFIED' THEN 'Sentinel-2A' ELSE 'sentinel-2' END AS platform,
  CASE WHEN o_orderpriority < '4' THEN 'ls' ELSE 's2' END AS family,
  CASE WHEN o_orderpriority < '4' THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection,
  CAST(o_custkey % 20 AS BIGINT) AS wrs_path, CAST(o_custkey % 7 AS BIGINT) AS wrs_row,
  CAST(o_custkey % 40 AS DOUBLE) / 20 - 85 AS west, CAST(o_custkey % 30 AS DOUBLE) / 20 + 9 AS south,
  CAST(o_custkey % 40 AS DOUBLE) / 20 - 84 AS east, CAST(o_custkey % 30 AS DOUBLE) / 20 + 10 AS north
FROM {{orders}}""",
    # optical pixel observations: one row per line item
    "obs": f"""
SELECT l_orderkey, l_linenumber, l_partkey AS pixel_id, l_partkey % 4 AS grid_no,
  l_partkey % 50 AS px_col, CAST(FLOOR(l_partkey / 50) AS BIGINT) AS px_row,
  {_SHIFTED.format('l_shipdate')} AS acquired, CAST(month(l_shipdate) AS INT) AS month,
  CAST((year(l_shipdate) + 23) * 100 + month(l_shipdate) AS BIGINT) AS scene_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'ls' ELSE 's2' END AS family,
  CASE WHEN l_suppkey % 2 = 0 THEN '04.00' ELSE '03.01' END AS baseline,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'sentinel-2a' WHEN l_suppkey % 5 = 0 THEN 'landsat-5'
    WHEN l_suppkey % 5 = 1 THEN 'LANDSAT_7' WHEN l_suppkey % 5 = 4 THEN 'landsat-6'
    ELSE 'landsat 8' END AS platform,
  300 + (l_orderkey * 5 + l_partkey) % 900 AS blue,
  400 + (l_orderkey * 3 + l_suppkey) % 1100 AS green,
  1000 + CAST(l_quantity AS BIGINT) * 40 AS red,
  800 + (l_orderkey * 19 + l_partkey) % 1500 AS rededge1,
  1200 + (l_orderkey * 23 + l_suppkey) % 2500 AS rededge3,
  1500 + CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 4000 AS nir,
  1400 + (l_partkey * 13 + l_orderkey) % 4100 AS nir08,
  900 + (l_orderkey * 17 + l_linenumber * 101) % 3000 AS swir16,
  500 + (l_orderkey * 11 + l_suppkey * 7) % 2600 AS swir22,
  CAST((l_orderkey * 7 + l_linenumber) % 12 AS INT) AS scl,
  CAST((l_orderkey * 5 + l_suppkey) % 64 AS INT) AS qa_pixel
FROM {{lineitem}}""",
    # radar power per pixel; exact zero is no data
    "sar_obs": f"""
SELECT l_partkey % 100 AS pixel_id, l_suppkey % 6 AS track,
  {_SHIFTED.format('l_shipdate')} AS acquired, CAST(month(l_shipdate) AS INT) AS month,
  l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 97 = 0 THEN 0.0E0 ELSE CAST(1 + (l_orderkey * 7 + l_linenumber) % 400 AS DOUBLE) / 10000 END AS vh,
  CASE WHEN l_orderkey % 89 = 0 THEN 0.0E0 ELSE CAST(1 + (l_orderkey * 3 + l_partkey) % 900 AS DOUBLE) / 5000 END AS vv
FROM {{lineitem}}""",
    # radar granules in the search service's vocabulary: mixed case, padded, empty polarisation
    "granules_raw": f"""
SELECT o_orderkey AS granule_no,
  concat('S1A_IW_GRDH_1SDV_', replace(CAST({_SHIFTED.format('o_orderdate')} AS STRING), '-', ''),
         'T', CAST(100000 + o_orderkey % 86400 AS STRING), '_X_', CAST(o_orderkey AS STRING)) AS granule,
  CAST({_SHIFTED.format('o_orderdate')} AS STRING) AS start_time,
  CAST(o_custkey % 12 + 1 AS INT) AS path,
  CASE WHEN o_custkey % 2 = 0 THEN ' ASCENDING' ELSE 'Descending' END AS flight_direction,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'VV' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN 'HH+HV' ELSE 'VV+VH' END AS polarization,
  CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE concat('S1A_', CAST(o_orderkey AS STRING), '_60D5') END AS product_identifier
FROM {{orders}}""",
    # date texts in six shapes; ambiguous and impossible ones must not normalise
    "raw_dates": """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10) WHEN 1 THEN replace(substr(CAST(ts AS STRING), 1, 10), '-', '/')
  WHEN 2 THEN substr(CAST(ts AS STRING), 1, 19)
  WHEN 3 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), 'Z')
  WHEN 4 THEN concat(substr(CAST(ts AS STRING), 9, 2), '/', substr(CAST(ts AS STRING), 6, 2), '/2024')
  ELSE '2024-02-30' END AS raw_date
FROM {events}""",
    # markup documents, with a stray closing tag inside a script
    "kml_docs": """
SELECT page_id, url, replace(replace(replace(html, '<p>', '<coordinates>'), '</p>', '</coordinates>'), '<li>', '<Placemark>') AS kml
FROM {pages}""",
}


def reflectance_sql(band: str) -> str:
    """Check SQL of the reflectance rule for one band."""
    return (
        f"CASE WHEN family = 'ls' THEN {band} * 0.0000275E0 - 0.2E0 "
        f"WHEN baseline >= '04.00' THEN ({band} - 1000) / 10000.0E0 ELSE {band} / 10000.0E0 END"
    )


BAD_SQL = (
    "CASE WHEN family = 'ls' THEN (qa_pixel & 1) <> 0 OR (qa_pixel & 30) <> 0 "
    "ELSE scl IN (0, 1, 3, 8, 9, 10) END"
)
TC_GROUP_SQL = (
    "CASE WHEN family <> 'ls' THEN 'MSI' WHEN lower(platform) = 'landsat-5' THEN 'TM' "
    "WHEN lower(platform) = 'landsat_7' THEN 'ETM' WHEN lower(platform) = 'landsat 8' THEN 'OLI' END"
)
SPECTRAL = ("blue", "green", "red", "rededge1", "rededge3", "nir", "nir08", "swir16", "swir22")


def _tc_sql(component: str) -> str:
    terms = []
    for grp, sets in dims.TC_COEFFICIENTS.items():
        total = " + ".join(f"({c!r}E0) * {b}" for c, b in zip(sets[component], dims.TC_BANDS))
        terms.append(f"WHEN '{grp}' THEN {total}")
    return f"CASE tc_group {' '.join(terms)} END"


INDEX_SQL = {
    "NDVI": "(nir - red) / nullif(nir + red, 0.0E0)",
    "SAVI": "1.5E0 * (nir - red) / nullif(nir + red + 0.5E0, 0.0E0)",
    "EVI2": "2.5E0 * (nir - red) / nullif(nir + 2.4E0 * red + 1.0E0, 0.0E0)",
    "NDMI": "(nir08 - swir16) / nullif(nir08 + swir16, 0.0E0)",
    "NBR": "(nir08 - swir22) / nullif(nir08 + swir22, 0.0E0)",
    "MSI": "swir16 / nullif(nir08, 0.0E0)",
    "NDRE": "(nir08 - rededge1) / nullif(nir08 + rededge1, 0.0E0)",
    "CIre": "rededge3 / nullif(rededge1, 0.0E0) - 1.0E0",
    "TCB": _tc_sql("B"),
    "TCG": _tc_sql("G"),
    "TCW": _tc_sql("W"),
}


def index_rows_sql(name: str) -> str:
    """Check SQL: long rows of one index out of the view ``refl``."""
    bounds = dims.INDEX_LIMITS.get(name)
    kept = "raw" if bounds is None else f"CASE WHEN raw BETWEEN {bounds[0]}E0 AND {bounds[1]}E0 THEN raw END"
    only = " WHERE family <> 'ls'" if name in dims.S2_ONLY else ""
    return (
        f"SELECT '{name}' AS index, l_orderkey, l_linenumber, pixel_id, grid_no, px_col, px_row, acquired, month, "
        f"scene_id, raw, CASE WHEN NOT bad THEN {kept} END AS value "
        f"FROM (SELECT *, {INDEX_SQL[name]} AS raw FROM refl{only}) AS {name.lower()}_rows"
    )


_REFL = (
    "SELECT l_orderkey, l_linenumber, pixel_id, grid_no, px_col, px_row, acquired, month, scene_id, family, "
    f"platform, scl, qa_pixel, {TC_GROUP_SQL} AS tc_group, {BAD_SQL} AS bad, "
    + ", ".join(f"{reflectance_sql(b)} AS {b}" for b in SPECTRAL)
    + " FROM obs"
)
_GRANULES = """
SELECT granule_no, trim(granule) AS granule, start_time, lower(trim(flight_direction)) AS orbit_state,
  path AS relative_orbit, polarization, CAST(CAST(substr(start_time, 6, 2) AS INT) AS INT) AS month,
  product_identifier
FROM granules_raw WHERE trim(granule) <> ''"""

# Views used only by the check SQL, in dependency order.
CHECK_VIEWS = {
    "refl": ("obs", _REFL),
    "idx": ("refl", " UNION ALL ".join(index_rows_sql(n) for n in dims.INDEX_NAMES)),
    "granules": ("granules_raw", _GRANULES),
}
for _n in dims.INDEX_NAMES:
    CHECK_VIEWS[f"idx_{_n.lower()}"] = ("refl", index_rows_sql(_n))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def with_views(body: str, *names: str) -> str:
    """Check SQL with the named views (and those they need) in front as CTEs."""
    ordered: list[str] = []

    def need(n: str) -> None:
        if n in ordered:
            return
        if n in CHECK_VIEWS:
            need(CHECK_VIEWS[n][0])
        ordered.append(n)

    for n in names:
        need(n)
    texts = {t: t for t in TABLES}
    parts = []
    for n in ordered:
        text = CHECK_VIEWS[n][1] if n in CHECK_VIEWS else BASE_VIEWS[n].format(**texts)
        parts.append(f"{n} AS ({text})")
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


class Tables:
    """The test tables of one scale, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = BASE_VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)
