"""Queries over mosaic versions, tiles and their source images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.functions import text as tx
from eoframe.operators import mosaic as mo
from eoframe.operators.ranks import number_rows
from eoframe.plans.registry import query
from eoframe.plans.views import Tables

# configuration entries: one per order, some with odd keys and titles
_ENTRIES = """
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'x7' ELSE CAST(o_orderkey AS STRING) END AS key,
  CASE WHEN o_orderkey % 23 = 0 THEN 'No date' ELSE concat('World Imagery (old) (Wayback ', CAST(CAST(o_orderdate AS DATE) AS STRING), ')') END AS title,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders),
v AS (SELECT CAST(o_orderkey AS INT) AS num, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE d END AS published FROM e WHERE key <> 'x7'),
p AS (SELECT num, published, row_number() OVER (ORDER BY published DESC, num DESC) - 1 AS pos FROM v)
"""


def entries(t: Tables) -> DataFrame:
    """Configuration objects as JSON maps, exploded into entries."""
    k = F.col("o_orderkey")
    key = F.when(k % 19 == 0, F.lit("x7")).otherwise(k.cast("string"))
    title = F.when(k % 23 == 0, F.lit("No date")).otherwise(
        F.concat(F.lit("World Imagery (old) (Wayback "), F.to_date("o_orderdate").cast("string"), F.lit(")")))
    config = F.to_json(F.create_map(key, F.struct(title.alias("itemTitle"), F.lit("https://t/{level}").alias("itemURL"))))
    parsed = F.from_json(config, "MAP<STRING, STRUCT<itemTitle: STRING, itemURL: STRING, metadataLayerUrl: STRING>>")
    return t.table("orders").select(F.explode(parsed).alias("key", "v")).select(
        "key", F.col("v.itemTitle").alias("title"), F.col("v.itemURL").alias("url"), F.col("v.metadataLayerUrl").alias("meta_url"))


@query(_ENTRIES + "SELECT num, published, pos FROM p")
def read_versions(t: Tables) -> DataFrame:
    return mo.read_versions(entries(t)).select("num", "published", "pos")


@query(_ENTRIES + "SELECT num, published FROM p WHERE published >= '1996-03-01' AND published <= '1999-06-30'")
def filter_published(t: Tables) -> DataFrame:
    return mo.filter_published(mo.read_versions(entries(t)), "1996-03-01", "1999-06-30").select("num", "published")


# tiles out of the embeddings: 64 values are an 8x8 tile; the second half are recompressed copies
_TILES = """
WITH RECURSIVE base AS (SELECT label AS tile_key, vec_id AS num, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 255.0E0 + 0.5E0) AS INT)) AS px FROM embeddings),
tiles AS (SELECT tile_key, num * 2 + 2 AS num, CASE WHEN num % 41 = 0 THEN NULL ELSE px END AS px FROM base
  UNION ALL SELECT tile_key, num * 2 + 3, list_transform(px, lambda x: x + 1) FROM base),
t AS (SELECT *, row_number() OVER (PARTITION BY tile_key ORDER BY num) AS i FROM tiles)
"""


def tile_pixels(t: Tables) -> DataFrame:
    px = F.transform("embedding", lambda x: F.floor(x.cast("double") * 255.0 + 0.5).cast("smallint"))
    base = t.table("embeddings").select(F.col("label").alias("tile_key"), F.col("vec_id"), px.alias("px"))
    own = base.select("tile_key", (F.col("vec_id") * 2 + 2).alias("num"), F.when(F.col("vec_id") % 41 != 0, F.col("px")).alias("px"))
    shifted = F.transform("px", lambda x: (x + 1).cast("smallint"))
    copies = base.select("tile_key", (F.col("vec_id") * 2 + 3).alias("num"), shifted.alias("px"))
    return own.unionByName(copies)


_FOLD = """,
f(tile_key, i, num, kept, last) AS (SELECT tile_key, i, num, true, px FROM t WHERE i = 1
  UNION ALL SELECT t.tile_key, t.i, t.num, k.keep, CASE WHEN t.px IS NULL THEN NULL WHEN k.keep THEN t.px ELSE f.last END
  FROM f JOIN t ON t.tile_key = f.tile_key AND t.i = f.i + 1
  CROSS JOIN LATERAL (SELECT t.px IS NULL OR f.last IS NULL OR
    list_sum(list_transform(list_zip(t.px, f.last), lambda z: abs(z[1] - z[2]))) / 64.0E0 >= 2.0E0 AS keep) AS k)
"""


@query(_TILES + _FOLD + "SELECT tile_key, num FROM f WHERE kept")
def drop_same_photo(t: Tables) -> DataFrame:
    return mo.drop_same_photo(tile_pixels(t))


@query(_TILES + """
SELECT a.tile_key, a.num, coalesce(list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) / 64.0E0 < 2.0E0, false) AS same
FROM t AS a JOIN t AS b ON a.tile_key = b.tile_key AND b.num = a.num + 1 WHERE a.num % 2 = 0""")
def same_photo(t: Tables) -> DataFrame:
    tiles = tile_pixels(t)
    mate = tiles.select("tile_key", (F.col("num") - 1).alias("num"), F.col("px").alias("mate"))
    return tiles.join(mate, ["tile_key", "num"]).where("num % 2 = 0").select(
        "tile_key", "num", mo.same_photo(F.col("px"), F.col("mate")).alias("same"))


def tilemap(t: Tables) -> DataFrame:
    """Cells per tile, newest first; odd versions redirect to the next older one."""
    cells = tile_pixels(t).select("tile_key", "num")
    placed = number_rows(cells, ["tile_key"], [F.col("num")], "nth", descending=(True,))
    odd = F.col("num") % 2 == 1
    return placed.select(
        "tile_key", (F.col("nth") - 1).alias("pos"), "num", (F.col("num") % 202 != 0).alias("has_data"),
        F.when(odd, F.col("nth")).alias("select_pos"), F.when(odd, F.col("num") - 1).otherwise(F.lit(0)).alias("select_num"),
        (F.col("num") * 7 % 1000).alias("size_bytes"))


_CHAIN = """
WITH RECURSIVE c AS (SELECT label AS tile_key, vec_id * 2 + 2 AS num FROM embeddings UNION ALL SELECT label, vec_id * 2 + 3 FROM embeddings),
m AS (SELECT *, row_number() OVER (PARTITION BY tile_key ORDER BY num DESC) - 1 AS pos FROM c),
w(tile_key, pos, step, num) AS (SELECT tile_key, pos + num % 2, 1, num - num % 2 FROM m WHERE pos = 0 AND num % 202 <> 0
  UNION ALL SELECT m.tile_key, m.pos + m.num % 2, w.step + 1, m.num - m.num % 2 FROM w
  JOIN m ON m.tile_key = w.tile_key AND m.pos = w.pos + 1 WHERE m.num % 202 <> 0)
"""


@query(_CHAIN + "SELECT tile_key, CAST(step AS INT) AS step, num FROM w")
def changed_versions(t: Tables) -> DataFrame:
    return mo.changed_versions(tilemap(t)).select("tile_key", "step", "num")


@query(_CHAIN + ", h AS (SELECT num // 40 AS num, tile_key FROM w) SELECT num, count(DISTINCT tile_key) AS hits FROM h GROUP BY num")
def version_hits(t: Tables) -> DataFrame:
    found = mo.changed_versions(tilemap(t)).withColumn("num", F.floor(F.col("num") / 40))
    return mo.version_hits(found)


@query(_CHAIN + "SELECT DISTINCT num FROM w UNION SELECT num FROM m WHERE num % 2 = 0")
def version_union(t: Tables) -> DataFrame:
    cells = tilemap(t)
    return mo.changed_versions(cells).select("num").union(cells.where("num % 2 = 0").select("num")).distinct()


# metadata responses: one per event, the version is the user, the point comes from the value
def responses(t: Tables) -> DataFrame:
    k = F.col("event_id")
    attributes = F.struct(
        (F.unix_date(F.to_date("ts")).cast("bigint") * 86400000).cast("string").alias("SRC_DATE2"),
        F.concat(F.lit(" P"), (k % 3).cast("string")).alias("NICE_DESC"),
        F.when(k % 4 == 0, F.concat(F.lit("P"), (k % 3).cast("string"))).when(k % 4 == 1, F.lit("")).otherwise(F.lit("S2 ")).alias("SRC_DESC"),
        F.when(k % 5 != 0, F.col("value")).alias("SAMP_RES"),
        F.lit(None).cast("double").alias("SRC_ACC"))
    body = F.to_json(F.struct(F.array(F.struct(attributes.alias("attributes"))).alias("features")))
    text = (F.when(k % 10 == 0, F.lit('{"error": "timeout"}')).when(k % 10 == 7, F.lit('{"features": []}')).otherwise(body))
    return t.table("events").select("event_id", F.col("user_id").alias("num"), F.col("value").alias("lon"),
                                    (F.col("event_id") / 10.0).alias("lat"), text.alias("response"))


_META = """
WITH r AS (SELECT event_id, user_id AS num, value AS lon, event_id / 10.0E0 AS lat, event_id % 10 NOT IN (0, 7) AS covered,
  CASE WHEN event_id % 10 NOT IN (0, 7) THEN CAST(CAST(ts AS DATE) AS STRING) END AS capture,
  CASE WHEN event_id % 10 NOT IN (0, 7) THEN concat('P', CAST(event_id % 3 AS STRING)) END AS provider,
  CASE WHEN event_id % 10 NOT IN (0, 7) THEN CASE event_id % 4 WHEN 0 THEN concat('P', CAST(event_id % 3 AS STRING)) WHEN 1 THEN '' ELSE 'S2' END END AS sensor,
  CASE WHEN event_id % 10 NOT IN (0, 7) AND event_id % 5 <> 0 THEN value END AS res,
  CASE WHEN event_id % 10 = 0 THEN 'timeout' END AS error FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY (lon - 50.0E0) * (lon - 50.0E0) + (lat - 100.0E0) * (lat - 100.0E0), lon, lat) AS rank FROM r)
"""


@query(_META + "SELECT event_id, num, covered, capture, provider, sensor, res, error FROM r")
def tile_metadata(t: Tables) -> DataFrame:
    return mo.tile_metadata(responses(t)).select("event_id", "num", "covered", "capture", "provider", "sensor", "res", "error")


@query(_META + "SELECT event_id, num, CAST(rank AS INT) AS rank FROM n WHERE rank <= 3")
def nearest_points(t: Tables) -> DataFrame:
    return mo.nearest_points(responses(t), F.lit(50.0), F.lit(100.0)).select("event_id", "num", "rank")


_SUMMARY = """, s AS (SELECT num, rank, capture, res, error, CASE WHEN covered THEN CASE WHEN sensor <> '' AND sensor <> provider
    THEN concat(provider, ' (', sensor, ')') ELSE provider END END AS source FROM n WHERE rank <= 3),
q AS (SELECT num, source, min(rank) AS rank FROM s WHERE source IS NOT NULL GROUP BY num, source),
src AS (SELECT num, string_agg(source, ' / ' ORDER BY rank) AS sources FROM q GROUP BY num),
d AS (SELECT num, string_agg(DISTINCT capture, ',' ORDER BY capture) AS dates, count(DISTINCT capture) AS k, min(capture) AS a, max(capture) AS b,
  count(error) AS failures, arg_min(res, rank) AS res FROM s GROUP BY num),
y AS (SELECT d.num, coalesce(dates, '') AS dates, coalesce(sources, '') AS sources, res, failures,
  CASE WHEN k = 0 AND failures > 0 THEN '?' WHEN k = 0 THEN '—' WHEN k = 1 THEN a ELSE concat(a, '…', b, ' (', CAST(k AS STRING), ')') END AS summary
  FROM d LEFT JOIN src ON d.num = src.num)
"""


@query(_META + _SUMMARY + "SELECT * FROM y")
def version_metadata(t: Tables) -> DataFrame:
    return mo.version_metadata(mo.tile_metadata(responses(t)), F.lit(50.0), F.lit(100.0)).drop("accuracy")


# versions with capture dates per customer
_CAPTURES = """
WITH v AS (SELECT o_custkey AS aoi, o_orderkey AS num, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published,
  CASE WHEN o_orderkey % 6 = 0 THEN '?' ELSE concat('20', CAST(10 + o_orderkey % 4 AS STRING), '-05-01') END AS capture,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) - 1 AS pos FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY aoi, capture ORDER BY pos) AS rn,
  first_value(num) OVER (PARTITION BY aoi, capture ORDER BY pos) AS kept_num, count(*) OVER (PARTITION BY aoi, capture) AS k FROM v)
"""


def captured(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.table("orders").select(
        F.col("o_custkey").alias("aoi"), k.alias("num"), F.to_date("o_orderdate").cast("string").alias("published"),
        F.when(k % 6 == 0, F.lit("?")).otherwise(F.concat(F.lit("20"), (k % 4 + 10).cast("string"), F.lit("-05-01"))).alias("capture"))
    placed = number_rows(rows, ["aoi"], [F.col("published"), F.col("num")], "nth", descending=(True, True))
    return placed.withColumn("pos", F.col("nth") - 1).drop("nth")


@query(_CAPTURES + """
SELECT aoi, num, published, capture, pos, CASE WHEN capture = '?' THEN 0 ELSE k - 1 END AS n_equivalent FROM w WHERE capture = '?' OR rn = 1""")
def one_per_capture(t: Tables) -> DataFrame:
    return mo.one_per_capture(captured(t), ["aoi"])[0]


@query(_CAPTURES + "SELECT aoi, capture, kept_num, num, published FROM w WHERE capture <> '?' AND rn > 1")
def merged_captures(t: Tables) -> DataFrame:
    return mo.one_per_capture(captured(t), ["aoi"])[1]


@query(_CAPTURES + """, a AS (SELECT o_custkey AS aoi, CAST(o_custkey % 2 = 0 AS BOOLEAN) AS same FROM orders GROUP BY o_custkey)
SELECT aoi, CAST(NULL AS BIGINT) AS num, 'vigente' AS published, 'n/d' AS capture, CAST(-1 AS BIGINT) AS pos FROM a WHERE NOT same
UNION ALL SELECT aoi, num, published, capture, pos FROM v""")
def add_current_mosaic(t: Tables) -> DataFrame:
    versions = captured(t)
    live = F.when(F.col("aoi") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).cast("binary")
    tiles = versions.select("aoi").distinct().select("aoi", live.alias("current_tile"), F.lit("a").cast("binary").alias("archived_tile"))
    return mo.add_current_mosaic(versions, tiles, by=("aoi",))


@query(_CAPTURES + """
SELECT aoi, num, CASE WHEN num % 50 = 0 THEN 'vigente' WHEN capture = '?' THEN concat(published, '_capND') ELSE concat(published, '_cap', capture) END AS label FROM v""")
def capture_label(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    capture = F.when(k % 6 == 0, F.lit("?")).otherwise(F.concat(F.lit("20"), (k % 4 + 10).cast("string"), F.lit("-05-01")))
    label = tx.capture_label(F.to_date("o_orderdate").cast("string"), capture, k % 50 == 0)
    return t.table("orders").select(F.col("o_custkey").alias("aoi"), k.alias("num"), label.alias("label"))
