"""Queries over radar granules, orders and power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import text as tx
from eoframe.operators import radar as ra
from eoframe.plans.registry import query
from eoframe.plans.views import Tables, rs, r, with_views  # noqa: F401

DRY, WET = "(12, 1, 2, 3, 4)", "(5, 6, 7, 8, 9, 10, 11)"


def granules(t: Tables) -> DataFrame:
    return ra.normalize_granules(t.view("granules_raw"))


_POL = "replace(polarization, '+', ',')"


@query(with_views(f"SELECT granule_no, granule, orbit_state, relative_orbit, {_POL} AS polarizations, month FROM granules", "granules"))
def normalize_granules(t: Tables) -> DataFrame:
    return granules(t).select("granule_no", "granule", "orbit_state", "relative_orbit",
                              F.array_join("polarizations", ",").alias("polarizations"), "month")


@query(with_views("SELECT granule_no, granule FROM granules WHERE orbit_state = 'descending'", "granules"))
def filter_orbit(t: Tables) -> DataFrame:
    return ra.filter_orbit(granules(t), "descending").select("granule_no", "granule")


_VERDICT = """
WITH v AS (SELECT *, CASE WHEN month NOT IN (12, 1, 2, 6, 7, 8) THEN 'orphan'
  WHEN polarization <> '' AND polarization <> 'VV+VH' THEN 'no_pol'
  WHEN trim(product_identifier) = '' THEN 'no_name' ELSE 'useful' END AS verdict,
  CASE WHEN trim(product_identifier) = '' THEN granule ELSE trim(product_identifier) END AS order_name FROM granules)
"""


def classified(t: Tables) -> DataFrame:
    return ra.classify_granules(granules(t), (12, 1, 2), (6, 7, 8), ["VH"])


@query(with_views(_VERDICT + "SELECT granule_no, order_name, verdict, verdict IN ('useful', 'no_name') AS is_useful FROM v", "granules"))
def classify_granules(t: Tables) -> DataFrame:
    return classified(t).select("granule_no", "order_name", "verdict", "is_useful")


_INVENTORY = f"""
WITH g AS (SELECT *, CAST(substr(start_time, 1, 4) AS INT) AS year FROM granules),
s AS (SELECT year, orbit_state, relative_orbit, CASE WHEN polarization = '' THEN '?' ELSE polarization END AS pol, count(*) AS n,
  count(CASE WHEN month IN {DRY} THEN 1 END) AS n_dry, count(CASE WHEN month IN {WET} THEN 1 END) AS n_wet
  FROM g GROUP BY 1, 2, 3, 4),
inv AS (SELECT year, orbit_state, relative_orbit, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_dry) AS BIGINT) AS n_dry,
  CAST(sum(n_wet) AS BIGINT) AS n_wet, string_agg(pol, ', ' ORDER BY pol) AS polarizations, CAST(sum(n) * 60 AS BIGINT) AS credits
  FROM s GROUP BY 1, 2, 3)
"""


def inventory(t: Tables) -> DataFrame:
    g = granules(t).withColumn("year", F.substring("start_time", 1, 4).cast("int"))
    return ra.track_inventory(g, 10, by=("year", "orbit_state", "relative_orbit"))


@query(with_views(_INVENTORY + "SELECT * FROM inv", "granules"))
def track_inventory(t: Tables) -> DataFrame:
    return inventory(t)


@query(with_views(_INVENTORY + """
SELECT *, least(n_dry, n_wet) AS weakest,
  CAST(row_number() OVER (PARTITION BY year ORDER BY least(n_dry, n_wet) DESC, n DESC, credits, relative_orbit) AS INT) AS position,
  rank() OVER (PARTITION BY year ORDER BY least(n_dry, n_wet) DESC, n DESC, credits) = 1 AS tied FROM inv""", "granules"))
def rank_tracks(t: Tables) -> DataFrame:
    return ra.rank_tracks(inventory(t), ["year"])


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), p AS (SELECT 10 AS res_m, 60 AS price UNION ALL SELECT 20, 15 UNION ALL SELECT 30, 5)
SELECT o_custkey, n, res_m, n * price AS cost FROM o JOIN customer ON o_custkey = c_custkey CROSS JOIN p WHERE n * price <= c_acctbal / 10""")
def affordable_options(t: Tables) -> DataFrame:
    n = t.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    balance = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 10).alias("balance"))
    return ra.affordable_options(n.join(balance, "o_custkey")).drop("balance")


@query(with_views(f"""
WITH f AS (SELECT relative_orbit, substr(start_time, 1, 7) AS ym, count(*) AS n, count(CASE WHEN month IN {DRY} THEN 1 END) AS n_dry,
  count(CASE WHEN month IN {WET} THEN 1 END) AS n_wet, count(CASE WHEN polarization = 'VV+VH' THEN 1 END) AS n_pol
  FROM granules GROUP BY 1, 2)
SELECT *, CASE WHEN n_dry < 0 OR n_wet < 0 THEN 'too_few_observations' WHEN n_pol = 0 THEN 'no_polarization' ELSE '' END AS reason FROM f""", "granules"))
def order_feasibility_by_month(t: Tables) -> DataFrame:
    g = granules(t).withColumn("ym", F.substring("start_time", 1, 7))
    return ra.order_feasibility(g, ["VV", "VH"], 0, by=("relative_orbit", "ym"))


@query(with_views(f"""
WITH f AS (SELECT relative_orbit, substr(start_time, 1, 4) AS year, count(*) AS n, count(CASE WHEN month IN {DRY} THEN 1 END) AS n_dry,
  count(CASE WHEN month IN {WET} THEN 1 END) AS n_wet, count(CASE WHEN polarization = 'HH+HV' THEN 1 END) AS n_pol
  FROM granules GROUP BY 1, 2)
SELECT *, CASE WHEN n_dry < 60 OR n_wet < 60 THEN 'too_few_observations' WHEN n_pol = 0 THEN 'no_polarization' ELSE '' END AS reason FROM f""", "granules"))
def order_feasibility(t: Tables) -> DataFrame:
    g = granules(t).withColumn("year", F.substring("start_time", 1, 4))
    return ra.order_feasibility(g, ["HH", "HV"], 60, by=("relative_orbit", "year"))


@query(f"""
WITH o AS (SELECT o_custkey, count(*) * 60 AS cost, count(CASE WHEN month(o_orderdate) IN {DRY} THEN 1 END) AS n_dry,
  count(CASE WHEN month(o_orderdate) IN {WET} THEN 1 END) AS n_wet FROM orders GROUP BY o_custkey)
SELECT o_custkey, cost, n_dry, n_wet, CASE WHEN cost > 900 THEN 'over_cap' WHEN cost > c_acctbal / 10 AND c_acctbal > 0 THEN 'over_balance'
  WHEN n_dry = 0 OR n_wet = 0 THEN 'season_empty' ELSE 'ok' END AS verdict FROM o JOIN customer ON o_custkey = c_custkey""")
def validate_order(t: Tables) -> DataFrame:
    rows = t.table("orders").withColumn("month", F.month("o_orderdate"))
    o = ra.season_split(rows, ["o_custkey"]).withColumn("cost", F.col("n") * 60).drop("n")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10)
    c = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), balance.alias("balance"), F.lit(900).alias("cap"))
    return ra.validate_order(o.join(c, "o_custkey")).drop("balance", "cap")


@query(with_views(f"""
SELECT relative_orbit, orbit_state, count(*) AS n, count(CASE WHEN month IN (1, 2) THEN 1 END) AS n_dry, CAST(0 AS BIGINT) AS n_wet
FROM granules GROUP BY 1, 2""", "granules"))
def season_split(t: Tables) -> DataFrame:
    return ra.season_split(granules(t), ["relative_orbit", "orbit_state"], dry=(1, 2), wet=())


@query(with_views("SELECT 'sensor' AS key FROM granules HAVING count(granule) > 0", "granules"))
def missing_keys(t: Tables) -> DataFrame:
    return ra.missing_keys(granules(t), ("orbit_state", "relative_orbit", "polarizations", "sensor"))


@query(with_views(_VERDICT + """
SELECT granule_no, CAST((row_number() OVER (ORDER BY granule, granule_no) + 199) // 200 AS BIGINT) AS batch
FROM v WHERE verdict IN ('useful', 'no_name')""", "granules"))
def batch_counts(t: Tables) -> DataFrame:
    useful = classified(t).where("is_useful").select("granule", "granule_no")
    return ra.batch_requests(useful, [F.col("granule"), F.col("granule_no")]).select("granule_no", "batch")


# jobs of orders: one batch per customer, one job per order
_JOBS = """
WITH j AS (SELECT concat('rtc_', CAST(o_custkey AS STRING)) AS batch_name, o_orderkey AS job_id,
  CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'FAILED' END AS status_code,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS expiration_time, CAST(o_totalprice AS BIGINT) AS size_bytes FROM orders)
"""


def jobs(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    status = (F.when(s == "F", F.lit("SUCCEEDED")).when(s == "O", F.lit("PENDING"))
              .when(F.col("o_orderkey") % 2 == 0, F.lit("RUNNING")).otherwise(F.lit("FAILED")))
    return t.table("orders").select(
        F.concat(F.lit("rtc_"), F.col("o_custkey").cast("string")).alias("batch_name"), F.col("o_orderkey").alias("job_id"),
        status.alias("status_code"), F.to_date("o_orderdate").cast("string").alias("expiration_time"),
        F.floor(F.col("o_totalprice") + 0.5).alias("size_bytes"))


@query(_JOBS.replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice + 0.5E0) AS BIGINT)") + """
SELECT batch_name, count(*) AS n_jobs, count(CASE WHEN status_code = 'SUCCEEDED' THEN 1 END) AS n_succeeded,
  count(CASE WHEN status_code IN ('PENDING', 'RUNNING') THEN 1 END) AS n_pending, count(CASE WHEN status_code = 'FAILED' THEN 1 END) AS n_failed,
  min(CASE WHEN status_code = 'SUCCEEDED' THEN expiration_time END) AS first_expiration,
  CAST(coalesce(sum(CASE WHEN status_code = 'SUCCEEDED' THEN size_bytes END), 0) AS BIGINT) AS total_bytes FROM j GROUP BY batch_name""")
def job_status(t: Tables) -> DataFrame:
    return ra.job_status(jobs(t))


@query(_JOBS + """
SELECT m.batch_name, m.job_id, m.status_code, l.l_linenumber AS file_no FROM j AS m JOIN lineitem AS l ON m.job_id = l.l_orderkey
WHERE m.batch_name = concat('rtc_', CAST(l.l_suppkey AS STRING)) OR l.l_linenumber = 1""")
def match_jobs(t: Tables) -> DataFrame:
    mine = jobs(t).select("batch_name", "job_id", "status_code")
    owner = t.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    files = t.table("lineitem").join(owner, "l_orderkey").where("o_custkey = l_suppkey OR l_linenumber = 1")
    responses = files.select(F.concat(F.lit("rtc_"), F.col("o_custkey").cast("string")).alias("batch_name"),
                             F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("file_no"))
    return ra.match_jobs(mine, responses)


# ----------------------------------------------------------------------- names

@query(with_views("""
SELECT granule_no, CAST(substr(granule, 22, 2) AS INT) AS month, concat(substr(granule, 18, 4), '-', substr(granule, 22, 2), '-', substr(granule, 24, 2)) AS date_text,
  CASE WHEN length(split_part(granule, '_', 5)) = 15 THEN split_part(granule, '_', 5) ELSE '' END AS stamp FROM granules""", "granules"))
def granule_dates(t: Tables) -> DataFrame:
    none, g = F.lit(None).cast("string"), F.col("granule")
    return granules(t).select("granule_no", tx.month_of(none, g).alias("month"), tx.date_of(none, g).alias("date_text"), tx.stamp_of(g).alias("stamp"))


@query(with_views("""
SELECT granule_no, CASE WHEN trim(product_identifier) = '' THEN granule ELSE trim(product_identifier) END AS name,
  trim(product_identifier) <> '' AS complete FROM granules""", "granules"))
def granule_name(t: Tables) -> DataFrame:
    return granules(t).select("granule_no", tx.granule_name(F.col("granule"), F.col("product_identifier")).alias("n")).select("granule_no", "n.name", "n.complete")


@query(with_views("""
SELECT granule_no, concat('S1_T', CAST(relative_orbit AS STRING), CASE orbit_state WHEN 'ascending' THEN 'A' ELSE 'D' END, '_20m_',
  split_part(granule, '_', 5), '_VH') AS label FROM granules""", "granules"))
def crop_label(t: Tables) -> DataFrame:
    label = tx.crop_label(F.col("relative_orbit"), F.col("orbit_state"), F.lit(20), tx.stamp_of(F.col("granule")), F.lit("VH"))
    return granules(t).select("granule_no", label.alias("label"))


@query(with_views("""
SELECT DISTINCT concat('AMPL_S1_', substr(start_time, 1, 4), '_T', CAST(relative_orbit AS STRING), CASE orbit_state WHEN 'ascending' THEN 'A' ELSE 'D' END,
  '_10m_VH_S0102030412_L05060708091011') AS amplitude_name,
  concat('MEDSECA_S1_', substr(start_time, 1, 4), '_T', CAST(relative_orbit AS STRING), CASE orbit_state WHEN 'ascending' THEN 'A' ELSE 'D' END,
  '_10m_VH_S0102030412') AS dry_name FROM granules""", "granules"))
def product_name(t: Tables) -> DataFrame:
    dry = tx.month_code_radar(F.array(*[F.lit(m) for m in dims.DRY_MONTHS]))
    wet = tx.month_code_radar(F.array(*[F.lit(m) for m in dims.WET_MONTHS]))
    args = (F.substring("start_time", 1, 4), F.col("relative_orbit"), F.col("orbit_state"), F.lit(10), F.lit("VH"), dry, wet)
    return granules(t).select(tx.radar_product_name("AMPL", *args).alias("amplitude_name"),
                              tx.radar_product_name("MEDSECA", *args).alias("dry_name")).distinct()


# ------------------------------------------------------------------ backscatter

_SAR_AMP = """
SELECT pol, track, pixel_id, n_dry, n_wet, CASE WHEN n_dry >= 3 AND n_wet >= 3 THEN md END AS med_dry,
  CASE WHEN n_dry >= 3 AND n_wet >= 3 THEN mw END AS med_wet, CASE WHEN n_dry >= 3 AND n_wet >= 3 THEN md - mw END AS amplitude
FROM (SELECT pol, track, pixel_id, count(CASE WHEN month IN (12, 1, 2, 3, 4) THEN value END) AS n_dry,
  count(CASE WHEN month NOT IN (12, 1, 2, 3, 4) THEN value END) AS n_wet,
  median(CASE WHEN month IN (12, 1, 2, 3, 4) THEN value END) AS md,
  median(CASE WHEN month NOT IN (12, 1, 2, 3, 4) THEN value END) AS mw FROM p GROUP BY pol, track, pixel_id) AS q"""
SAR_KEYS = ("pol", "track", "pixel_id")


@query(with_views("""
WITH p AS (SELECT 'VH' AS pol, track, pixel_id, month, nullif(vh, 0.0E0) AS value FROM sar_obs
  UNION ALL SELECT 'VV', track, pixel_id, month, nullif(vv, 0.0E0) FROM sar_obs)
""" + _SAR_AMP, "sar_obs"))
def sar_amplitude(t: Tables) -> DataFrame:
    return ra.sar_amplitude(ra.sar_power(t.view("sar_obs")), SAR_KEYS)


_RVI = """
WITH p AS (SELECT 'RVI' AS pol, track, pixel_id, month, 4.0E0 * nullif(vh, 0.0E0) / nullif(nullif(vv, 0.0E0) + nullif(vh, 0.0E0), 0.0E0) AS value FROM sar_obs)
"""


@query(with_views(_RVI + _SAR_AMP, "sar_obs"))
def rvi_amplitude(t: Tables) -> DataFrame:
    return ra.rvi_amplitude(t.view("sar_obs"), SAR_KEYS)


@query(with_views("""
SELECT l_orderkey, l_linenumber, track, acquired, max(nullif(vh, 0.0E0)) AS vh, max(nullif(vv, 0.0E0)) AS vv
FROM sar_obs GROUP BY l_orderkey, l_linenumber, track, acquired""", "sar_obs"))
def pair_polarizations(t: Tables) -> DataFrame:
    return ra.pair_polarizations(ra.sar_power(t.view("sar_obs")), ["l_orderkey", "l_linenumber", "track", "acquired"])
