"""Radar granules, orders and seasonal backscatter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import radiometry as rad
from eoframe.functions.indices import rvi_dual_pol
from eoframe.functions.text import granule_name, month_of
from eoframe.operators.ranks import number_rows
from eoframe.operators.seasonal import seasonal_amplitude, season_of


def normalize_granules(raw: DataFrame) -> DataFrame:
    """Search records in the vocabulary used here; rows without a name are dropped.

    An empty direction or beam mode is '?'.
    """
    direction = F.lower(F.trim(F.coalesce(F.nullif(F.col("flight_direction"), F.lit("")), F.lit("?"))))
    pols = F.filter(F.split(F.coalesce(F.col("polarization"), F.lit("")), r"[+,\s]+"), lambda p: p != "")
    keep = [c for c in raw.columns if c not in ("granule", "flight_direction", "polarization", "path", "beam_mode")]
    mode = [F.coalesce(F.nullif(F.col("beam_mode"), F.lit("")), F.lit("?")).alias("beam_mode")] if "beam_mode" in raw.columns else []
    return raw.select(
        F.trim(F.coalesce(F.col("granule"), F.lit(""))).alias("granule"),
        direction.alias("orbit_state"),
        F.col("path").alias("relative_orbit"),
        pols.alias("polarizations"),
        month_of(F.col("start_time"), F.col("granule")).alias("month"),
        *mode,
        *keep,
    ).where(F.col("granule") != "")


def filter_orbit(granules: DataFrame, direction: str = "any") -> DataFrame:
    """'any', 'ascending' or 'descending'."""
    if direction == "any":
        return granules
    return granules.where(F.col("orbit_state") == direction)


def has_polarizations(pols: Column, wanted: Sequence[str]) -> Column:
    """All wanted polarisations are among the known ones."""
    known = F.transform(F.coalesce(pols, F.array().cast("array<string>")), F.upper)
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), known)) == 0


def classify_granules(
    granules: DataFrame, dry: Sequence[int], wet: Sequence[int], wanted: Sequence[str]
) -> DataFrame:
    """Adds ``verdict``: orphan, no_pol, no_name or useful, tested in this order.

    An empty polarisation list passes; 'no_name' granules still count as useful.
    """
    known = F.coalesce(F.size("polarizations"), F.lit(0)) > 0
    named = granule_name(F.col("granule"), F.col("product_identifier"))
    verdict = (
        F.when(~F.coalesce(F.col("month").isin(*dry, *wet), F.lit(False)), F.lit("orphan"))
        .when(known & ~has_polarizations(F.col("polarizations"), wanted), F.lit("no_pol"))
        .when(~named["complete"], F.lit("no_name"))
        .otherwise(F.lit("useful"))
    )
    return granules.select("*", named["name"].alias("order_name"), verdict.alias("verdict")).withColumn(
        "is_useful", F.col("verdict").isin("useful", "no_name")
    )


def season_split(
    rows: DataFrame, by: Sequence[str], dry: Sequence[int] | None = None, wet: Sequence[int] | None = None
) -> DataFrame:
    """Counts per season.  None means the default months, an empty list counts zero."""
    dry = dims.DRY_MONTHS if dry is None else dry
    wet = dims.WET_MONTHS if wet is None else wet
    season = season_of(F.col("month"), dry, wet)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(season == "dry", F.lit(False))).alias("n_dry"),
        F.count_if(F.coalesce(season == "wet", F.lit(False))).alias("n_wet"),
    )


def track_inventory(
    granules: DataFrame,
    res_m: int = 10,
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    by: Sequence[str] = ("orbit_state", "relative_orbit"),
) -> DataFrame:
    """Granules, seasons, price and polarisation sets per direction and track.

    One pre-aggregated row per polarisation set comes before the listing, so
    a track with most of the granules is a handful of rows by then.
    """
    pol = F.coalesce(F.nullif(F.array_join("polarizations", "+"), F.lit("")), F.lit("?"))
    season = season_of(F.col("month"), dry, wet)
    sets = granules.groupBy(*by, pol.alias("_pol")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(season == "dry", F.lit(False))).alias("n_dry"),
        F.count_if(F.coalesce(season == "wet", F.lit(False))).alias("n_wet"),
    )
    return (
        sets.groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_dry").alias("n_dry"),
            F.sum("n_wet").alias("n_wet"),
            F.array_join(F.array_sort(F.collect_list("_pol")), ", ").alias("polarizations"),
        )
        .withColumn("credits", F.col("n") * F.lit(dims.CREDITS[res_m]))
        .orderBy(F.col("n").desc(), *by)
    )


def rank_tracks(inventory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tracks by their weaker season, then size, price, number; ``tied`` equals the first.

    The inventory has one row per track (175 at most), so its window is small.
    """
    weakest = F.least("n_dry", "n_wet")
    keys = [weakest.desc(), F.col("n").desc(), F.col("credits").asc()]
    group = Window.partitionBy(*by)
    return (
        inventory.withColumn("weakest", weakest)
        .withColumn("position", F.row_number().over(group.orderBy(*keys, F.col("relative_orbit").asc())))
        .withColumn("tied", F.rank().over(group.orderBy(*keys)) == 1)
    )


def affordable_options(orders: DataFrame) -> DataFrame:
    """Pixel spacings whose cost fits the balance (inclusive); no balance, no options.

    ``orders`` has ``n`` and ``balance``; the three prices are a literal array.
    """
    prices = F.array(*[F.struct(F.lit(m).alias("res_m"), F.lit(c).alias("price")) for m, c in sorted(dims.CREDITS.items())])
    return (
        orders.select("*", F.explode(prices).alias("_p"))
        .select(*orders.columns, F.col("_p.res_m").alias("res_m"), (F.col("n") * F.col("_p.price")).alias("cost"))
        .where(F.col("cost") <= F.col("balance"))
    )


def order_feasibility(
    granules: DataFrame,
    wanted: Sequence[str],
    min_obs: int = dims.MIN_OBS,
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    by: Sequence[str] = ("relative_orbit",),
) -> DataFrame:
    """Per track: season counts, granules with the polarisations, and what forbids the order.

    Unlike in the classification an unknown polarisation fails here.
    """
    season = season_of(F.col("month"), dry, wet)
    reason = (
        F.when((F.col("n_dry") < min_obs) | (F.col("n_wet") < min_obs), F.lit("too_few_observations"))
        .when(F.col("n_pol") == 0, F.lit("no_polarization"))
        .otherwise(F.lit(""))
    )
    return (
        granules.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.coalesce(season == "dry", F.lit(False))).alias("n_dry"),
            F.count_if(F.coalesce(season == "wet", F.lit(False))).alias("n_wet"),
            F.count_if(has_polarizations(F.col("polarizations"), wanted)).alias("n_pol"),
        )
        .withColumn("reason", reason)
    )


def validate_order(orders: DataFrame) -> DataFrame:
    """Adds ``verdict``: over_cap, over_balance, season_empty or ok, in this order.

    Columns cost, cap, balance (may be NULL: unknown), n_dry, n_wet.
    """
    return orders.withColumn(
        "verdict",
        F.when(F.col("cost") > F.col("cap"), F.lit("over_cap"))
        .when(F.col("cost") > F.col("balance"), F.lit("over_balance"))
        .when((F.col("n_dry") == 0) | (F.col("n_wet") == 0), F.lit("season_empty"))
        .otherwise(F.lit("ok")),
    )


def missing_keys(
    granules: DataFrame, expected: Sequence[str] = ("orbit_state", "relative_orbit", "polarizations")
) -> DataFrame:
    """Expected properties that no row has, one per row."""
    counts = granules.agg(
        *[(F.count(F.col(c)) if c in granules.columns else F.lit(0).cast("bigint")).alias(c) for c in expected]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in expected])
    return counts.select(F.explode(pairs).alias("p")).where("p.n = 0").select("p.key")


def batch_requests(useful: DataFrame, order: Sequence[Column], size: int = dims.JOBS_PER_REQUEST) -> DataFrame:
    """Adds ``batch``: requests of at most ``size`` definitions in the given order."""
    numbered = number_rows(useful, [], order, "_nth")
    return numbered.withColumn("batch", F.ceil(F.col("_nth") / size).cast("bigint")).drop("_nth")


def job_status(jobs: DataFrame, by: Sequence[str] = ("batch_name",)) -> DataFrame:
    """Per order: jobs by status, pending ones, earliest expiration of the ready, their bytes."""
    status = F.coalesce(F.col("status_code"), F.lit("?"))
    ready = status == "SUCCEEDED"
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(ready).alias("n_succeeded"),
        F.count_if(status.isin("PENDING", "RUNNING")).alias("n_pending"),
        F.count_if(status == "FAILED").alias("n_failed"),
        F.min(F.when(ready, F.col("expiration_time"))).alias("first_expiration"),
        F.coalesce(F.sum(F.when(ready, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
    )


def match_jobs(manifest_jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """Status responses of the jobs of an order, by order name and job id."""
    return manifest_jobs.join(responses, ["batch_name", "job_id"], "inner")


def sar_power(obs: DataFrame, pols: Sequence[str] = ("VH", "VV"), clamp: bool = False) -> DataFrame:
    """Columns per polarisation to long rows (…, pol, value); zero power is no data.

    Power is clamped to its physical range only on demand.
    """
    cells = []
    for p in pols:
        v = rad.nodata_to_null(F.col(p.lower()))
        if clamp:
            v = rad.clamp_physical(p, v, dims.RADAR_LIMITS)
        cells.append(F.struct(F.lit(p).alias("pol"), v.alias("value")))
    drop = [p.lower() for p in ("VH", "VV")]
    keep = [c for c in obs.columns if c not in drop]
    return obs.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.pol", "_c.value")


def sar_amplitude(values: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Seasonal amplitude of power per polarisation and track: another track has another view angle."""
    return seasonal_amplitude(values, keys=keys, product=("pol", "track"), **options)


def pair_polarizations(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long power rows to (keys, vh, vv), only where both exist: one shuffle, no self-join."""
    return (
        values.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("pol") == "VH", F.col("value"))).alias("vh"),
            F.max(F.when(F.col("pol") == "VV", F.col("value"))).alias("vv"),
            F.count_if(F.col("pol") == "VH").alias("_nh"),
            F.count_if(F.col("pol") == "VV").alias("_nv"),
        )
        .where((F.col("_nh") > 0) & (F.col("_nv") > 0))
        .drop("_nh", "_nv")
    )


def rvi_amplitude(obs: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Amplitude of the dual-pol vegetation index of rows that hold vh and vv of one time stamp.

    Sources with one row per polarisation go through :func:`pair_polarizations` first.
    """
    vh, vv = rad.nodata_to_null(F.col("vh")), rad.nodata_to_null(F.col("vv"))
    rvi = obs.withColumns({"pol": F.lit("RVI"), "value": rvi_dual_pol(vh, vv)})
    return sar_amplitude(rvi, keys, **options)
