"""Index statistics: distributions, stretches, seasonal amplitude, burn severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.operators.ranks import HOT_FLOOR, HOT_SHARE, bucket_of, exact_quantiles, find_hot, halfway, split_hot
from eoframe.session import stable

# Rows of the seasonal grouping that one task takes.
TASK_ROWS = 1_000_000


def season_of(month: Column, dry: Sequence[int], wet: Sequence[int]) -> Column:
    """'dry', 'wet' or NULL; a month listed in both counts as dry."""
    return F.when(month.isin(*dry), F.lit("dry")).when(month.isin(*wet), F.lit("wet"))


def index_distribution(values: DataFrame, by: Sequence[str] = ("index", "scene_id")) -> DataFrame:
    """Count, share of valid values and seven order statistics per index and scene."""
    q = exact_quantiles(values, by, "value", (0.02, 0.25, 0.5, 0.75, 0.98))
    return q.select(
        *by,
        F.col("n_valid").alias("n"),
        F.col("n_total").alias("total"),
        F.try_divide(F.col("n_valid") * 100.0, F.col("n_total")).alias("pct"),
        F.col("v_min").alias("min"),
        F.col("q0").alias("p2"),
        F.col("q1").alias("p25"),
        F.col("q2").alias("median"),
        F.col("q3").alias("p75"),
        F.col("q4").alias("p98"),
        F.col("v_max").alias("max"),
    )


def stretch_cuts(
    bands: DataFrame, by: Sequence[str] = ("band",), low: float = 2, high: float = 98, min_valid: int = 100
) -> DataFrame:
    """Display cuts per band over values above zero.

    Fewer than ``min_valid`` values give (0, 10000); equal cuts fall back to
    min and max, and then to a width of one.
    """
    shown = bands.withColumn("_shown", F.when(F.col("value") > 0, F.col("value")))
    q = exact_quantiles(shown, by, "_shown", (low / 100.0, high / 100.0))
    flat = F.col("q1") <= F.col("q0")
    lo = F.when(flat, F.col("v_min")).otherwise(F.col("q0"))
    hi = F.when(flat, F.greatest(F.col("v_max"), F.when(F.col("v_max") <= F.col("v_min"), F.col("v_min") + 1)))
    hi = hi.otherwise(F.col("q1"))
    few = F.col("n_valid") < min_valid
    return q.select(
        *by,
        F.col("n_valid"),
        F.when(few, F.lit(0.0)).otherwise(lo).alias("cut_lo"),
        F.when(few, F.lit(10000.0)).otherwise(hi).alias("cut_hi"),
    )


def rescale_byte(v: Column, lo: Column, hi: Column) -> Column:
    """Linear map of [lo, hi] to 1..255; values outside saturate, NULL becomes 0."""
    scaled = F.lit(1.0) + F.try_divide((v - lo) * 254.0, hi - lo)
    return F.coalesce(F.round(F.greatest(F.lit(1.0), F.least(F.lit(255.0), scaled))), F.lit(0.0)).cast("int")


def display_limits(
    values: DataFrame,
    by: Sequence[str],
    method: str = "sigma",
    n_sigma: float = 2.0,
    fixed: tuple[float, float] | None = None,
) -> DataFrame:
    """Limits for display: fixed ones win, then mean ± n·σ if σ > 0, else min and max.

    σ is the sample standard deviation.
    """
    if fixed is not None:
        return values.select(*by).distinct().select(
            *by, F.lit(float(fixed[0])).alias("lo"), F.lit(float(fixed[1])).alias("hi")
        )
    stats = values.groupBy(*by).agg(
        F.avg("value").alias("_m"),
        F.stddev_samp("value").alias("_s"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
    )
    use = F.coalesce(F.col("_s") > 0, F.lit(False)) & F.lit(method == "sigma")
    return stats.select(
        *by,
        F.when(use, F.col("_m") - n_sigma * F.col("_s")).otherwise(F.col("_lo")).alias("lo"),
        F.when(use, F.col("_m") + n_sigma * F.col("_s")).otherwise(F.col("_hi")).alias("hi"),
    )


def middle_of_sorted(values: Column) -> Column:
    """Median of a sorted array without NULLs, as :func:`ranks.exact_quantiles` has it with ``halves``; NULL for an empty one."""
    n = F.size(values)
    lower = F.get(values, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(values, F.floor(n / 2).cast("int"))
    return halfway(lower, upper)


def seasonal_amplitude(
    values: DataFrame,
    keys: Sequence[str] = ("index", "grid", "px_col", "px_row"),
    dry: Sequence[int] = dims.DRY_MONTHS,
    wet: Sequence[int] = dims.WET_MONTHS,
    min_obs: int = dims.MIN_OBS,
    product: Sequence[str] = ("index",),
    hot_floor: int = HOT_FLOOR,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Median of the dry season minus median of the wet one, per pixel.

    ``values`` has ``keys``, ``month`` and ``value``.  Result: keys, n_dry,
    n_wet, med_dry, med_wet, amplitude; medians and amplitude are NULL unless
    both seasons reach ``min_obs``.  A product (index, or track and
    polarisation) without a single row in one season is left out.

    Both seasons are conditional aggregates of one grouping: one shuffle.  A
    pixel's dates fit a task; keys with too many rows take the split path.  A
    pass over the key columns, made when the run is planned, counts rows by hash
    bucket: it tells whether there are such keys, and how many tasks keep a
    task's rows below ``TASK_ROWS``.
    """
    keys, product = list(keys), list(product)
    seasoned = values.select(
        *keys, season_of(F.col("month"), dry, wet).alias("season"), "value"
    ).where(F.col("season").isNotNull())
    is_dry, is_wet = F.col("season") == "dry", F.col("season") == "wet"
    sizes = stable(
        seasoned.groupBy(*product, bucket_of(keys).alias("_h")).agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(is_dry).alias("_d"), F.count_if(is_wet).alias("_w")
        )
    )
    rows, hot_ones = find_hot(seasoned, keys, sizes, hot_floor, hot_share)
    cold, hot = (seasoned, None) if hot_ones is None else split_hot(seasoned, keys, hot_ones)
    # no row is saved by combining a pixel's dates before the shuffle, so the rows
    # move once and are listed where they arrive; the split bounds each list
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    # a key that tells pixels apart comes first: the rows of a task are sorted by it
    order = [*[k for k in keys if k not in product], *[k for k in keys if k in product]]
    flagged = cold.select(*order, is_dry.alias("_is_dry"), "value")
    listed = (
        flagged.repartition(tasks, *order)
        .groupBy(*order)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_is_dry"), F.col("value")))).alias("_dry"),
            F.sort_array(F.collect_list(F.when(~F.col("_is_dry"), F.col("value")))).alias("_wet"),
        )
    )
    per_pixel = listed.select(
        *keys,
        F.size("_dry").cast("bigint").alias("n_dry"),
        F.size("_wet").cast("bigint").alias("n_wet"),
        middle_of_sorted(F.col("_dry")).alias("med_dry"),
        middle_of_sorted(F.col("_wet")).alias("med_wet"),
    )
    pixels = per_pixel if hot is None else per_pixel.unionByName(_split_seasons(hot, keys))
    # products come from a closed vocabulary (11 indices, 175 tracks, 3 polarisations)
    void = (
        sizes.groupBy(*product)
        .agg(F.sum("_d").alias("_d"), F.sum("_w").alias("_w"))
        .where((F.col("_d") == 0) | (F.col("_w") == 0))
        .select(*product)
    )
    enough = (F.col("n_dry") >= min_obs) & (F.col("n_wet") >= min_obs)
    return pixels.join(F.broadcast(void), product, "left_anti").select(
        *keys,
        "n_dry",
        "n_wet",
        F.when(enough, F.col("med_dry")).alias("med_dry"),
        F.when(enough, F.col("med_wet")).alias("med_wet"),
        F.when(enough, F.col("med_dry") - F.col("med_wet")).alias("amplitude"),
    )


def _split_seasons(hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_dry, n_wet, med_dry, med_wet of keys with too many rows for a list."""
    is_dry, is_wet = F.col("season") == "dry", F.col("season") == "wet"
    # hot keys are at most 1 / hot_share, so their list of buckets is short
    by_season = exact_quantiles(hot, [*keys, "season"], "value", (0.5,), few_groups=True, halves=True)
    return by_season.groupBy(*keys).agg(
        *[
            agg.alias(name)
            for s, flag in (("dry", is_dry), ("wet", is_wet))
            for agg, name in (
                (F.coalesce(F.sum(F.when(flag, F.col("n_valid"))), F.lit(0)), f"n_{s}"),
                (F.max(F.when(flag, F.col("q0"))), f"med_{s}"),
            )
        ]
    )


def observation_summary(amplitude: DataFrame, by: Sequence[str] = ("index",)) -> DataFrame:
    """Min, max, median of the observation counts; pixels dropped and their share.

    Counts collapse to (count, pixels) pairs before the median: a group then
    holds as many rows as there are different counts.
    """
    long = amplitude.select(
        *by,
        F.col("amplitude").isNull().alias("_void"),
        F.explode(
            F.array(
                F.struct(F.lit("dry").alias("season"), F.col("n_dry").alias("n")),
                F.struct(F.lit("wet").alias("season"), F.col("n_wet").alias("n")),
            )
        ).alias("c"),
    )
    pairs = long.groupBy(*by, "c.season", "c.n").agg(
        F.count(F.lit(1)).alias("w"), F.count_if("_void").alias("dropped")
    )
    is_dry, is_wet = F.col("season") == "dry", F.col("season") == "wet"
    return (
        pairs.groupBy(*by)
        .agg(
            *[
                fn(F.when(flag, F.col("n"))).alias(f"{name}_{s}")
                for s, flag in (("dry", is_dry), ("wet", is_wet))
                for name, fn in (("min", F.min), ("max", F.max))
            ],
            F.percentile(F.when(is_dry, F.col("n")), 0.5, F.when(is_dry, F.col("w")).otherwise(1)).alias("med_dry"),
            F.percentile(F.when(is_wet, F.col("n")), 0.5, F.when(is_wet, F.col("w")).otherwise(1)).alias("med_wet"),
            F.sum(F.when(is_dry, F.col("w"))).alias("pixels"),
            F.sum(F.when(is_dry, F.col("dropped"))).alias("n_dropped"),
        )
        .withColumn("pct_dropped", F.try_divide(F.col("n_dropped") * 100.0, F.col("pixels")))
    )


def empty_product_cause(
    amplitude: DataFrame, min_obs: int = dims.MIN_OBS, by: Sequence[str] = ("index",)
) -> DataFrame:
    """Why a product has no pixel: 'no_observations', 'below_min_obs', 'no_overlap', or NULL."""
    cause = (
        F.when(F.col("n_valid") > 0, F.lit(None).cast("string"))
        .when((F.col("max_dry") == 0) | (F.col("max_wet") == 0), F.lit("no_observations"))
        .when((F.col("max_dry") < min_obs) | (F.col("max_wet") < min_obs), F.lit("below_min_obs"))
        .otherwise(F.lit("no_overlap"))
    )
    return (
        amplitude.groupBy(*by)
        .agg(
            F.max("n_dry").alias("max_dry"),
            F.max("n_wet").alias("max_wet"),
            F.count("amplitude").alias("n_valid"),
        )
        .withColumn("cause", cause)
    )


def orphan_months(values: DataFrame, dry: Sequence[int], wet: Sequence[int]) -> DataFrame:
    """Months present in the data and in neither season."""
    return values.select("month").distinct().where(~F.col("month").isin(*dry, *wet))


def product_summary(products: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Min, max, median and share of valid pixels per product.

    The quantiles read their rows twice, so the products are worked out once and kept.
    """
    q = exact_quantiles(stable(products.select(*by, value)), by, value, (0.5,))
    return q.select(
        *by,
        F.col("v_min").alias("min"),
        F.col("v_max").alias("max"),
        F.col("q0").alias("median"),
        F.try_divide(F.col("n_valid") * 100.0, F.col("n_total")).alias("pct_valid"),
    )


def scenes_used(
    scenes: DataFrame, dry: Sequence[int] = dims.DRY_MONTHS, wet: Sequence[int] = dims.WET_MONTHS
) -> DataFrame:
    """Distinct dates per season and their comma list; the calendar bounds the list."""
    season = season_of(F.col("month"), dry, wet)
    return (
        scenes.select(season.alias("season"), F.col("acquired").cast("string").alias("d"))
        .where("season IS NOT NULL")
        .distinct()
        .groupBy("season")
        .agg(F.count(F.lit(1)).alias("n_dates"), F.array_join(F.array_sort(F.collect_list("d")), ", ").alias("dates"))
    )


# ---------------------------------------------------------------- burn severity


def pick_fire_scenes(
    scenes: DataFrame, fire_date: str, assessment: str = "inicial", by: Sequence[str] = ()
) -> DataFrame:
    """Scene before and after a fire, per group: an as-of pick by two aggregates.

    Before: the last date earlier than the fire.  After: the first later one,
    or for 'extendida' the one closest to a year after (the earlier on a tie).
    A scene of the day itself is on neither side.  Always one row per group;
    ``reason`` says why a side is missing.
    """
    if assessment not in ("inicial", "extendida"):
        assessment = "inicial"
    by = list(by)
    day = F.to_date(F.lit(fire_date))
    d = F.col("acquired")
    after = F.when(d > day, d)
    if assessment == "extendida":
        gap = F.abs(F.datediff(d, F.date_add(day, 365)))
        post = F.min(F.when(d > day, F.struct(gap.alias("gap"), d.alias("d")))).getField("d")
    else:
        post = F.min(after)
    grouped = scenes.groupBy(*by) if by else scenes.groupBy()
    out = grouped.agg(F.max(F.when(d < day, d)).alias("_pre"), post.alias("_post"))
    both = F.col("_pre").isNotNull() & F.col("_post").isNotNull()
    days = F.datediff(F.col("_post"), day)
    return out.select(
        *by,
        F.when(both, F.col("_pre")).alias("pre"),
        F.when(both, F.col("_post")).alias("post"),
        F.when(both, F.datediff(day, F.col("_pre"))).alias("days_before"),
        F.when(both, days).alias("days_after"),
        F.when(F.col("_pre").isNull(), F.lit("no_scene_before"))
        .when(F.col("_post").isNull(), F.lit("no_scene_after"))
        .otherwise(F.lit(""))
        .alias("reason"),
        F.coalesce(both & F.lit(assessment == "extendida") & (days < 180), F.lit(False)).alias("looks_initial"),
    )


def dnbr(
    nbr: DataFrame, picks: DataFrame, pixel: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """NBR before minus NBR after, per pixel; a burn is positive, NULL if a side is missing.

    Both dates come from one scan: rows of the two dates are kept by a join
    with the picks (one row per group) and paired by one grouping.  Two NBR
    values of one pixel and date are averaged.
    """
    by, pixel = list(by), list(pixel)
    if by:
        dated = nbr.join(picks.select(*by, "pre", "post").where("pre IS NOT NULL"), by)
    else:  # one pick: its dates are scalars
        dated = nbr.withColumns({c: picks.select(c).scalar() for c in ("pre", "post")})
    before = F.col("acquired") == F.col("pre")
    after = F.col("acquired") == F.col("post")
    return (
        dated.where(before | after)
        .groupBy(*dict.fromkeys([*by, *pixel]))
        .agg(
            F.avg(F.when(before, F.col("value"))).alias("pre_value"),
            F.avg(F.when(after, F.col("value"))).alias("post_value"),
        )
        .withColumn("dnbr", F.col("pre_value") - F.col("post_value"))
    )


def class_of(v: Column, classes) -> Column:
    """Number (from 1) of the half-open class that holds ``v``, as a CASE: no join."""
    out = None
    for i, c in enumerate(classes, start=1):
        lo, hi = c[1], c[2]
        test = v < F.lit(hi) if lo is None else v >= F.lit(lo)
        if lo is not None and hi is not None:
            test = test & (v < F.lit(hi))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out


def class_table_counts(values: DataFrame, value: str, classes, pixel_area_m2: float | None = None) -> DataFrame:
    """All classes with pixels, share of the valid pixels and hectares; empty classes too."""
    counted = (
        values.where(F.col(value).isNotNull())
        .groupBy(class_of(F.col(value), classes).alias("class_no"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    table = dims.class_table(values.sparkSession, classes)
    n = F.coalesce(F.col("n"), F.lit(0))
    total = F.sum(n).over(Window.partitionBy())  # as many rows as classes
    area = F.lit(float(pixel_area_m2)) if pixel_area_m2 else F.lit(None).cast("double")
    return table.join(counted, "class_no", "left").select(
        "class_no",
        "class",
        "lo",
        "hi",
        n.alias("n"),
        F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)).alias("pct"),
        (n * area / 10000.0).alias("hectares"),
    )


def dnbr_classes(values: DataFrame, pixel_area_m2: float | None = None, value: str = "dnbr") -> DataFrame:
    """The five burn-severity classes."""
    return class_table_counts(values, value, dims.DNBR_CLASSES, pixel_area_m2)


def ndvi_classes(values: DataFrame, value: str = "value") -> DataFrame:
    """The six NDVI orientation ranges with their usual misreading."""
    ndvi = values.where(F.col("index") == "NDVI") if "index" in values.columns else values
    counts = class_table_counts(ndvi, value, dims.NDVI_CLASSES)
    note = F.element_at(F.array(*[F.lit(c[3]) for c in dims.NDVI_CLASSES]), F.col("class_no"))
    return counts.drop("hectares").withColumn("also_read_as", note)


def dnbr_run_record(picks: DataFrame, fire_date: str, assessment: str, product: str) -> DataFrame:
    """What went into a burn product: dates, days before and after, convention."""
    return picks.select(
        *[c for c in picks.columns if c in ("grid_no", "grid")],
        F.lit(fire_date).alias("fire_date"),
        F.lit(assessment).alias("assessment"),
        "pre",
        "days_before",
        "post",
        "days_after",
        F.lit(product).alias("product"),
    )
