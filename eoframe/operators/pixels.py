"""Per-pixel work: one narrow stage from band numbers to masked index values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import indices as ix
from eoframe.functions import radiometry as rad
from eoframe.session import compiled_apart

SPECTRAL = ("blue", "green", "red", "rededge1", "rededge3", "nir", "nir08", "swir16", "swir22")


def _bands_of(names: Sequence[str]) -> list[str]:
    wanted = {b for n in names for b in dims.INDEX_BANDS[n]}
    return [b for b in SPECTRAL if b in wanted]


def _optional(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def reflectance(pixels: DataFrame, bands: Sequence[str] = SPECTRAL) -> DataFrame:
    """Replace digital numbers by reflectance in the given band columns.

    Columns ``scale``, ``offset`` and ``boa_applied`` are used when present.
    """
    facts = pixels.withColumns(
        {
            "_ls": F.col("family") == "ls",
            "_shift": rad.boa_shift(F.col("baseline"), _optional(pixels, "boa_applied")),
        }
    )
    scale, offset = _optional(pixels, "scale"), _optional(pixels, "offset")
    return facts.withColumns(
        {b: rad.scaled(F.col(b), F.col("_ls"), F.col("_shift"), scale, offset) for b in bands}
    ).drop("_ls", "_shift")


def index_columns(pixels: DataFrame, names: Sequence[str], prefix: str = "raw_") -> DataFrame:
    """Raw index values next to the pixel columns (wide, no extra rows)."""
    bands = _bands_of(names)
    refl = reflectance(pixels, bands)
    band = {b: F.col(b) for b in bands}
    platform = F.col("platform") if "platform" in pixels.columns else F.lit("")
    group_no = F.col("_group_no")
    if any(n.startswith("TC") for n in names):
        group = F.col("tc_group") if "tc_group" in pixels.columns else ix.tc_group(platform, F.col("family"))
        # a column of its own, so that the pattern is matched once per row
        refl = refl.withColumn("_group", group).withColumn("_group_no", ix.group_number(F.col("_group")))
    values = {f"{prefix}{n}": ix.index_value(n, band, group_no) for n in names}
    return compiled_apart(refl).withColumns(values).drop("_group", "_group_no")


def compute_indices(
    pixels: DataFrame, names: Sequence[str], keep: Sequence[str] = ("grid", "px_col", "px_row", "scene_id", "acquired")
) -> DataFrame:
    """Long table (keep…, index, raw, value): formula, then range, then mask.

    ``raw`` is the finite formula value, ``value`` is NULL when outside the
    physical range or masked.  Red-edge indices give no rows for Landsat.
    The whole operator is one narrow stage, and only the bands of the wanted
    indices are read.  Range and mask are applied before the rows are spread,
    where an index is a column: no row compares its index with names.
    """
    has_quality = "scl" in pixels.columns and "qa_pixel" in pixels.columns
    masked = rad.invalid_pixel(F.col("family"), F.col("scl"), F.col("qa_pixel"))
    flagged = pixels.withColumn("_bad", masked if has_quality else F.lit(False))
    wide = index_columns(compiled_apart(flagged), names)
    valued = wide.select(
        *keep,
        (F.col("family") != "ls").alias("_red_edge"),
        F.lit(True).alias("_always"),
        *[f"raw_{n}" for n in names],
        *[F.when(~F.col("_bad"), rad.clamp_physical(n, F.col(f"raw_{n}"))).alias(f"value_{n}") for n in names],
    )
    triples = ", ".join(
        f"(raw_{n}, value_{n}, {'_red_edge' if n in dims.S2_ONLY else '_always'}) AS `{n}`" for n in names
    )
    # the method for columns has no place for two values a row, the statement has
    long = pixels.sparkSession.sql(
        f"SELECT * FROM {{wide}} UNPIVOT INCLUDE NULLS ((raw, value, _here) FOR index IN ({triples}))",
        wide=compiled_apart(valued),
    )
    return long.where("_here").select(*keep, "index", "raw", "value")


def within_range(index: Column, raw: Column) -> Column:
    """Is a value inside the physical range of the index named in the row?  Unlimited ones always are."""
    ok = ~index.isin(*dims.INDEX_LIMITS)
    for bounds in dict.fromkeys(dims.INDEX_LIMITS.values()):
        names = [n for n, b in dims.INDEX_LIMITS.items() if b == bounds]
        ok = ok | (index.isin(*names) & raw.between(*bounds))
    return ok


def clamp_report(values: DataFrame) -> DataFrame:
    """Per index: finite values, how many lie outside the range, and their share."""
    outside = ~within_range(F.col("index"), F.col("raw"))
    return (
        values.groupBy("index")
        .agg(
            F.count("raw").alias("n_finite"),
            F.count_if(F.coalesce(outside, F.lit(False))).alias("n_outside"),
        )
        .withColumn("pct_outside", F.try_divide(F.col("n_outside") * 100.0, F.col("n_finite")))
    )


def aoi_cloud(pixels: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Per scene: cloud share of the pixels with data, and the share with data.

    NULL means not measurable (no pixel with data); counting combines before
    the shuffle, so a large scene is no problem.
    """
    fam, scl, qa = F.col("family"), F.col("scl"), F.col("qa_pixel")
    empty = F.coalesce(rad.quality_no_data(fam, scl, qa), F.lit(True))
    cloudy = F.coalesce(rad.quality_cloudy(fam, scl, qa), F.lit(False))
    return (
        pixels.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(~empty).alias("n_valid"),
            F.count_if(cloudy & ~empty).alias("n_cloudy"),
        )
        .select(
            *by,
            "n_total",
            "n_valid",
            F.try_divide(F.col("n_cloudy") * 100.0, F.col("n_valid")).alias("aoi_cloud_pct"),
            F.try_divide(F.col("n_valid") * 100.0, F.col("n_total")).alias("data_pct"),
        )
    )


def radiometry_labels(bands: DataFrame, by: Sequence[str]) -> DataFrame:
    """The distinct labels per ``by`` (a scene, a band of it, ...): ``by`` and ``source``.

    ``bands`` has family, baseline and, where known, boa_applied, scale, offset.
    """
    source = rad.radiometry_source(
        F.col("family"), F.col("baseline"), _optional(bands, "boa_applied"), _optional(bands, "scale"), _optional(bands, "offset")
    )
    return bands.select(*by, source.alias("source")).distinct()


def radiometry_summary(bands: DataFrame, by: Sequence[str]) -> DataFrame:
    """One text per product: all scales declared, or which fallbacks were used.

    Labels are made distinct before they are listed.  Declared ones, which may
    be many, are only counted; a product's fallbacks are as few as its baselines.
    """
    declared = F.col("source").startswith("raster:bands")
    return (
        radiometry_labels(bands, by)
        .groupBy(*by)
        .agg(
            F.bool_and(declared).alias("_all"),
            F.array_sort(F.collect_set(F.when(~declared, F.col("source")))).alias("_fallbacks"),
        )
        .select(
            *by,
            F.when(F.col("_all"), F.lit("raster:bands (escala y desplazamiento del catálogo)"))
            .otherwise(F.concat(F.lit("mixta — alguna banda usó respaldo: "), F.array_join("_fallbacks", "; ")))
            .alias("radiometry"),
        )
    )


def composite(pixels: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """The three bands of an RGB composite as columns r, g, b."""
    bands = dict(dims.COMPOSITES)[name]
    return pixels.select(*keep, *[F.col(b).alias(c) for b, c in zip(bands, ("r", "g", "b"))])


def stack_bands(bands: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long band rows (keys, band, value) to one row per pixel position; only complete ones.

    One shuffle for any number of bands; the listed names keep Spark from a
    first pass to find them.
    """
    wide = bands.groupBy(*keys).agg(
        *[F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names]
    )
    present = F.lit(True)
    for n in names:
        present = present & F.col(n).isNotNull()
    return wide.where(present)


def mask_with(values: DataFrame, mask: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Null the values whose mask row says invalid; no mask table or row means unmasked."""
    if mask is None:
        return values
    marked = values.join(mask.select(*keys, F.col("invalid").alias("_bad")), list(keys), "left")
    kept = F.when(~F.coalesce(F.col("_bad"), F.lit(False)), F.col("value"))
    return marked.withColumn("value", kept).drop("_bad")
