"""Tasseled Cap coefficient sets as data: replacement, checks, warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions.indices import tc_group

GROUPS = tuple(dims.TC_COEFFICIENTS)


def override_tc_coefficients(user: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The built-in groups with the user's sets in their place, whole groups at a time.

    Groups outside the built-in ones are ignored; ``not_surface`` flags a
    user set that was not derived on surface reflectance.  ``by`` keeps
    several users' collections apart.
    """
    by = list(by)
    known = user.where(F.col("grp").isin(*GROUPS))
    if by:
        four = F.array(
            *[
                F.struct(
                    F.lit(g).alias("grp"),
                    F.lit(c["kind"]).alias("kind"),
                    *[F.array(*[F.lit(x) for x in c[v]]).alias(v.lower()) for v in "BGW"],
                )
                for g, c in dims.TC_COEFFICIENTS.items()
            ]
        )
        base = user.select(*by).distinct().select(*by, F.explode(four).alias("_s")).select(*by, "_s.*")
    else:
        base = dims.tc_table(user.sparkSession)
    mine = known.select(*by, "grp", *[F.col(c).alias(f"u_{c}") for c in ("kind", "b", "g", "w")], F.lit(True).alias("replaced"))
    joined = base.join(mine, [*by, "grp"], "left")
    replaced = F.coalesce(F.col("replaced"), F.lit(False))
    return joined.select(
        *by,
        "grp",
        *[F.when(replaced, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) for c in ("kind", "b", "g", "w")],
        replaced.alias("replaced"),
        (replaced & (F.lower(F.coalesce(F.col("u_kind"), F.lit(""))) != "superficie")).alias("not_surface"),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def validate_orthonormality(sets: DataFrame, tol: float = 0.02) -> DataFrame:
    """Adds err_norm, err_dot and ``valid`` for the vectors b, g, w of each set.

    A missing vector or different lengths make the set invalid; both errors
    must stay strictly below the tolerance.
    """
    b, g, w = F.col("b"), F.col("g"), F.col("w")
    norms = F.greatest(*[F.abs(F.sqrt(_dot(v, v)) - 1.0) for v in (b, g, w)])
    dots = F.greatest(*[F.abs(_dot(x, y)) for x, y in ((b, g), (b, w), (g, w))])
    complete = b.isNotNull() & g.isNotNull() & w.isNotNull()
    sound = complete & (F.size(b) == F.size(g)) & (F.size(g) == F.size(w))
    return sets.select(
        "*",
        F.when(sound, norms).alias("err_norm"),
        F.when(sound, dots).alias("err_dot"),
        F.coalesce(sound & (norms < tol) & (dots < tol), F.lit(False)).alias("valid"),
    )


def tasseled_cap_from(pixels: DataFrame, coefficients: DataFrame) -> DataFrame:
    """TCB, TCG and TCW of reflectance pixels from a coefficient table.

    The table has one row per sensor group, four at most, so it is broadcast; a
    group that comes twice is an error, as it would double its pixels.  A pixel whose satellite has no group keeps NULL components.
    """
    bands = F.array(*[F.col(c).cast("double") for c in dims.TC_BANDS])
    four = coefficients.where(F.col("grp").isin(*GROUPS)).select(
        F.col("grp").alias("tc_group"), F.col("b").alias("_b"), F.col("g").alias("_g"), F.col("w").alias("_w")
    )
    twice = F.count(F.lit(1)) > 1
    said = F.raise_error(F.concat(F.lit("coefficients come twice for "), F.col("tc_group"))).cast("array<double>")
    four = four.groupBy("tc_group").agg(F.when(twice, said).otherwise(F.first("_b")).alias("_b"), F.first("_g").alias("_g"), F.first("_w").alias("_w"))
    grouped = pixels if "tc_group" in pixels.columns else pixels.withColumn("tc_group", tc_group(F.col("platform"), F.col("family")))
    return (
        grouped.join(F.broadcast(four), "tc_group", "left")
        .withColumns({"TCB": _dot(F.col("_b"), bands), "TCG": _dot(F.col("_g"), bands), "TCW": _dot(F.col("_w"), bands)})
        .drop("_b", "_g", "_w")
    )


def tc_warnings(scenes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient groups in use: whether derived on TOA, and whether several mix.

    Groups are made distinct first; at most four rows per ``by`` remain.
    """
    by = list(by)
    toa = [g for g, c in dims.TC_COEFFICIENTS.items() if c["kind"] == "TOA"]
    used = (
        scenes.select(*by, tc_group(F.col("platform"), F.col("family")).alias("grp"))
        .where("grp IS NOT NULL")
        .distinct()
    )
    return used.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list("grp")), ",").alias("groups"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("grp").isin(*toa), F.col("grp")))), ",").alias("toa_groups"),
        (F.count(F.lit(1)) > 1).alias("mixed"),
    )
