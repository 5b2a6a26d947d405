"""Report tables, time-line coverage and the audit of exported map documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions.text import iso_timestamp


def timestamp_coverage(rows: DataFrame, column: str) -> DataFrame:
    """How many values of a date column normalise to ISO and how many do not."""
    iso = iso_timestamp(F.col(column).cast("string"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(iso).alias("n_usable"), F.count_if(iso.isNull()).alias("n_unusable")
    )


# White space as text splitting sees it, and the coordinates element
_NOT_BLANK = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
_COORDINATES = r"(?s)<coordinates[^>]*>(.*?)</coordinates>"


def vertex_count(kml: Column) -> Column:
    """Coordinate tuples inside <coordinates> elements; a cut-off element counts nothing."""
    blocks = F.regexp_extract_all(kml, F.lit(_COORDINATES), F.lit(1))
    counts = F.transform(blocks, lambda b: F.regexp_count(b, F.lit(_NOT_BLANK)).cast("bigint"))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n)


def kml_audit(docs: DataFrame, text: str = "kml") -> DataFrame:
    """Features, overlays and vertices per document, and the limits they pass.

    Whole texts are read; all of it is JVM-side and row by row, without a shuffle.
    """
    k = F.col(text)
    return docs.withColumns(
        {
            "n_placemarks": F.regexp_count(k, F.lit("<Placemark")).cast("bigint"),
            "n_overlays": F.regexp_count(k, F.lit("<GroundOverlay")).cast("bigint"),
            "n_vertices": vertex_count(k),
        }
    ).withColumns(
        {
            "too_many_features": F.col("n_placemarks") > dims.KML_MAX_FEATURES,
            "too_many_vertices": F.col("n_vertices") > dims.KML_MAX_VERTICES,
        }
    )


def product_inventory(products: DataFrame) -> DataFrame:
    """Six columns per written product; what is missing reads '—'."""
    def shown(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))

    return products.select(*[shown(c).alias(c) for c in ("file", "product", "dates", "sensor", "mask", "radiometry")])


def guide_rows(rows: DataFrame, index: str = "index") -> DataFrame:
    """Guide entries of the indices present, in canonical order; AMPL_x counts as x."""
    present = rows.select(F.regexp_replace(F.col(index), "^AMPL_", "").alias("index")).distinct()
    return dims.guide_table(rows.sparkSession).join(present, "index", "left_semi").orderBy("pos")
