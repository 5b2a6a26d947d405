"""Digital numbers to reflectance, quality masks, physical range.

NULL is no-data everywhere: NaN sorts above every number in Spark and would
poison max and percentiles, NULL is skipped by aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eoframe import dims


def finite(v: Column) -> Column:
    """NaN and infinities become NULL."""
    v = v.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def nodata_to_null(v: Column, nodata: Column | None = None) -> Column:
    """Declared no-data value, else exact zero (impossible radar power), becomes NULL."""
    v = finite(v)
    declared = F.lit(0.0) if nodata is None else F.coalesce(nodata.cast("double"), F.lit(0.0))
    return F.nullif(v, declared)


def to_reflectance(
    dn: Column,
    family: Column,
    baseline: Column,
    boa_applied: Column | None = None,
    scale: Column | None = None,
    offset: Column | None = None,
) -> Column:
    """Surface reflectance; a declared scale wins, then the constants of the family.

    Baselines compare as text; an empty one means no offset.  Negative
    reflectance is kept on purpose.
    """
    return scaled(dn, family == "ls", boa_shift(baseline, boa_applied), scale, offset)


def boa_shift(baseline: Column, boa_applied: Column | None = None) -> Column:
    """Additive shift of the newer Sentinel-2 baselines, zero otherwise."""
    shifted = baseline >= F.lit(dims.S2_BASELINE_WITH_OFFSET)
    if boa_applied is not None:
        shifted = shifted & ~F.coalesce(boa_applied, F.lit(False))
    return F.when(shifted, F.lit(dims.S2_BOA_OFFSET)).otherwise(F.lit(0.0))


def scaled(
    dn: Column, is_landsat: Column, shift: Column, scale: Column | None = None, offset: Column | None = None
) -> Column:
    """Reflectance from facts of the scene that are worked out once per row."""
    dn = dn.cast("double")
    landsat = dn * F.lit(dims.LANDSAT_SCALE) + F.lit(dims.LANDSAT_OFFSET)
    by_family = F.when(is_landsat, landsat).otherwise((dn + shift) / F.lit(dims.S2_DIVISOR))
    if scale is None:
        return by_family
    off = F.lit(0.0) if offset is None else F.coalesce(offset, F.lit(0.0))
    return F.when(scale.isNotNull(), dn * scale + off).otherwise(by_family)


def short_number(v: Column) -> Column:
    """A double in at most six significant digits without trailing zeros: 0.0001, 2.75e-05, 1e+06, 10000."""
    digits = F.format_string("%.5e", v)
    exponent = F.regexp_extract(digits, "e(.*)$", 1).cast("int")
    trailing = r"\.?0+$"
    plain = F.regexp_replace(digits.cast("decimal(38,12)").cast("decimal(38,9)").cast("string"), trailing, "")
    powers = F.concat(F.regexp_replace(F.substring_index(digits, "e", 1), trailing, ""), F.regexp_extract(digits, "e.*$", 0))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(exponent.between(-4, 5), plain).otherwise(powers)


def radiometry_source(
    family: Column,
    baseline: Column,
    boa_applied: Column | None = None,
    scale: Column | None = None,
    offset: Column | None = None,
) -> Column:
    """Where the scale of a band came from, as a label; a declared one is shown with its numbers."""
    shifted = F.coalesce(baseline >= F.lit(dims.S2_BASELINE_WITH_OFFSET), F.lit(False))
    if boa_applied is not None:
        shifted = shifted & ~F.coalesce(boa_applied, F.lit(False))
    known = F.coalesce(F.nullif(baseline, F.lit("")), F.lit("desconocida"))
    s2 = F.concat(
        F.lit("inferencia por línea base '"),
        known,
        F.lit("'"),
        F.when(shifted, F.lit(" con desplazamiento BOA")).otherwise(F.lit("")),
    )
    landsat = F.concat(
        F.lit("constantes internas Landsat C2 ("), short_number(F.lit(dims.LANDSAT_SCALE)), F.lit(", "),
        short_number(F.lit(dims.LANDSAT_OFFSET)), F.lit(")"),
    )
    fallback = F.when(family == "ls", landsat).otherwise(s2)
    if scale is None:
        return fallback
    added = F.lit(0.0) if offset is None else F.coalesce(offset, F.lit(0.0))
    declared = F.concat(
        F.lit("raster:bands (escala "), short_number(scale), F.lit(", desplazamiento "), short_number(added), F.lit(")")
    )
    return F.when(scale.isNotNull(), declared).otherwise(fallback)


def scl_no_data(scl: Column) -> Column:
    return scl.isin(*dims.SCL_NO_DATA)


def scl_cloudy(scl: Column) -> Column:
    """Cloud, cirrus and cloud shadow; shadow ruins an index just as well."""
    return scl.isin(*dims.SCL_CLOUDY)


def qa_no_data(qa: Column) -> Column:
    return qa.bitwiseAND(F.lit(dims.QA_FILL_MASK)) != 0


def qa_cloudy(qa: Column) -> Column:
    """Any of the bits dilated cloud, cirrus, cloud, shadow."""
    return qa.bitwiseAND(F.lit(dims.QA_CLOUD_MASK)) != 0


def quality_no_data(family: Column, scl: Column, qa: Column) -> Column:
    return F.when(family == "ls", qa_no_data(qa)).otherwise(scl_no_data(scl))


def quality_cloudy(family: Column, scl: Column, qa: Column) -> Column:
    return F.when(family == "ls", qa_cloudy(qa)).otherwise(scl_cloudy(scl))


def invalid_pixel(family: Column, scl: Column, qa: Column) -> Column:
    """No data or cloudy; a missing quality value leaves the pixel unmasked."""
    bad = quality_no_data(family, scl, qa) | quality_cloudy(family, scl, qa)
    return F.coalesce(bad, F.lit(False))


def clamp_physical(index: str, v: Column, limits: dict | None = None) -> Column:
    """Outside the physical range a value is dropped, not clipped; bounds belong to it."""
    bounds = (limits or dims.INDEX_LIMITS).get(index)
    if bounds is None:
        return v
    return F.when(v.between(*bounds), v)
