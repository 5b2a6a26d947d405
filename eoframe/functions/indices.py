"""Spectral and radar index formulas on reflectance; division by zero gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eoframe import dims


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def savi(nir: Column, red: Column) -> Column:
    return F.try_divide(F.lit(1.5) * (nir - red), nir + red + F.lit(0.5))


def evi2(nir: Column, red: Column) -> Column:
    """Two-band enhanced vegetation index (Jiang et al. 2008)."""
    return F.try_divide(F.lit(2.5) * (nir - red), nir + F.lit(2.4) * red + F.lit(1.0))


def msi(swir16: Column, nir08: Column) -> Column:
    return F.try_divide(swir16, nir08)


def cire(rededge3: Column, rededge1: Column) -> Column:
    return F.try_divide(rededge3, rededge1) - F.lit(1.0)


def rvi_dual_pol(vh: Column, vv: Column) -> Column:
    """4·VH/(VV+VH) in power, only for a positive sum, inside its range."""
    total = vv + vh
    rvi = F.when(total > 0, F.try_divide(F.lit(4.0) * vh, total))
    return F.when(rvi.between(*dims.RADAR_LIMITS["RVI"]), rvi)


def tc_group(platform: Column, family: Column) -> Column:
    """Coefficient group of a satellite; an unknown Landsat has none."""
    digit = F.regexp_extract(F.lower(F.coalesce(platform, F.lit(""))), r"landsat[-_ ]?(\d)", 1)
    # looked up, not compared set by set: the pattern is matched once
    sets = {"4": "TM", "5": "TM", "7": "ETM", "8": "OLI", "9": "OLI"}
    landsat = F.try_element_at(F.create_map(*[F.lit(x) for pair in sets.items() for x in pair]), digit)
    return F.when(family == "ls", landsat).otherwise(F.lit("MSI"))


def linear_combination(coefficients: list[Column], bands: list[Column]) -> Column:
    """Sum of coefficient times band, in band order."""
    return reduce(lambda a, b: a + b, [c * x for c, x in zip(coefficients, bands)])


def group_number(group: Column) -> Column:
    """Position of a coefficient group in the built-in table, NULL when there is none."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(dims.TC_COEFFICIENTS):
        out = F.when(group == name, F.lit(i)).otherwise(out)
    return out


def tasseled_cap(component: str, number: Column, bands: list[Column]) -> Column:
    """Component of the built-in table by group number: no join, small generated code."""
    sets = dims.TC_COEFFICIENTS.values()
    picked = [F.get(F.array(*[F.lit(s[component][i]) for s in sets]), number) for i in range(len(bands))]
    return linear_combination(picked, bands)


def index_value(name: str, band: dict[str, Column], group_no: Column | None = None) -> Column:
    """Raw index by its suffix; ``band`` maps band key to reflectance."""
    args = [band[k] for k in dims.INDEX_BANDS[name]]
    if name in ("NDVI", "NDMI", "NBR", "NDRE"):
        return normalized_difference(*args)
    if name == "SAVI":
        return savi(*args)
    if name == "EVI2":
        return evi2(*args)
    if name == "MSI":
        return msi(*args)
    if name == "CIre":
        return cire(*args)
    return tasseled_cap(name[-1], group_no, args)
