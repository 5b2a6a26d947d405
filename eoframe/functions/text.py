"""Text columns: months, dates, names, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eoframe import dims


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _whole_number(token: Column) -> Column:
    """INT of a token written as a plain whole number, else NULL."""
    return F.when(token.rlike(r"^[+-]?\d{1,9}$"), token.try_cast("int"))


# ---------------------------------------------------------------------- months


def parse_months(text: Column) -> Column:
    """Months of a ',' or ';' list; one bad token empties the list, duplicates stay."""
    tokens = F.filter(F.transform(F.split(_text(text), "[,;]"), lambda x: F.trim(x)), lambda t: t != "")
    months = F.transform(tokens, _whole_number)
    sound = F.forall(months, lambda m: F.coalesce(m.between(1, 12), F.lit(False)))
    return F.when(sound, months).otherwise(F.array().cast("array<int>"))


def parse_months_lenient(text: Column, default: Sequence[int]) -> Column:
    """Months of a list split at ',', ';' or blanks; bad tokens are skipped, first mention counts."""
    months = F.transform(F.split(_text(text), r"[,;\s]+"), _whole_number)
    kept = F.array_distinct(F.filter(months, lambda m: m.between(1, 12)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(m) for m in default]))


def parse_limits(text: Column) -> Column:
    """STRUCT<lo, hi> of 'lo,hi' with hi strictly above lo, else NULL."""
    parts = F.transform(F.split(_text(text), "[,;]"), lambda x: F.trim(x))
    lo = F.get(parts, F.lit(0)).try_cast("double")
    hi = F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & (hi > lo), F.struct(lo.alias("lo"), hi.alias("hi")))


def _two(m: Column) -> Column:
    return F.lpad(m.cast("string"), 2, "0")


def month_code(months: Column) -> Column:
    """'12-04' for a run of months (over the year's end too), '01.03.07' otherwise.

    All twelve give '01-12', none 'NA'.
    """
    ms = F.array_sort(F.array_distinct(F.filter(months, lambda m: m.between(1, 12))))
    n = F.size(ms)
    starts = F.filter(ms, lambda m: ~F.array_contains(ms, (m + 10) % 12 + 1))
    first = F.get(starts, F.lit(0))
    last = (first + n - 2) % 12 + 1
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("NA"))
        .when(n == 12, F.lit("01-12"))
        .when(F.size(starts) == 1, F.concat(_two(first), F.lit("-"), _two(last)))
        .otherwise(F.array_join(F.transform(ms, _two), "."))
    )


def month_code_radar(months: Column) -> Column:
    """Sorted months written one after the other."""
    return F.array_join(F.transform(F.array_sort(months), _two), "")


# ----------------------------------------------------------------------- dates

def real_date(year: Column, month: Column, day: Column) -> Column:
    """DATE of three digit texts, NULL when the calendar has no such day."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def iso_timestamp(text: Column) -> Column:
    """ISO date or timestamp of a text, NULL if it is ambiguous or impossible.

    Fractions are dropped, a zone is kept and never invented.  Day, zone and
    clock are cut apart and judged one by one.
    """
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")  # any white space, not blanks alone
    date = F.translate(F.substring(t, 1, 10), "/", "-")
    parts = F.split(date, "-")
    lengths = F.transform(parts, F.length)
    day_ok = (lengths == F.array(F.lit(4), F.lit(2), F.lit(2))) & ~F.translate(date, "-", "").rlike(r"\D")
    day_ok = day_ok & real_date(*[F.get(parts, i) for i in range(3)]).isNotNull()
    rest = F.substring(t, F.lit(11), F.length(t))
    zone = F.regexp_extract(rest, r"(Z|[+-]\d\d:?\d\d)$", 1)
    clock = F.regexp_replace(F.substring(rest, F.lit(2), F.length(rest) - F.length(zone) - 1), r"\.\d+$", "")
    units = F.split(clock, ":")
    time_ok = F.substring(rest, 1, 1).isin("T", " ") & F.size(units).between(2, 3) & F.forall(units, lambda u: u.rlike(r"^\d\d\z"))
    time_ok = time_ok & (F.get(units, 0) <= "23") & (F.get(units, 1) <= "59") & F.coalesce(F.get(units, 2) <= "60", F.lit(True))
    full = F.concat(date, F.lit("T"), clock, F.when(F.size(units) == 2, F.lit(":00")).otherwise(F.lit("")), zone)
    return F.when(day_ok & (rest == ""), date).when(day_ok & time_ok, full)


def lenient_date(text: Column) -> Column:
    """DATE of the first ten characters, NULL when they are none."""
    head = F.substring(text.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def epoch_ms_date(value: Column) -> Column:
    """UTC date of epoch milliseconds given as text; other text gives its first ten characters.

    Years beyond 9999 have more digits and no sign.
    """
    v = _text(value)
    number = F.when(v.rlike(r"^-?\d{1,17}(\.\d+)?$"), v.try_cast("double"))
    days = F.floor(number / 86400000.0).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return (
        F.when(v == "", F.lit("—"))
        .when(number.isNotNull(), F.ltrim(day, F.lit("+")))
        .otherwise(F.substring(v, 1, 10))
    )


# The time stamp inside a granule name
_NAME_DATE = r"_(\d{8})T\d{6}_"
_NAME_STAMP = r"_(\d{8}T\d{6})_"


def month_of(stamp: Column, granule: Column) -> Column:
    """Month from the acquisition time, else from the granule name."""
    s = _text(stamp)
    named = F.regexp_extract(_text(granule), _NAME_DATE, 1)
    own = F.when(s.rlike(r"^.{4}-\d{2}"), F.substring(s, 6, 2).try_cast("int"))
    return F.coalesce(own, F.substring(named, 5, 2).try_cast("int"))


def date_of(stamp: Column, granule: Column) -> Column:
    """Acquisition date as text, else the one in the granule name, else ''."""
    s = _text(stamp)
    named = F.regexp_extract(_text(granule), _NAME_DATE, 1)
    spelled = F.concat_ws("-", F.substring(named, 1, 4), F.substring(named, 5, 2), F.substring(named, 7, 2))
    return F.when(s.rlike(r"^.{4}-.{5}"), F.substring(s, 1, 10)).when(named != "", spelled).otherwise(F.lit(""))


def stamp_of(granule: Column) -> Column:
    """Full time stamp in a granule name, else ''; it tells slices of one day apart."""
    return F.regexp_extract(_text(granule), _NAME_STAMP, 1)


# ----------------------------------------------------------------------- names


def grid_id(
    family: Column, resolved: Column, path: Column, row: Column, mgrs: Column, zone: Column, band: Column,
    square: Column, code: Column,
) -> Column:
    """Grid cell of a scene: an already resolved one wins, then path/row or MGRS parts."""
    p, w = path.cast("string"), row.cast("string")
    numbers = p.rlike(r"^\d+$") & w.rlike(r"^\d+$")
    wide = lambda c: F.when(F.length(c) >= 3, c).otherwise(F.lpad(c, 3, "0"))
    plain = lambda c: c.try_cast("bigint").cast("string")
    given = (F.coalesce(p, F.lit("")) != "") & (F.coalesce(w, F.lit("")) != "")
    landsat = (
        F.when(~given, F.lit(""))
        .when(numbers, F.concat(F.lit("P"), wide(plain(p)), F.lit("R"), wide(plain(w))))
        .otherwise(F.concat(F.lit("P"), p, F.lit("R"), w))
    )
    has = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    sentinel = (
        F.when(has(zone) & has(band), F.concat(zone.cast("string"), band, F.coalesce(square, F.lit(""))))
        .when(~has(zone) & has(mgrs), mgrs)
        .otherwise(F.coalesce(code, F.lit("")))
    )
    return F.when(has(resolved), resolved).when(family == "ls", landsat).otherwise(sentinel)


def platform_prefix(platform: Column, family: Column) -> Column:
    """'Lands8', 'Sent2A' or the bare prefix of the family; no number is invented."""
    p = F.lower(F.trim(_text(platform)))
    digit = F.regexp_extract(p, r"landsat[-_ ]?(\d)", 1)
    letter = F.upper(F.regexp_extract(p, r"sentinel[-_ ]?2[-_ ]?([a-d])?", 1))
    known_s2 = p.rlike(r"sentinel[-_ ]?2")
    landsat = F.concat(F.lit(dims.SOURCE_PREFIX["ls"]), digit)
    sentinel = F.when(known_s2, F.concat(F.lit("Sent2"), letter)).otherwise(F.lit(dims.SOURCE_PREFIX["s2"]))
    return F.when(family == "ls", landsat).when(family == "s2", sentinel).otherwise(F.lit("Sat"))


def granule_name(ident: Column, product_id: Column) -> Column:
    """STRUCT<name, complete>: the product identifier unless blank, else the item's id."""
    product = F.trim(_text(product_id))
    complete = product != ""
    return F.struct(
        F.when(complete, product).otherwise(F.trim(_text(ident))).alias("name"), complete.alias("complete")
    )


def orbit_letter(direction: Column) -> Column:
    return F.when(direction == "ascending", F.lit("A")).when(direction == "descending", F.lit("D")).otherwise(F.lit("X"))


def crop_label(track: Column, direction: Column, res_m: Column, stamp: Column, pol: Column) -> Column:
    """Key of a radar crop; it keeps orders in one folder from overwriting each other."""
    return F.concat(
        F.lit("S1_T"), track.cast("string"), orbit_letter(direction), F.lit("_"), res_m.cast("string"), F.lit("m_"),
        stamp, F.lit("_"), pol,
    )


def radar_product_name(
    kind: str, year: Column, track: Column, direction: Column, res_m: Column, pol: Column, dry: Column, wet: Column
) -> Column:
    """File name of a radar product: kind is 'AMPL', 'MEDSECA' or 'MEDLLUV'."""
    core = F.concat(
        F.lit("S1_"), year.cast("string"), F.lit("_T"), track.cast("string"), orbit_letter(direction), F.lit("_"),
        res_m.cast("string"), F.lit("m_"), pol,
    )
    parts = {
        "AMPL": [F.lit("_S"), dry, F.lit("_L"), wet],
        "MEDSECA": [F.lit("_S"), dry],
        "MEDLLUV": [F.lit("_L"), wet],
    }[kind]
    return F.concat(F.lit(kind + "_"), core, *parts)


def capture_label(published: Column, capture: Column, is_current: Column) -> Column:
    """'vigente', '<published>_capND' or '<published>_cap<date>'."""
    return (
        F.when(is_current, F.lit("vigente"))
        .when(_text(capture).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(published, F.lit("_cap"), capture))
        .otherwise(F.concat(published, F.lit("_capND")))
    )


# ----------------------------------------------------------------------- links


def strip_signature(url: Column) -> Column:
    """A link without its query string, which may be a credential."""
    u = _text(url)
    at = F.instr(u, "?")
    return F.when(at > 0, F.concat(F.substring(u, F.lit(1), at - 1), F.lit("?<firma oculta>"))).otherwise(u)


# Fixed value: characters an URI may not carry, besides control and non-ASCII ones
_FORBIDDEN = ' "<>\\^`{|}[]'


def unsafe_href(href: Column) -> Column:
    """Characters of a link that are not allowed in an URI, in order of appearance."""
    chars = F.filter(
        F.split(_text(href), ""),
        lambda c: (c != "") & (F.lit(_FORBIDDEN).contains(c) | (F.ascii(c) > 126) | (F.ascii(c) < 32)),
    )
    return F.array_join(F.array_distinct(chars), "")


def equal_interval_class(v: Column, lo: float, hi: float, n: int) -> Column:
    """Class 1..n of equal width over [lo, hi], NULL outside; an upper bound belongs to its class."""
    n = max(3, int(n))
    width = (hi - lo) / n
    number = F.greatest(F.lit(1), F.ceil((v - F.lit(float(lo))) / F.lit(width)))
    return F.when(v.between(lo, hi), F.least(F.lit(n), number).cast("int"))


def equal_interval_labels(lo: Column, hi: Column, n: Column) -> Column:
    """ARRAY<STRUCT<class, label, zero_off>> for the classes of :func:`equal_interval_class`.

    ``zero_off`` says that zero lies inside a class, over a twentieth of its width from every edge.
    """
    parts = F.greatest(n, F.lit(3))
    edges = F.transform(F.sequence(F.lit(0), parts), lambda k: lo + k * (hi - lo) / parts)
    on_edge = F.exists(edges, lambda e: F.abs(e) <= (hi - lo) / parts * 0.05)
    off = (lo < 0) & (hi > 0) & ~on_edge
    return F.transform(
        F.arrays_zip(F.slice(edges, F.lit(1), parts).alias("a"), F.slice(edges, F.lit(2), parts).alias("b")),
        lambda pair, i: F.struct((i + 1).alias("class"), F.format_string("%.3f – %.3f", pair["a"], pair["b"]).alias("label"), off.alias("zero_off")),
    )


def provenance(
    product: Column, family: Column, collection: Column, extra: Column | None = None, **more: Column
) -> Column:
    """MAP of upper-case keys; level and correction follow the collection, blanks are left out.

    ``more`` may give catalogue, catalogue_url, radiometry, generated_by, generated.
    """
    level = correction = F.lit(None).cast("string")
    for name, (lv, co) in dims.COLLECTION_LEVEL.items():
        level = F.when(collection == name, F.lit(lv)).otherwise(level)
        correction = F.when(collection == name, F.lit(co)).otherwise(correction)
    none = F.lit(None).cast("string")
    # The keys, in their order
    pairs = {
        "PRODUCTO": product,
        "SENSOR": F.when(family == "ls", F.lit("Landsat")).otherwise(F.lit("Sentinel-2")),
        "COLECCION": collection,
        "CATALOGO": more.get("catalogue", none),
        "CATALOGO_URL": more.get("catalogue_url", none),
        "NIVEL_PROCESAMIENTO": level,
        "CORRECCION_ATMOSFERICA": correction,
        "MASCARA_CALIDAD": F.when(family == "ls", F.lit("QA_PIXEL")).otherwise(F.lit("SCL")),
        "RADIOMETRIA": more.get("radiometry", none),
        "GENERADO_POR": more.get("generated_by", none),
        "GENERADO": more.get("generated", none),
    }
    entries = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    if extra is not None:
        entries = F.map_concat(entries, F.transform_keys(extra, lambda k, _: F.upper(k)))
    return F.map_filter(entries, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
