"""Cases that fix the meaning of the operators, each with a variant that must fail."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe import dims
from eoframe.functions import geo
from eoframe.functions import indices as ix
from eoframe.functions import radiometry as rad
from eoframe.functions import text as tx
from eoframe.operators import catalog as ca
from eoframe.operators import coefficients as co
from eoframe.operators import mosaic as mo
from eoframe.operators import pixels as px
from eoframe.operators import radar as ra
from eoframe.operators import report as rp
from eoframe.operators import seasonal as se
from eoframe.plans.optical import check_optical, optical_run
from eoframe.plans.radar import sar_order_plan


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def column(spark, values, kind="STRING"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")


def apply(spark, fn, values, kind="STRING"):
    rows = column(spark, values, kind).select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_month_lists(spark):
    assert apply(spark, tx.parse_months, ["12,1,2", "12;1", " 3 , ", "", None, "1,x", "13", "0", "2,2"]) == [
        [12, 1, 2], [12, 1], [3], [], [], [], [], [], [2, 2]]
    lenient = apply(spark, lambda c: tx.parse_months_lenient(c, (7, 8)), ["12 1;x,1", "", "99"])
    assert lenient == [[12, 1], [7, 8], [7, 8]]


def brute_month_code(months):
    have = sorted(set(months))
    if not have:
        return "NA"
    if len(have) == 12:
        return "01-12"
    for first in have:
        run = [(first - 1 + k) % 12 + 1 for k in range(len(have))]
        if sorted(run) == have:
            return f"{run[0]:02d}-{run[-1]:02d}"
    return ".".join(f"{m:02d}" for m in have)


def test_month_code_of_all_subsets(spark):
    subsets = [[m + 1 for m in range(12) if bits >> m & 1] for bits in range(4096)]
    got = apply(spark, tx.month_code, subsets, "ARRAY<INT>")
    assert got == [brute_month_code(s) for s in subsets]
    assert apply(spark, tx.month_code, [[12, 1, 2, 3, 4], [3, 1, 7]], "ARRAY<INT>") == ["12-04", "01.03.07"]


def test_limits(spark):
    got = apply(spark, tx.parse_limits, ["-1, 1", "0;0", "1,0", "a,b", "", None, "1,2,3"])
    assert [tuple(g) if g else None for g in got] == [(-1.0, 1.0), None, None, None, None, None, None]


def test_iso_timestamps(spark):
    cases = {
        "2025-01-03": "2025-01-03", "2025/01/03": "2025-01-03", "2025-01-03 11:31": "2025-01-03T11:31:00",
        "2025-01-03T11:31:22Z": "2025-01-03T11:31:22Z", "2025-01-03T11:31:22.5-06:00": "2025-01-03T11:31:22-06:00",
        " 2025-01-03 ": "2025-01-03", "03/01/2025": None, "2025-02-30": None, "2025-01-03T24:00": None,
        "2025-01-03T10:60": None, "2025-01-03T10:00:60": "2025-01-03T10:00:60", "x": None, "": None, "2024-02-29": "2024-02-29",
    }
    assert apply(spark, tx.iso_timestamp, list(cases)) == list(cases.values())


def test_names_and_links(spark):
    assert apply(spark, tx.strip_signature, ["a?b=1", "a", None]) == ["a?<firma oculta>", "a", ""]
    assert apply(spark, tx.unsafe_href, ["ok.kml", "año 1.kml", "a b c", None]) == ["", "ñ ", " ", ""]
    prefix = lambda f: (lambda c: tx.platform_prefix(c, F.lit(f)))
    assert apply(spark, prefix("s2"), ["Sentinel-2A", "sentinel-2", "", None, "x"]) == ["Sent2A", "Sent2", "Sent", "Sent", "Sent"]
    assert apply(spark, prefix("ls"), ["landsat-8", "LANDSAT_7", "x"]) == ["Lands8", "Lands7", "Lands"]
    assert apply(spark, tx.stamp_of, ["S1A_IW_20250203T001234_X", "x"]) == ["20250203T001234", ""]


def test_quality_bits(spark):
    got = apply(spark, lambda c: F.struct(rad.qa_no_data(c), rad.qa_cloudy(c)), [0, 1, 2, 4, 8, 16, 32, 64], "INT")
    assert [tuple(g) for g in got] == [
        (False, False), (True, False), (False, True), (False, True), (False, True), (False, True), (False, False), (False, False)]


def test_reflectance(spark):
    r = one(
        spark,
        new=rad.to_reflectance(F.lit(2000), F.lit("s2"), F.lit("04.00")),
        old=rad.to_reflectance(F.lit(2000), F.lit("s2"), F.lit("03.01")),
        empty=rad.to_reflectance(F.lit(2000), F.lit("s2"), F.lit("")),
        applied=rad.to_reflectance(F.lit(2000), F.lit("s2"), F.lit("05.09"), F.lit(True)),
        landsat=rad.to_reflectance(F.lit(10000), F.lit("ls"), F.lit(None).cast("string")),
        declared=rad.to_reflectance(F.lit(2000), F.lit("ls"), F.lit(""), None, F.lit(0.0001), F.lit(-0.1)),
        dark=rad.to_reflectance(F.lit(500), F.lit("s2"), F.lit("04.00")),
    )
    assert (r.new, r.old, r.empty, r.applied) == (0.1, 0.2, 0.2, 0.2)
    assert r.landsat == pytest.approx(0.075) and r.declared == pytest.approx(0.1) and r.dark == -0.05


def test_range_drops_and_does_not_clip(spark):
    assert apply(spark, lambda c: rad.clamp_physical("NDVI", c), [-0.5, 0.0, 0.9, 7.0, -3.0, 1.0, None], "DOUBLE") == [
        -0.5, 0.0, 0.9, None, None, 1.0, None]
    assert apply(spark, lambda c: rad.clamp_physical("TCB", c), [55.0], "DOUBLE") == [55.0]
    assert apply(spark, rad.finite, [float("nan"), float("inf"), 1.0], "DOUBLE") == [None, None, 1.0]


def test_evi2_stays_in_bounds_and_zero_division_is_null(spark):
    axis = [(-0.1 + 1.7 * i / 40) for i in range(41)]
    df = spark.createDataFrame([(a, b) for a in axis for b in axis], "nir DOUBLE, red DOUBLE")
    r = df.agg(F.min(ix.evi2(F.col("nir"), F.col("red"))).alias("lo"), F.max(ix.evi2(F.col("nir"), F.col("red"))).alias("hi")).first()
    assert -1.0 < r.lo and r.hi < 2.5
    assert one(spark, v=ix.normalized_difference(F.lit(0.1), F.lit(-0.1))).v is None


def test_coefficients_are_rotations(spark):
    rows = co.validate_orthonormality(dims.tc_table(spark)).collect()
    assert all(r.valid for r in rows) and len(rows) == 4
    broken = dims.tc_table(spark).withColumn("g", F.transform("g", lambda x: x + 0.1))
    assert not any(r.valid for r in co.validate_orthonormality(broken).collect())
    short = dims.tc_table(spark).withColumn("w", F.slice("w", 1, 5))
    assert not any(r.valid for r in co.validate_orthonormality(short).collect())


def scenes(spark, rows):
    return spark.createDataFrame(
        [(i, date.fromisoformat(d), c, a) for i, (d, c, a) in enumerate(rows)],
        "scene_id INT, acquired DATE, cloud_pct DOUBLE, aoi_cloud_pct DOUBLE")


def test_best_scenes(spark):
    s = scenes(spark, [("2024-01-03", 40.0, 1.0), ("2024-01-09", 5.0, 80.0), ("2024-01-20", None, None),
                       ("2024-02-02", 10.0, None), ("2025-02-02", 10.0, 3.0), ("2025-02-05", 1.0, 3.0)])
    top = ca.top_per_period(s, "mensual", 2).select("period", "rank", "scene_id").collect()
    assert {(r.period, r.rank): r.scene_id for r in top} == {
        ("2024-01", 1): 1, ("2024-01", 2): 0, ("2024-02", 1): 3, ("2025-02", 1): 5, ("2025-02", 2): 4}
    best = {r.period: r.scene_id for r in ca.best_per_period(s, "mensual").collect()}
    assert best == {"2024-01": 0, "2024-02": 3, "2025-02": 4}
    assert {r.period for r in ca.latest_periods(ca.top_per_period(s, "anual", 1), 1).collect()} == {"2025"}
    gaps = [r.period for r in ca.empty_periods(s, "2016-11-01", "2019-02-28", "anual").collect()]
    assert sorted(gaps) == ["2017", "2018", "2019"]
    assert sorted(r.scene_id for r in ca.filter_aoi_cloud(s, 3.0).collect()) == [0, 2, 3, 4, 5]


def test_output_names(spark):
    s = scenes(spark, [("2024-01-07", 1.0, 1.0), ("2024-01-03", 1.0, 1.0), ("2024-01-03", 1.0, 1.0), ("2024-01-03", 1.0, 1.0),
                       ("2024-01-07", 1.0, 1.0), ("2024-02-01", 1.0, 1.0)])
    s = s.withColumns({"platform": F.lit("sentinel-2c"), "family": F.lit("s2"), "grid": F.lit("16PFS")})
    got = {r.scene_id: r.file_name for r in ca.output_names(s, "AGR").collect()}
    base = "Sent2C_2024_01_16PFS_AGR"
    assert got == {1: f"{base}.tif", 2: f"{base}_d03.tif", 3: f"{base}_d03_2.tif", 0: f"{base}_d07.tif", 4: f"{base}_d07_2.tif",
                   5: "Sent2C_2024_02_16PFS_AGR.tif"}


def test_fire_scenes(spark):
    days = ["2025-11-18", "2025-12-20", "2026-01-15", "2026-01-25", "2026-06-01", "2026-12-28", "2027-02-02"]
    s = scenes(spark, [(d, 0.0, 0.0) for d in days])
    first = se.pick_fire_scenes(s, "2026-01-15").first()
    assert (str(first.pre), str(first.post), first.days_before, first.days_after) == ("2025-12-20", "2026-01-25", 26, 10)
    late = se.pick_fire_scenes(s, "2026-01-15", "extendida").first()
    assert str(late.post) == "2026-12-28" and not late.looks_initial
    tie = se.pick_fire_scenes(scenes(spark, [("2025-01-01", 0.0, 0.0), ("2026-01-10", 0.0, 0.0), ("2026-01-20", 0.0, 0.0)]), "2025-01-15", "extendida").first()
    assert str(tie.post) == "2026-01-10"
    assert se.pick_fire_scenes(s, "2020-01-01").first().reason == "no_scene_before"
    assert se.pick_fire_scenes(s, "2030-01-01").first().reason == "no_scene_after"
    assert str(se.pick_fire_scenes(s, "2026-01-15", "nonsense").first().post) == "2026-01-25"


def test_burn_classes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.15, 0.35, 0.55, 0.8, None, None)], "dnbr DOUBLE")
    rows = se.dnbr_classes(df, 400.0).orderBy("class_no").collect()
    assert [(r.n, r.pct, r.hectares) for r in rows] == [(1, 20.0, 0.04)] * 5
    edge = se.dnbr_classes(spark.createDataFrame([(0.1,)], "dnbr DOUBLE")).orderBy("class_no").collect()
    assert [r.n for r in edge] == [0, 1, 0, 0, 0] and edge[0].hectares is None
    highs = [c[2] for c in dims.NDVI_CLASSES[:-1]]
    assert highs == [c[1] for c in dims.NDVI_CLASSES[1:]]


def test_distribution_of_nothing_and_of_ten(spark):
    rows = [("NDVI", "a", i / 10) for i in range(10)] + [("NDVI", "void", None)] * 40 + [("NDVI", "part", v) for v in (1.0, None, 3.0)]
    d = {r.scene_id: r for r in se.index_distribution(spark.createDataFrame(rows, "index STRING, scene_id STRING, value DOUBLE")).collect()}
    assert d["a"].median == pytest.approx(0.45) and d["a"].p2 == pytest.approx(0.018) and d["a"].pct == 100.0
    assert (d["void"].n, d["void"].total, d["void"].pct, d["void"].median) == (0, 40, 0.0, None)
    assert d["part"].n == 2 and d["part"].pct == pytest.approx(200 / 3)


def test_amplitude_against_numpy(spark):
    rng = np.random.default_rng(7)
    months = np.arange(24) % 12 + 1
    cube = rng.uniform(-1, 1, (24, 20, 20))
    cube[rng.uniform(size=cube.shape) < 0.6] = np.nan
    rows = [("NDVI", r, c, int(months[t]), None if np.isnan(cube[t, r, c]) else float(cube[t, r, c]))
            for t in range(24) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(rows, "index STRING, px_row INT, px_col INT, month INT, value DOUBLE")
    got = {(r.px_row, r.px_col): r for r in se.seasonal_amplitude(df, ("index", "px_row", "px_col")).collect()}
    dry = np.isin(months, dims.DRY_MONTHS)
    n_d, n_w = np.isfinite(cube[dry]).sum(0), np.isfinite(cube[~dry]).sum(0)
    seen = 0
    for (r, c), row in got.items():
        assert (row.n_dry, row.n_wet) == (n_d[r, c], n_w[r, c])
        if n_d[r, c] >= 3 and n_w[r, c] >= 3:
            want = np.nanmedian(cube[dry, r, c]) - np.nanmedian(cube[~dry, r, c])
            assert row.amplitude == pytest.approx(want)
            seen += 1
        else:
            assert row.amplitude is None and row.med_dry is None
    assert 0 < seen < 400 == len(got)


def test_a_product_without_a_season_is_left_out(spark):
    rows = [("NDVI", 1, 1, 0.5), ("NDVI", 1, 7, 0.1), ("NBR", 1, 1, 0.4)]
    df = spark.createDataFrame(rows, "index STRING, px INT, month INT, value DOUBLE")
    got = se.seasonal_amplitude(df, ("index", "px"), min_obs=1).collect()
    assert [r["index"] for r in got] == ["NDVI"] and got[0].amplitude == pytest.approx(0.4)


def tracks(spark, rows):
    return spark.createDataFrame(rows, "orbit_state STRING, relative_orbit INT, n BIGINT, n_dry BIGINT, n_wet BIGINT, credits BIGINT")


def test_track_ranking_and_ties(spark):
    df = tracks(spark, [("descending", 91, 30, 12, 18, 1800), ("ascending", 20, 30, 12, 18, 1800), ("ascending", 7, 40, 5, 35, 2400)])
    got = ra.rank_tracks(df).orderBy("position").collect()
    assert [r.relative_orbit for r in got] == [20, 91, 7]
    assert [r.tied for r in got] == [True, True, False]


def test_affordable(spark):
    df = spark.createDataFrame([(31, 1630.0), (31, 155.0), (31, 154.0), (31, None)], "n INT, balance DOUBLE")
    got = {(r.balance, r.res_m, r.cost) for r in ra.affordable_options(df).collect()}
    assert got == {(1630.0, 20, 465), (1630.0, 30, 155), (155.0, 30, 155)}


def test_kml_vertices(spark):
    texts = [
        "<Placemark><coordinates>1,2 3,4\n5,6</coordinates></Placemark>, a,b,c",
        "<coordinates >1,2</coordinates><coordinates>3,4</coordinates>",
        "<coordinates>1,2 3,4", "<GroundOverlay><GroundOverlay>", "",
    ]
    rows = rp.kml_audit(column(spark, texts), "v").orderBy("i").collect()
    assert [r.n_vertices for r in rows] == [3, 2, 0, 0, 0]
    assert rows[0].n_placemarks == 1 and rows[3].n_overlays == 2


def test_landsat_near_infrared_is_one_band(spark):
    asked = spark.createDataFrame([(1, "nir", "ls"), (1, "nir08", "ls"), (2, "nir", "s2"), (2, "nir08", "s2")], "req INT, band STRING, family STRING")
    assert [(r.req, r.asset, r.bands) for r in ca.duplicate_bands(asked, ["req"]).collect()] == [(1, "nir08", "nir,nir08")]


def test_metres_per_pixel_and_extent(spark):
    m = one(spark, m=geo.metres_per_pixel(*[F.lit(v) for v in (-180.0, -85.0, 180.0, 85.0)], F.lit(2048), F.lit(1024)),
            bad=geo.metres_per_pixel(*[F.lit(v) for v in (1.0, 0.0, 1.0, 2.0)], F.lit(10), F.lit(10)),
            world=ca.suspicious_extent(*[F.lit(v) for v in (-86.5, 7.5, -82.0, 11.5)]))
    assert m.m.mx == pytest.approx(19568, rel=1e-3) and m.bad is None and m.world is False


def brute_fold(rows, threshold=2.0):
    """Oldest to newest against the image kept last, for one tile."""
    kept, last = [], None
    for num, px_ in sorted(rows):
        if px_ is None:
            kept.append(num)
            last = None
        elif last is None or len(last) != len(px_) or np.mean(np.abs(np.array(px_) - np.array(last))) >= threshold:
            kept.append(num)
            last = px_
    return kept


def test_same_photo_fold_against_brute_force(spark):
    rng = np.random.default_rng(3)
    tiles = {}
    for tile in range(4):
        size = 600 if tile == 0 else 60
        level, rows = 0.0, []
        for num in range(size):
            level += rng.choice([0.0, 0.7, -0.7, 1.0, 30.0], p=[0.4, 0.3, 0.1, 0.15, 0.05])
            width = 5 if rng.uniform() < 0.02 else 4
            rows.append((num, None if rng.uniform() < 0.02 else [int(round(level)) + int(x) for x in rng.integers(0, 2, width)]))
        tiles[tile] = rows
    # a run of copies longer than any piece
    tiles[9] = [(n, [1, 1, 1, 1]) for n in range(500)]
    df = spark.createDataFrame([(t, n, p) for t, rows in tiles.items() for n, p in rows], "tile_key INT, num BIGINT, px ARRAY<SMALLINT>")
    got = {}
    for r in mo.drop_same_photo(df.repartition(5)).collect():
        got.setdefault(r.tile_key, []).append(r.num)
    assert {t: sorted(v) for t, v in got.items()} == {t: brute_fold(rows) for t, rows in tiles.items()}


def test_redirect_walk(spark):
    cells = [("t", 0, 50, True, 2, 30), ("t", 1, 40, True, None, None), ("t", 2, 30, True, None, 0), ("t", 3, 20, True, None, None),
             ("t", 4, 10, False, None, None), ("t", 5, 5, True, None, None), ("u", 1, 40, True, None, None)]
    df = spark.createDataFrame([(*c, 9) for c in cells], "tile_key STRING, pos INT, num INT, has_data BOOLEAN, select_pos INT, select_num INT, size_bytes INT")
    assert [(r.tile_key, r.step, r.num) for r in mo.changed_versions(df).orderBy("step").collect()] == [("t", 1, 30), ("t", 2, 20)]


def brute_walk(cells):
    """(step, num) of one tile's cells {pos: (num, has, select_pos, select_num)}."""
    out, pos, seen = [], 0, set()
    while pos in cells and pos not in seen:
        seen.add(pos)
        num, has, to, to_num = cells[pos]
        if not has:
            break
        out.append((len(out) + 1, to_num or num))
        if to_num and to is None:
            break
        pos = (to if to_num else pos) + 1
    return out


def test_redirects_back_and_to_unlisted_versions(spark):
    rng = random.Random(11)
    tiles = {}
    for tile in range(60):
        n = rng.randint(1, 12)
        places = [p for p in range(n) if rng.random() < 0.95]
        tiles[tile] = {}
        for p in places:
            kind = rng.random()
            to = None if kind < 0.1 else rng.randrange(n)
            tiles[tile][p] = (100 - p, rng.random() < 0.95, *((None, None) if kind > 0.6 else (to, 99 if to is None else 100 - to)))
    rows = [(t, p, c[0], c[1], c[2], c[3], 1) for t, cells in tiles.items() for p, c in cells.items()]
    df = spark.createDataFrame(rows, "tile_key INT, pos INT, num INT, has_data BOOLEAN, select_pos INT, select_num INT, size_bytes INT")
    got = {t: [] for t in tiles}
    for r in mo.changed_versions(df).orderBy("tile_key", "step").collect():
        got[r.tile_key].append((r.step, r.num))
    assert got == {t: brute_walk(cells) for t, cells in tiles.items()}


def test_long_redirect_walks(spark):
    """A tile with most of the rows, walks of lengths around powers of two, a ring, a tile without a key, repeated cells."""
    tiles = {"hot": {p: (9000 - p, True, None, None) for p in range(1500)}}
    tiles["back"] = {p: (900 - p, True, *((p - 2, 900 - p + 2) if p == 99 else (None, None))) for p in range(300)}
    for n in (1, 2, 3, 4, 5, 7, 8, 9):
        tiles[f"n{n}"] = {p: (100 - p, True, None, None) for p in range(n)}
    tiles["ring"] = {0: (9, True, 1, 8), 1: (8, True, None, None), 2: (7, True, 0, 9), 3: (6, True, None, None)}
    tiles[None] = {0: (5, True, 2, 3), 3: (2, True, None, None)}
    rows = [(t, p, *c, 1) for t, cells in tiles.items() for p, c in cells.items()]
    rows += [("n3", 1, 500, True, None, None, 1), ("n3", 1, 99, True, None, None, 1)]
    out = mo.changed_versions(spark.createDataFrame(rows, "tile_key STRING, pos INT, num INT, has_data BOOLEAN, select_pos INT, select_num INT, size_bytes INT"))
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()
    got = {t: [] for t in tiles}
    for r in sorted(out.collect(), key=lambda r: r.step):
        got[r.tile_key].append((r.step, r.num))
    assert got == {t: brute_walk(cells) for t, cells in tiles.items()}


def test_redirect_walk_of_nothing(spark):
    cells = spark.createDataFrame([], "tile_key STRING, pos INT, num INT, has_data BOOLEAN, select_pos INT, select_num INT, size_bytes INT")
    assert mo.changed_versions(cells).count() == 0


def test_footprints_go_back_into_asset_links(spark):
    base = spark.createDataFrame([("a", '{"blue": "https://x/b02.tif"}', "sentinel-2-l2a", "https://c/v1")], "id STRING, assets STRING, coleccion STRING, catalogo STRING").withColumns({
        "fecha": F.lit("2025-01-03"), "hora_utc": F.lit(""), "nubes_pct": F.lit(10.0), "nubes_aoi": F.lit(5.0), "datos_pct": F.lit(100.0),
        "plataforma": F.lit("sentinel-2a"), "tile": F.lit("16PFS"), "epsg": F.lit(32616)})
    good, _ = ca.scenes_from_footprints(base)
    r = good.select("collection", "catalog", F.col("acquired").cast("string").alias("d"), ca.resolve_asset(F.col("assets"), "blue", F.lit("s2")).alias("link")).first()
    assert tuple(r) == ("sentinel-2-l2a", "https://c/v1", "2025-01-03", "https://x/b02.tif")


def test_footprints_are_rejected_and_counted(spark):
    rows = [("a", '{"B04": "https://x/b04.tif"}'), ("b", ""), ("c", '{"half": ['), ("d", "{}"), ("e", None)]
    base = spark.createDataFrame(rows, "id STRING, assets STRING").withColumns({
        "fecha": F.lit("2025-01-03"), "hora_utc": F.lit(None).cast("string"), "nubes_pct": F.lit(10.0), "nubes_aoi": F.lit(5.0),
        "datos_pct": F.lit(100.0), "plataforma": F.lit("sentinel-2a"), "tile": F.lit("16PFS"), "epsg": F.lit(32616)})
    good, bad = ca.scenes_from_footprints(base)
    assert [(r.scene_id, r.datetime, r.assets["B04"]) for r in good.collect()] == [("a", "2025-01-03T00:00:00Z", "https://x/b04.tif")]
    assert sorted(r.id for r in bad.collect()) == ["b", "c", "d", "e"]


def test_masks_come_after_the_range(spark):
    rows = [(1, "s2", "03.01", 3000, 1000, 4, 0), (2, "s2", "03.01", 3000, 1000, 9, 0), (3, "ls", "", 20000, 9000, 9, 0), (4, "ls", "", 20000, 9000, 4, 2)]
    df = spark.createDataFrame(rows, "k INT, family STRING, baseline STRING, nir INT, red INT, scl INT, qa_pixel INT")
    got = {r.k: r for r in px.compute_indices(df, ["NDVI"], keep=("k",)).collect()}
    assert got[1].value == pytest.approx(0.5) and got[2].value is None and got[2].raw is not None
    assert got[3].value is not None and got[4].value is None


def test_bad_arguments_are_refused():
    good = dict(start="2024-01-01", end="2024-12-31", family="s2", indices=["NBR"], dry=(1,), wet=(7,), amplitude=True, fire_date="2024-06-01")
    check_optical(**good)
    for change in (dict(start="2025-01-01"), dict(start="01/02/2024"), dict(indices=["XX"]), dict(family="ls", indices=["NDRE", "NBR"]),
                   dict(dry=()), dict(wet=(1, 7)), dict(fire_date="soon"), dict(indices=["NDVI"]), dict(bands=("nir", "nir08"), family="ls"),
                   dict(min_obs=0), dict(candidates=0)):
        with pytest.raises(ValueError):
            check_optical(**{**good, **change})
    with pytest.raises(ValueError):
        sar_order_plan(None, 1, res_m=15)
