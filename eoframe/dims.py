"""Constant dimensions: bands, indices, coefficients, classes, prices.

Everything in this module is a fixed value that results must agree with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# File suffix of a band as (key, Sentinel-2, Landsat)
BAND_SUFFIXES = (
    ("visual", "TCI", None),
    ("blue", "B02", "BLUE"),
    ("green", "B03", "GREEN"),
    ("red", "B04", "RED"),
    ("rededge1", "B05", None),
    ("rededge2", "B06", None),
    ("rededge3", "B07", None),
    ("nir", "B08", "NIR08"),
    ("nir08", "B8A", "NIR08"),
    ("swir16", "B11", "SWIR16"),
    ("swir22", "B12", "SWIR22"),
    ("scl", "SCL", "QA"),
)

# Bands as
# (key, label, Sentinel-2 aliases, S2 band number, S2 metres, Landsat aliases, Landsat metres)
BANDS = (
    ("visual", "visual (RGB 8 bits)", ("visual", "TCI", "tci", "visual-10m"), "TCI", 10, (), None),
    ("blue", "azul", ("blue", "B02"), "B02", 10, ("blue",), 30),
    ("green", "verde", ("green", "B03"), "B03", 10, ("green",), 30),
    ("red", "rojo", ("red", "B04"), "B04", 10, ("red",), 30),
    ("rededge1", "borde rojo 1", ("rededge1", "B05"), "B05", 20, (), None),
    ("rededge2", "borde rojo 2", ("rededge2", "B06"), "B06", 20, (), None),
    ("rededge3", "borde rojo 3", ("rededge3", "B07"), "B07", 20, (), None),
    ("nir", "NIR", ("nir", "B08"), "B08", 10, ("nir08",), 30),
    ("nir08", "NIR estrecho", ("nir08", "B8A"), "B8A", 20, ("nir08",), 30),
    ("swir16", "SWIR 1", ("swir16", "B11"), "B11", 20, ("swir16",), 30),
    ("swir22", "SWIR 2", ("swir22", "B12"), "B12", 20, ("swir22",), 30),
    ("scl", "máscara de clases", ("scl", "SCL"), "SCL", 20, ("qa_pixel",), 30),
)
BAND_KEYS = tuple(b[0] for b in BANDS)
DEFAULT_S2_RES = 10.0
LANDSAT_RES = 30.0

# Spectral indices as (suffix, bands in formula order, Sentinel-2 only)
TC_BANDS = ("blue", "green", "red", "nir", "swir16", "swir22")
INDICES = (
    ("NDVI", ("nir", "red"), False),
    ("SAVI", ("nir", "red"), False),
    ("EVI2", ("nir", "red"), False),
    ("NDMI", ("nir08", "swir16"), False),
    ("NBR", ("nir08", "swir22"), False),
    ("MSI", ("swir16", "nir08"), False),
    ("NDRE", ("nir08", "rededge1"), True),
    ("CIre", ("rededge3", "rededge1"), True),
    ("TCB", TC_BANDS, False),
    ("TCG", TC_BANDS, False),
    ("TCW", TC_BANDS, False),
)
INDEX_NAMES = tuple(i[0] for i in INDICES)
INDEX_BANDS = {i[0]: i[1] for i in INDICES}
S2_ONLY = tuple(i[0] for i in INDICES if i[2])

# Admissible range of each index; outside it a value is an artefact
INDEX_LIMITS = {
    "NDVI": (-1.0, 1.0),
    "SAVI": (-1.5, 1.5),
    "EVI2": (-1.0, 2.5),
    "NDMI": (-1.0, 1.0),
    "NBR": (-1.0, 1.0),
    "NDRE": (-1.0, 1.0),
    "MSI": (0.0, 10.0),
    "CIre": (-1.0, 20.0),
}
RADAR_LIMITS = {"VH": (0.0, 3.0), "VV": (0.0, 3.0), "RVI": (0.0, 4.0)}

# Tasseled Cap coefficients per sensor group (published tables)
TC_COEFFICIENTS = {
    "TM": {
        "kind": "superficie",
        "B": (0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303),
        "G": (-0.1603, -0.2819, -0.4934, 0.7940, -0.0002, -0.1446),
        "W": (0.0315, 0.2021, 0.3102, 0.1594, -0.6806, -0.6109),
    },
    "ETM": {
        "kind": "TOA",
        "B": (0.3561, 0.3972, 0.3904, 0.6966, 0.2286, 0.1596),
        "G": (-0.3344, -0.3544, -0.4556, 0.6966, -0.0242, -0.2630),
        "W": (0.2626, 0.2141, 0.0926, 0.0656, -0.7629, -0.5388),
    },
    "OLI": {
        "kind": "superficie",
        "B": (0.3690, 0.4271, 0.4689, 0.5073, 0.3824, 0.2406),
        "G": (-0.2870, -0.2685, -0.4087, 0.8145, 0.0637, -0.1052),
        "W": (0.0382, 0.2137, 0.3536, 0.2270, -0.6108, -0.6351),
    },
    "MSI": {
        "kind": "TOA",
        "B": (0.3510, 0.3813, 0.3437, 0.7196, 0.2396, 0.1949),
        "G": (-0.3599, -0.3533, -0.4734, 0.6633, 0.0087, -0.2856),
        "W": (0.2578, 0.2305, 0.0883, 0.1071, -0.7611, -0.5308),
    },
}

# RGB composites as (suffix, bands for R, G, B)
COMPOSITES = (
    ("NAT", ("red", "green", "blue")),
    ("IRC", ("nir", "red", "green")),
    ("AGR", ("swir16", "nir", "blue")),
    ("VEG", ("nir08", "swir16", "blue")),
    ("ANV", ("swir16", "nir", "red")),
    ("URB", ("swir22", "swir16", "red")),
    ("PEN", ("swir22", "swir16", "nir08")),
    ("GEO", ("swir22", "swir16", "blue")),
)

# Radiometry constants
LANDSAT_SCALE = 0.0000275
LANDSAT_OFFSET = -0.2
S2_DIVISOR = 10000.0
S2_BOA_OFFSET = -1000.0
S2_BASELINE_WITH_OFFSET = "04.00"

# Quality classes and bits
SCL_NO_DATA = (0, 1)
SCL_CLOUDY = (3, 8, 9, 10)
QA_FILL_MASK = 1
QA_CLOUD_MASK = 30

# NDVI orientation ranges, half-open (label, from, to, also read as)
NDVI_CLASSES = (
    ("Agua libre, sombra profunda", None, 0.0, "Nube no enmascarada, nieve"),
    ("Suelo desnudo, roca, arena, superficie construida", 0.0, 0.2, "Vegetación seca o senescente"),
    ("Herbácea rala, cultivo recién emergido", 0.2, 0.4, "Cubierta densa con vigor bajo"),
    ("Cultivo en desarrollo, pasto en crecimiento", 0.4, 0.6, "Cubierta rala con vigor alto"),
    ("Cultivo cerrado, pasto vigoroso, regeneración", 0.6, 0.8, "Cubierta media con vigor muy alto"),
    ("Dosel cerrado", 0.8, None, "Zona de saturación: el NDVI deja de resolver dentro de este tramo. Para separar ahí, use EVI2"),
)

# Burn-severity classes in index units, half-open (label, from, to)
DNBR_CLASSES = (
    ("Sin quemar o rebrote", None, 0.100),
    ("Severidad baja", 0.100, 0.270),
    ("Severidad moderada-baja", 0.270, 0.440),
    ("Severidad moderada-alta", 0.440, 0.660),
    ("Severidad alta", 0.660, None),
)

# Price of a radar job per pixel spacing in metres
CREDITS = {30: 5, 20: 15, 10: 60}

# Default seasons and defaults of the runs
DRY_MONTHS = (12, 1, 2, 3, 4)
WET_MONTHS = (5, 6, 7, 8, 9, 10, 11)
MIN_OBS = 3
FLOOR_YEAR = 2017
JOBS_PER_REQUEST = 200
SAME_PHOTO_THRESHOLD = 2.0
META_POINTS = 3

# File-name prefix of a sensor family
SOURCE_PREFIX = {"s2": "Sent", "ls": "Lands"}

# Processing level and correction of each collection
COLLECTION_LEVEL = {
    "sentinel-2-l2a": ("L2A — reflectancia de superficie", "Sen2Cor (ESA)"),
    "sentinel-2-c1-l2a": ("L2A — reflectancia de superficie", "Sen2Cor (ESA)"),
    "landsat-c2-l2": ("Collection 2 Level-2 — reflectancia de superficie", "USGS Collection 2 Level-2"),
}

# Import limits of the web globe
KML_MAX_FEATURES = 10000
KML_MAX_VERTICES = 250000

# What an index measures and its usual misreading, one line each.
INDEX_GUIDE = {
    "NDVI": ("amount of green vegetation", "dense, active green cover", "little or no green vegetation",
             "saturates over dense canopy, and does not tell how much cover there is from the state it is in"),
    "SAVI": ("green vegetation with bare-soil correction", "much green cover", "little vegetation",
             "differs from NDVI only over visible soil; saturates like it"),
    "EVI2": ("vigour without saturation", "much green biomass, also where NDVI no longer rises", "little vegetation",
             "runs from 0 to about 0.9 over vegetation; calibrated on MODIS with a red to blue ratio of 2.08"),
    "NDMI": ("water held by the canopy", "moist canopy", "dry canopy, or little of it",
             "over sparse cover it reads soil moisture; a low value may be drought or missing vegetation"),
    "NBR": ("standing vegetation against char", "standing vegetation", "burnt surface or bare soil",
            "one date does not measure severity; that takes the difference of two dates, with thresholds of its own"),
    "MSI": ("moisture stress", "dry or stressed canopy", "moist canopy",
            "inverted: high is dry; no upper bound, and high over bare soil without any plant"),
    "NDRE": ("relative chlorophyll, red edge", "more chlorophyll than the rest of the scene", "less chlorophyll: senescence or deficiency",
             "compare inside one scene only, it is no content of chlorophyll; Sentinel-2 alone has the band"),
    "CIre": ("relative chlorophyll as a ratio", "more chlorophyll than the rest of the scene", "less chlorophyll",
             "compare inside one scene only; no upper bound, noisy over sparse cover; Sentinel-2 alone has the band"),
    "TCB": ("brightness", "bare soil, sand, rock, built surface", "water, dense canopy, shadow",
            "coefficients belong to one sensor; two of the four sets were derived from top-of-atmosphere reflectance"),
    "TCG": ("greenness", "vegetation", "no vegetation", "coefficients belong to one sensor"),
    "TCW": ("wetness", "water in canopy and soil, shadow", "dry", "shadow reads as wetness; coefficients belong to one sensor"),
}


def bands_table(spark: SparkSession) -> DataFrame:
    """The band dimension as a 12-row table."""
    rows = [
        (i, k, label, list(s2), n2, float(r2), list(ls), float(rl) if rl else None)
        for i, (k, label, s2, n2, r2, ls, rl) in enumerate(BANDS)
    ]
    return spark.createDataFrame(
        rows,
        "pos INT, band STRING, label STRING, s2_aliases ARRAY<STRING>, s2_band STRING, "
        "s2_res DOUBLE, ls_aliases ARRAY<STRING>, ls_res DOUBLE",
    )


def tc_table(spark: SparkSession) -> DataFrame:
    """Tasseled Cap coefficients, one row per sensor group (4 rows)."""
    rows = [
        (g, c["kind"], list(c["B"]), list(c["G"]), list(c["W"]))
        for g, c in TC_COEFFICIENTS.items()
    ]
    return spark.createDataFrame(
        rows, "grp STRING, kind STRING, b ARRAY<DOUBLE>, g ARRAY<DOUBLE>, w ARRAY<DOUBLE>"
    )


def composites_table(spark: SparkSession) -> DataFrame:
    """RGB composites, one row per composite (8 rows)."""
    rows = [(s, list(b)) for s, b in COMPOSITES]
    return spark.createDataFrame(rows, "composite STRING, bands ARRAY<STRING>")


def guide_table(spark: SparkSession) -> DataFrame:
    """Guide text per index in canonical order (11 rows)."""
    rows = [(i, n, *INDEX_GUIDE[n]) for i, n in enumerate(INDEX_NAMES)]
    return spark.createDataFrame(rows, "pos INT, index STRING, measures STRING, high STRING, low STRING, caution STRING")


def class_table(spark: SparkSession, classes) -> DataFrame:
    """Half-open classes as a table: (class_no, class, lo, hi)."""
    rows = [(i + 1, c[0], c[1], c[2]) for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, "class_no INT, class STRING, lo DOUBLE, hi DOUBLE")


def credits_table(spark: SparkSession) -> DataFrame:
    """Price per radar job (3 rows)."""
    return spark.createDataFrame(sorted(CREDITS.items()), "res_m INT, credits INT")
