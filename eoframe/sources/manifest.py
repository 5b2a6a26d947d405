"""Order manifests: parameters of a radar order and its jobs, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe import dims

MANIFEST_SCHEMA = (
    "nombre_lote STRING, anio INT, traza INT, direccion STRING, resolucion_m INT, filtro_speckle BOOLEAN, "
    "polarizacion STRING, meses_seca ARRAY<INT>, meses_lluvia ARRAY<INT>, bbox_4326 ARRAY<DOUBLE>, "
    "creditos_estimados BIGINT, trabajos ARRAY<STRUCT<job_id: STRING, granule: STRING, status_code: STRING, expiration_time: STRING>>"
)
ORDER_COLUMNS = [c.strip().split(" ")[0] for c in MANIFEST_SCHEMA.split(", trabajos")[0].replace("ARRAY<INT>", "A").split(", ")]


def write_order_manifest(manifests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per order; an order's manifest is never silently replaced."""
    manifests.write.mode(mode).json(path)


def split_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, jobs) of manifest rows; missing month lists get the defaults."""
    def months(c: str, default):
        return F.coalesce(F.col(c), F.array(*[F.lit(m) for m in default])).alias(c)

    orders = manifests.select(
        *[c for c in ORDER_COLUMNS if c not in ("meses_seca", "meses_lluvia")],
        months("meses_seca", dims.DRY_MONTHS),
        months("meses_lluvia", dims.WET_MONTHS),
    )
    jobs = manifests.select(F.col("nombre_lote").alias("batch_name"), F.explode("trabajos").alias("j")).select("batch_name", "j.*")
    return orders, jobs


def read_order_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(orders, jobs) of the manifests under ``path``."""
    return split_manifests(spark.read.schema(MANIFEST_SCHEMA).json(path))


def parse_manifests(texts: DataFrame, text: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """(orders, jobs) of manifests held as text."""
    rows = texts.select(F.from_json(F.col(text), MANIFEST_SCHEMA).alias("m")).where("m IS NOT NULL").select("m.*")
    return split_manifests(rows)
