"""Corpus preparation as stages over ``documents``; each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eoframe.llm import exact, mixing, packing, simhash, toxicity
from eoframe.session import ensure_checkpoint_dir

NEAR_WORDS = 5
NEAR_LEAST = 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share 0.8 or more of their five-word shingles."""
    return simhash.drop_near(docs, width=NEAR_WORDS, least=NEAR_LEAST)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# trained scores, fingerprints and token ids are beyond SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result as Parquet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for no, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{no}")
        docs = spark.read.parquet(f"{shared}/{no}")
    return docs
