"""The corpus pipeline: quality rules, near-duplicates, private data, mixing of sources, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of documents.  run() writes each stage's result as Parquet into the shared folder and reads it
again, so that a lost executor costs at most the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covaria.llm import mixing, neardup, packing, pii, quality
from covaria.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that the rules reject."""
    return quality.clean(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return neardup.keep_one(spark, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data is replaced by its kind."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix of sources takes them."""
    return mixing.mix_rows(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("private data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the random field nor the fingerprints' hash; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
