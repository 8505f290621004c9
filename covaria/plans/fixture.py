"""The fixture view of the driver's tables: located cells with three types on two slides, and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.sources.cells import from_arrays

TYPES = ("T0", "T1", "T2")
FIRST_GENE = 4


def cells(spark: SparkSession, sf_dir: str, slides: bool = True) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.element_at("embedding", k).cast("double")
    slide = F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")) if slides else F.lit("slide1")
    return e.select(slide.alias("slide"), F.col("vec_id").alias("cell_id"), F.concat(F.lit("T"), (F.col("label") % 3).cast("string")).alias("cell_type"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", FIRST_GENE)


def fixed_scores(spark: SparkSession, sf_dir: str, slides: bool = True) -> DataFrame:
    """Two components that are features themselves, for queries that need scores independent of any solver."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), "embedding")
    both = e.select("cell_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cc"), F.element_at("embedding", 3 + c).cast("double").alias("score")) for c in (1, 2)])).alias("s"))
    return both.join(cells(spark, sf_dir, slides), "cell_id").select("slide", "cell_type", "cell_id", "s.cc", "s.score")
