"""The driver tables seen as scan data, for the queries that DuckDB checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels: frame, bin, intensity, mask."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("bin"), F.col("l_quantity").alias("intensity"), (F.col("l_returnflag") != "R").alias("mask")
    )


PIXELS_SQL = "(SELECT l_orderkey AS frame, l_linenumber AS bin, l_quantity AS intensity, l_returnflag <> 'R' AS mask FROM lineitem)"


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: vec_id, k, v."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


VECTOR_SQL = "(SELECT vec_id, label, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as complex vectors: even elements are real parts, odd ones imaginary parts."""
    e = F.col("embedding")
    pair = F.transform(F.sequence(F.lit(1), F.size(e), F.lit(2)), lambda i: F.struct(F.element_at(e, i).cast("double").alias("re"), F.element_at(e, i + 1).cast("double").alias("im")))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(pair).alias("k", "z")).select("vec_id", "label", "k", "z.re", "z.im")


WAVES_SQL = f"(SELECT a.vec_id, a.label, a.k // 2 AS k, a.v AS re, b.v AS im FROM {VECTOR_SQL} a JOIN {VECTOR_SQL} b ON a.vec_id = b.vec_id AND b.k = a.k + 1 WHERE a.k % 2 = 0)"


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) + 0.0 for c in columns})
