"""Arithmetic between containers: long images joined on their pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {
    "iadd": lambda a, b: a + b,
    "isub": lambda a, b: a - b,
    "imul": lambda a, b: a * b,
    "itruediv": lambda a, b: a / b,
    "replace": lambda a, b: F.coalesce(b, a),
}


def combine(left: DataFrame, right: DataFrame | float, keys: Sequence[str], value: str, operation: str) -> DataFrame:
    """``left`` with its value combined with the other side's at the same key, or with a number."""
    f = OPERATIONS[operation]
    if not isinstance(right, DataFrame):
        return left.withColumn(value, f(F.col(value), F.lit(right)))
    other = right.select(*keys, F.col(value).alias("_other"))
    own: Column = F.col(value)
    return left.join(other, list(keys)).withColumn(value, f(own, F.col("_other"))).drop("_other")


def fill(df: DataFrame, value: str, number: float) -> DataFrame:
    return df.withColumn(value, F.lit(number))


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of the parts of all workers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
