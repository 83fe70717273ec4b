"""Scatter-add of patches onto images, and the updates built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter_add(patches: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Sums of patch pixels that fall on the same image pixel; partial sums are made before the shuffle."""
    return patches.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def spread(df: DataFrame, center: str, half: int, to: str) -> DataFrame:
    """Each row once for each pixel within ``half`` of its centre."""
    return df.withColumn(to, F.explode(F.sequence(F.col(center) - half, F.col(center) + half)))


def object_update(current: Column, num: Column, den: Column, inertia: float) -> Column:
    """(c o + num) / (c + den)."""
    return (inertia * current + num) / (inertia + den)


def wasp_average(num: Column, den: Column, least: float = 1e-8) -> Column:
    """num / den, or num where the denominator is as good as zero."""
    return F.when(F.abs(den) < least, num).otherwise(num / den)


def stxm(patches: DataFrame, keys: Sequence[str], transmission: Column, weight: Column) -> DataFrame:
    """Weighted mean transmission of each image pixel: num, den and trans."""
    return scatter_add(patches, keys, num=transmission * weight, den=weight).withColumn("trans", F.col("num") / (F.col("den") + 1e-10))
