"""Reductions: norms, products, centroids, block means, exposure merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm2(re: str, im: str) -> Column:
    return F.sum(F.col(re) * F.col(re) + F.col(im) * F.col(im))


def norm(re: str, im: str) -> Column:
    return F.sqrt(norm2(re, im))


def cdot(are: Column, aim: Column, bre: Column, bim: Column) -> tuple[Column, Column]:
    """Sum of conj(a) b: real and imaginary part."""
    return F.sum(are * bre + aim * bim), F.sum(are * bim - aim * bre)


def mass_center(df: DataFrame, keys: Sequence[str], weight: Column, coords: dict[str, Column]) -> DataFrame:
    """Weighted centroid of each group; null where the weights sum to zero."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(*[F.when(total != 0, F.sum(weight * c) / total).alias(n) for n, c in coords.items()])


def auto_center(df: DataFrame, frame: str, weight: Column, coords: dict[str, Column]) -> DataFrame:
    """Mean over frames of each frame's centroid, all frames alike."""
    return mass_center(df, [frame], weight, coords).agg(*[F.avg(n).alias(n) for n in coords])


def radial_distribution(df: DataFrame, value: Column, distance: Column, radii: Sequence[float]) -> DataFrame:
    """(radius, mass): what lies strictly within each radius, in one pass without a join."""
    sums = df.agg(*[F.sum(F.when(distance < r, value).otherwise(0.0)).alias(f"m{i}") for i, r in enumerate(radii)])
    rows = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"m{i}").alias("mass")) for i, r in enumerate(radii)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def rebin_mean(df: DataFrame, keys: Sequence[str], axes: dict[str, int], value: str) -> DataFrame:
    """Block means: each axis is cut into blocks of its factor."""
    blocks = [F.floor(F.col(a) / k).cast("long").alias(a) for a, k in axes.items()]
    return df.select(*keys, *blocks, value).groupBy(*keys, *axes).agg(F.avg(value).alias(value))


def rebin_mask(df: DataFrame, keys: Sequence[str], axes: dict[str, int], mask: str) -> DataFrame:
    """A block is valid only where its mean is the largest mean of all blocks."""
    means = rebin_mean(df.withColumn(mask, F.col(mask).cast("double")), keys, axes, mask)
    top = means.agg(F.max(mask)).scalar()
    return means.withColumn(mask, F.col(mask) == top)


def hdr_highest(df: DataFrame, keys: Sequence[str], image: Column, exposure: Column, valid: Column) -> DataFrame:
    """Of the valid exposures the longest, scaled by its time; null where none is valid."""
    return df.groupBy(*keys).agg(F.max_by(F.when(valid, image / exposure), F.when(valid, exposure)).alias("hdr"))


def hdr_average(df: DataFrame, keys: Sequence[str], image: Column, exposure: Column, valid: Column) -> DataFrame:
    """Mean of the valid exposures, each scaled by its time."""
    return df.groupBy(*keys).agg(F.avg(F.when(valid, image / exposure)).alias("hdr"))


def gram(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(i, j, dot) for i <= j over long vectors (key, index, value): an equi-join on the index."""
    a = df.select(F.col(key).alias("i"), F.col(index).alias("_k"), F.col(value).alias("_a"))
    b = df.select(F.col(key).alias("j"), F.col(index).alias("_k"), F.col(value).alias("_b"))
    return a.join(b, "_k").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def exposure_stats(df: DataFrame, frame: str, value: Column, npix: int) -> DataFrame:
    """Largest, total and mean power of frames, and the power bound: largest power by pixel."""
    frames = df.groupBy(frame).agg(F.sum(value).alias("itotal"))
    return frames.agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("itotal").alias("max_power"),
        F.sum("itotal").alias("tot_power"),
        (F.sum("itotal") / F.count(F.lit(1)) / npix).alias("mean_power"),
        (F.max("itotal") / npix).alias("pbound"),
    )


def pixel_stats(df: DataFrame, pixel: Sequence[str], value: Column, valid: Column) -> DataFrame:
    """Masked mean, largest, smallest and smallest-or-zero value of each pixel over frames."""
    n = F.sum(valid.cast("int"))
    masked = F.when(valid, value)
    return df.groupBy(*pixel).agg(
        (F.sum(F.coalesce(masked, F.lit(0.0))) / F.greatest(n, F.lit(1))).alias("mean"),
        F.max(masked).alias("max"),
        F.min(masked).alias("min"),
        F.least(F.min(masked), F.lit(0.0)).alias("min_clamped0"),
    )
