"""Scan patterns as DataFrames (idx, y, x), generated in place and never on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster_scan(spark: SparkSession, dy: float = 1.5e-6, dx: float = 1.5e-6, ny: int = 10, nx: int = 10, angle: float = 0.0) -> DataFrame:
    """nx ny points; y = dx i is the slow coordinate, x = dy j the fast one; rotated by ``angle`` degrees."""
    ids = spark.range(nx * ny)
    i, j = F.floor(F.col("id") / ny).cast("double"), F.pmod(F.col("id"), F.lit(ny)).cast("double")
    if angle:
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        i, j = c * i + s * j, c * j - s * i
    return ids.select(F.col("id").alias("idx"), (F.lit(dx) * i).alias("y"), (F.lit(dy) * j).alias("x"))


def round_scan(spark: SparkSession, dr: float = 1.5e-6, nr: int = 5, nth: int = 5, bullseye: bool = True) -> DataFrame:
    """Shells 1 to nr + 1 with nth points for each of their number, and the origin."""
    shells = spark.range(1, nr + 2).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), (F.col("id") * nth - 1).cast("int"))).alias("t"))
    first = 1 if bullseye else 0
    before = F.lit(nth) * F.col("k") * (F.col("k") - 1) / 2
    phi = F.col("t") * (2 * math.pi / (F.lit(nth) * F.col("k")))
    out = shells.select((before + F.col("t") + first).cast("long").alias("idx"), (F.col("k") * dr * F.sin(phi)).alias("y"), (F.col("k") * dr * F.cos(phi)).alias("x"))
    if not bullseye:
        return out
    return spark.range(1).select(F.col("id").alias("idx"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x")).unionByName(out)


def spiral_scan(spark: SparkSession, dr: float = 1.5e-6, r: float = 7.5e-6, maxpts: int = 100_000) -> DataFrame:
    """Points at angle sqrt(4 pi k) and radius dr / 2 pi times that, up to radius r."""
    theta = F.lit(math.sqrt(4 * math.pi)) * F.sqrt(F.col("id").cast("double"))
    rr = F.lit(dr / (2 * math.pi)) * theta
    return spark.range(maxpts).filter(rr <= r).select(F.col("id").alias("idx"), (rr * F.sin(theta)).alias("y"), (rr * F.cos(theta)).alias("x"))


def from_pars(positions: DataFrame, offset: tuple[float, float] = (0.0, 0.0), extent: tuple[float, float] | None = (15e-6, 15e-6), count: int | None = None) -> DataFrame:
    """Offset added, then an inclusive box of ``extent`` about the origin, then the first ``count``."""
    out = positions.withColumn("y", F.col("y") + offset[0]).withColumn("x", F.col("x") + offset[1])
    if extent:
        out = out.filter(F.col("y").between(-extent[0] / 2, extent[0] / 2) & F.col("x").between(-extent[1] / 2, extent[1] / 2))
    return out.orderBy("idx").limit(count) if count else out


def augment(positions: DataFrame, n: int, of: int) -> DataFrame:
    """``of`` positions repeated until there are ``n``."""
    ids = positions.sparkSession.range(n).withColumn("_k", F.pmod("id", F.lit(of)))
    return ids.join(positions.withColumnRenamed("idx", "_k"), "_k").select(F.col("id").alias("idx"), "y", "x")


def drift_positions(positions: DataFrame, drift: float = 0.0, scale: float = 0.0, noise: float | None = 0.0, seed: int = 0) -> DataFrame:
    """Positions moved by ``drift`` and seeded normal noise; unchanged where noise is None."""
    if noise is None:
        return positions
    return positions.withColumn("y", F.col("y") + drift + scale * noise * F.randn(seed)).withColumn("x", F.col("x") + drift + scale * noise * F.randn(seed + 1))
