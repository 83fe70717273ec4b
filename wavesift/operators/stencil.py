"""Finite differences and neighbourhood filters on long-form images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def delxf(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Forward difference; 0 at the end."""
    return F.coalesce(F.lead(value).over(_line(keys, order)) - value, F.lit(0.0))


def delxb(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Backward difference; 0 at the start."""
    return F.coalesce(value - F.lag(value).over(_line(keys, order)), F.lit(0.0))


def delxc(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Central difference; one-sided at both ends."""
    w = _line(keys, order)
    nxt, prv = F.lead(value).over(w), F.lag(value).over(w)
    return F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) / 2.0).otherwise(F.coalesce(nxt - value, value - prv, F.lit(0.0)))


def regul_del2(df: DataFrame, keys: Sequence[str], axes: Sequence[str], re: str, im: str, amplitude: float) -> DataFrame:
    """Squared-gradient regulariser: gradient of each pixel and its cost, summed by the caller.

    Adds g_re, g_im: 2 A sum over axes of (backward - forward difference), and
    cost: A sum over axes of the squared moduli of both differences.
    """
    grads = {"re": F.lit(0.0), "im": F.lit(0.0)}
    cost = F.lit(0.0)
    for axis in axes:
        line = [*keys, *(a for a in axes if a != axis)]
        for part, name in (("re", re), ("im", im)):
            fwd, bwd = delxf(F.col(name), line, [axis]), delxb(F.col(name), line, [axis])
            grads[part] = grads[part] + (bwd - fwd)
            cost = cost + fwd * fwd + bwd * bwd
    return df.select("*", (2 * amplitude * grads["re"]).alias("g_re"), (2 * amplitude * grads["im"]).alias("g_im"), (amplitude * cost).alias("cost"))


def remove_hot_pixels(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, tolerance: float = 3.0) -> DataFrame:
    """Pixels that differ from their 3x3 median by more than tolerance x std of all such differences.

    Every pixel is sent to its nine neighbours and grouped there, so one equi-join
    free shuffle serves the median. Edges take the median of the neighbours that
    exist; the standard deviation is that of the differences inside a key.

    Adds median, hot and fixed.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = df.select(*keys, F.col(row), F.col(col), F.col(value), F.explode(offsets).alias("_o"))
    sent = sent.select(
        *keys, (F.col(row) + F.col("_o.i")).alias(row), (F.col(col) + F.col("_o.j")).alias(col),
        F.col(value).alias("_v"), F.when((F.col("_o.i") == 0) & (F.col("_o.j") == 0), F.col(value)).alias("_own"),
    )
    local = sent.groupBy(*keys, row, col).agg(F.median("_v").alias("median"), F.max("_own").alias(value)).filter(F.col(value).isNotNull())
    spread = local.groupBy(*keys).agg(F.stddev_pop(F.col(value) - F.col("median")).alias("_sd"))
    joined = local.join(spread, list(keys)) if keys else local.withColumn("_sd", spread.scalar())
    hot = F.abs(F.col(value) - F.col("median")) > tolerance * F.col("_sd")
    return joined.withColumn("hot", hot).withColumn("fixed", F.when(F.col("hot"), F.col("median")).otherwise(F.col(value))).drop("_sd")


def remove_phase_ramp(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str) -> DataFrame:
    """Multiply by exp(-i (gy r + gx c)), g the modulus-weighted mean phase step along either axis.

    Adds out_re, out_im.
    """
    steps = {}
    for axis, other in ((row, col), (col, row)):
        w = _line([*keys, other], [axis])
        nre, nim = F.lead(re).over(w), F.lead(im).over(w)
        steps[axis] = F.atan2(nim * F.col(re) - nre * F.col(im), nre * F.col(re) + nim * F.col(im))
    weight = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    with_steps = df.withColumn("_w", weight).withColumn("_gr", steps[row]).withColumn("_gc", steps[col])
    mean = lambda g: F.sum(F.col(g) * F.col("_w")) / F.sum(F.when(F.col(g).isNotNull(), F.col("_w")))
    ramp = with_steps.groupBy(*keys).agg(F.coalesce(mean("_gr"), F.lit(0.0)).alias("_mr"), F.coalesce(mean("_gc"), F.lit(0.0)).alias("_mc"))
    phi = F.col("_mr") * F.col(row) + F.col("_mc") * F.col(col)
    joined = df.join(ramp, list(keys)) if keys else df.withColumn("_mr", ramp.select("_mr").scalar()).withColumn("_mc", ramp.select("_mc").scalar())
    return joined.withColumn("out_re", F.col(re) * F.cos(phi) + F.col(im) * F.sin(phi)).withColumn("out_im", F.col(im) * F.cos(phi) - F.col(re) * F.sin(phi)).drop("_mr", "_mc")
