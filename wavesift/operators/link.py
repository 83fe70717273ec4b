"""Linking frames, windows and geometries by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_coordinate(coord: Column, psize: float, origin: float = 0.0) -> tuple[Column, Column]:
    """(whole pixel, remainder): rounded half to even after a nudge of 1e-5."""
    p = (coord - origin) / psize
    whole = F.rint(p + 1e-5)
    return whole.cast("long"), p - whole


def update_views(views: DataFrame, coord: str, psize: float, size: Column | int, prefix: str = "") -> DataFrame:
    """Adds dcoord, lo, hi (end exclusive) and sp, the part of a pixel that is left."""
    n = size if isinstance(size, Column) else F.lit(size)
    whole, rest = pixel_coordinate(F.col(coord), psize)
    d = f"{prefix}dcoord"
    return views.withColumn(d, whole).withColumns({
        f"{prefix}lo": F.col(d) - F.floor(n / 2), f"{prefix}hi": F.col(d) + F.floor((n + 1) / 2), f"{prefix}sp": rest,
    })


def reformat_bounds(views: DataFrame, storage: Sequence[str], lo: str, hi: str, layer: str, active: Column | None = None) -> DataFrame:
    """Bounds of all active windows of a storage and its distinct layers in order."""
    own = views if active is None else views.filter(active)
    return own.groupBy(*storage).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.sort_array(F.collect_set(layer)).alias("layers"))


def view_coverage(views: DataFrame, keys: Sequence[str], axes: dict[str, tuple[str, str]]) -> DataFrame:
    """How many windows cover each pixel. Windows are spread over their pixels and counted: no range join."""
    out = views
    for name, (lo, hi) in axes.items():
        out = out.filter(F.col(hi) > F.col(lo)).withColumn(name, F.explode(F.sequence(F.col(lo), F.col(hi) - 1)))
    return out.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("coverage"))


def link_pods(frames: DataFrame, positions: DataFrame, geometry: DataFrame, frame: str, geo: str) -> DataFrame:
    """The star join: a frame with its position and its geometry."""
    return frames.join(positions, frame).join(geometry, geo)


def mode_pods(frames: DataFrame, index: str, probe_modes: int, object_modes: int) -> DataFrame:
    """Every frame with every probe and object mode; exit_index = index 10000 + pm 100 + om."""
    modes = F.array(*[F.struct(F.lit(p).alias("pm"), F.lit(o).alias("om")) for p in range(probe_modes) for o in range(object_modes)])
    out = frames.withColumn("_m", F.explode(modes))
    return out.select("*", "_m.pm", "_m.om", (F.col(index) * 10000 + F.col("_m.pm") * 100 + F.col("_m.om")).cast("long").alias("exit_index")).drop("_m")


def opr_pods(frames: DataFrame, index: str, modes: int) -> DataFrame:
    """A probe layer of its own for each frame and mode: layer = index modes + mode."""
    out = frames.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(modes - 1))))
    return out.withColumn("layer", F.col(index) * modes + F.col("mode"))


def tolerance_key(value: Column, tolerance: float) -> Column:
    """Equal for values that round to the same multiple of ``tolerance``."""
    return F.rint(value / tolerance).cast("long")


def key_scatter(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Entries whose key is asked for."""
    return table.join(keys.select(key).distinct(), key, "left_semi")
