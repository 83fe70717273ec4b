"""Stacks of images in .npy files, read slab by slab.

The driver reads headers only. Positions are read by the tasks that need them,
subsets are filters of the table of positions, and a partition takes whole slabs of
the stack, each with one read. All paths must be open to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.operators.partition import numbered
from wavesift.plans.session import checkpoint
from wavesift.sources.files import Corrections
from wavesift.sources.frames import FRAMES

#: Bytes of images that one read takes, about.
SLAB_BYTES = 64 << 20
POSITIONS = "at long, y double, x double, keep boolean"


def header(path: str) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a .npy file."""
    a = np.load(path, mmap_mode="r")
    return a.shape, a.dtype


def axes(frames: int, slow: tuple[int, ...], fast: tuple[int, ...]) -> int:
    """0 where each frame has its own two positions, else the length of the fast axis of a grid."""
    if slow == fast and int(np.prod(slow)) == frames:
        return 0
    if len(slow) == len(fast) == 1 and slow[0] * fast[0] == frames:
        return fast[0]
    raise ValueError(f"positions of shapes {slow} and {fast} don't fit {frames} frames")


def slab_frames(shape: tuple[int, ...], dtype: np.dtype) -> int:
    """Frames of a slab: whole rows of the first axis where these are not too large, else as many as SLAB_BYTES hold."""
    image = max(1, int(np.prod(shape[-2:])) * dtype.itemsize)
    most, row = max(1, SLAB_BYTES // image), int(np.prod(shape[1:-2]))
    return most // row * row if 1 < row <= most else most


def positions(spark: SparkSession, path: str, slow: str, fast: str, keep: str | None = None) -> DataFrame:
    """(at, y, x, keep) of every frame of the stack at ``path``; each task reads its part of the position files."""
    shape, dtype = header(path)
    frames, slab = int(np.prod(shape[:-2])), slab_frames(shape, dtype)
    width = axes(frames, header(slow)[0], header(fast)[0])
    if keep is not None and int(np.prod(header(keep)[0])) != frames:
        raise ValueError(f"a filter of shape {header(keep)[0]} doesn't fit {frames} frames")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ys, xs = (np.load(p, mmap_mode="r").reshape(-1) for p in (slow, fast))
        used = None if keep is None else np.load(keep, mmap_mode="r").reshape(-1)
        for pdf in batches:
            for start in pdf["id"].tolist():
                at = np.arange(start, min(start + slab, frames))
                i, j = (at // width, at % width) if width else (at, at)
                yield pd.DataFrame({"at": at, "y": ys[i].astype(float), "x": xs[j].astype(float), "keep": True if used is None else used[at].astype(bool)})

    return spark.range(0, frames, slab).mapInPandas(run, POSITIONS)


def within(box: tuple[tuple[float, float], tuple[float, float]]) -> Column:
    (y0, y1), (x0, x1) = box
    return F.col("y").between(y0, y1) & F.col("x").between(x0, x1)


def read_slabs(spark: SparkSession, path: str, slow: str, fast: str, resolution: float = 1.0, corrections: Corrections | None = None, keep: str | None = None, box: tuple[tuple[float, float], tuple[float, float]] | None = None, skip: int = 1) -> DataFrame:
    """Frames of the stack at ``path`` with their places, as files.read_npy gives them.

    ``slow``, ``fast`` and ``keep`` (a filter by frame) are .npy files: two grids or
    lists of positions, or the two axes of a grid. A filter, a bounding box and a
    stride pick frames, in this sequence; ``frame_idx`` counts those that are used,
    and the least of their positions is pixel 0. Images must be square after the
    crop of ``corrections``.
    """
    shape, dtype = header(path)
    own, slab = corrections or Corrections(), slab_frames(shape, dtype)
    used = positions(spark, path, slow, fast, keep).filter("keep")
    if box is not None:
        used = used.filter(within(box))
    index = numbered(used.select("at", "y", "x"), ["at"], "used").filter(F.col("used") % skip == 0)
    index = checkpoint(index.withColumn("frame_idx", F.floor(F.col("used") / skip)))
    low = index.agg(F.min("y"), F.min("x")).first()
    places = index.select(
        F.floor(F.col("at") / slab).alias("slab"), "at", "frame_idx",
        *[F.rint((F.col(c) - F.lit(b if b is not None else 0.0)) / resolution).cast("int").alias(n) for c, b, n in (("y", low[0], "r0"), ("x", low[1], "c0"))],
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r").reshape(-1, *shape[-2:])
        for pdf in batches:
            for _, part in pdf.groupby("slab", sort=False):
                at = part["at"].to_numpy()
                images = np.asarray(data[at[0] : at[-1] + 1])  # one read
                rows = []
                for row in part.itertuples():
                    x, m = own.apply(int(row.at), images[row.at - at[0]])
                    if x.shape[0] != x.shape[1]:
                        raise ValueError(f"images of {x.shape} are not square; crop them")
                    rows.append((row.frame_idx, row.r0, row.c0, x.shape[0], x.astype("<f4").tobytes(), (m > 0).astype(np.uint8).tobytes()))
                yield pd.DataFrame(rows, columns=["frame_idx", "r0", "c0", "n", "intensity", "mask"])

    return places.repartition("slab").sortWithinPartitions("slab", "at").mapInPandas(run, FRAMES)
