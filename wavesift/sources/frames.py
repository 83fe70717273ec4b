"""Frames as rows, and synthetic scans that make them on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import generate
from wavesift.operators.link import pixel_coordinate
from wavesift.operators.scan import raster_scan, spiral_scan

#: r0, c0: first object row and column that a frame sees; images are float32 and uint8 bytes in row order.
FRAMES = "frame_idx long, r0 int, c0 int, n int, intensity binary, mask binary"


def to_frames(positions: DataFrame, n: int, image: Callable[[int, int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Frames of rows (idx, r0, c0): ``image`` makes (intensity, mask) of (idx, r0, c0) on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, r, c in zip(pdf["idx"], pdf["r0"], pdf["c0"], strict=True):
                a, m = image(int(i), int(r), int(c))
                rows.append((i, r, c, n, a.astype("<f4").tobytes(), m.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["frame_idx", "r0", "c0", "n", "intensity", "mask"])

    return positions.select("idx", "r0", "c0").mapInPandas(run, FRAMES)


def moonflower(spark: SparkSession, num_frames: int = 100, n: int = 32, density: float = 0.2, photons: float = 1e6, noise: bool = False, psf: float = 0.0, seed: int = 0, partitions: int = 4) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(frames, probe, object) of a crescent probe over a flower on a square raster; whole counts."""
    side = int(np.ceil(np.sqrt(num_frames)))
    step = max(1, round(n * density))
    size = n + step * (side - 1) + 2
    probe, obj = generate.moon(n, photons), generate.flower((size, size))
    detector = generate.Detector(psf=psf, shot_noise=noise)

    def image(idx: int, r: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        counts, mask = detector.filter(generate.diffraction(probe, obj[r : r + n, c : c + n]), seed + idx)
        return counts, mask

    positions = raster_scan(spark, 1.0, 1.0, side, side).filter(F.col("idx") < num_frames).select("idx", (F.col("y") * step).cast("int").alias("r0"), (F.col("x") * step).cast("int").alias("c0"))
    return to_frames(positions.repartitionByRange(partitions, "idx"), n, image), probe, obj


def simulated(spark: SparkSession, probe: np.ndarray, obj: np.ndarray, positions: DataFrame, psize: float, detector: generate.Detector | None = None, seed: int = 0) -> DataFrame:
    """Frames of any probe and object at physical positions (idx, y, x); those off the object are left out."""
    n, detector = probe.shape[-1], detector or generate.Detector()
    (r, _), (c, _) = pixel_coordinate(F.col("y"), psize), pixel_coordinate(F.col("x"), psize)
    placed = positions.select("idx", (r + obj.shape[0] // 2 - n // 2).cast("int").alias("r0"), (c + obj.shape[1] // 2 - n // 2).cast("int").alias("c0"))
    inside = F.col("r0").between(0, obj.shape[0] - n) & F.col("c0").between(0, obj.shape[1] - n)
    return to_frames(placed.filter(inside), n, lambda i, y, x: detector.filter(generate.diffraction(probe, obj[y : y + n, x : x + n]), seed + i))


def quickscan(spark: SparkSession, num_frames: int, n: int = 32) -> DataFrame:
    """Frames of ones, for timing what is built around them."""
    return to_frames(spiral_scan(spark, 1.0, 1e9, num_frames).select("idx", F.lit(0).alias("r0"), F.lit(0).alias("c0")), n, lambda i, r, c: (np.ones((n, n)), np.ones((n, n))))


def pixels(frames: DataFrame) -> DataFrame:
    """Long form (frame_idx, r, c, i, m) of frames, for the SQL operators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, n, a, m in zip(pdf["frame_idx"], pdf["n"], pdf["intensity"], pdf["mask"], strict=True):
                r, c = np.indices((n, n), dtype=np.int32)
                yield pd.DataFrame({"frame_idx": f, "r": r.ravel(), "c": c.ravel(), "i": np.frombuffer(a, "<f4").astype(float), "m": np.frombuffer(m, np.uint8) > 0})

    return frames.select("frame_idx", "n", "intensity", "mask").mapInPandas(run, "frame_idx long, r int, c int, i double, m boolean")


def prepare(frames: DataFrame, n: int, center: tuple[int, int] | None = None, orientation: int = 0, rebin: int = 1, dark: np.ndarray | None = None, flat: np.ndarray | None = None, mask: np.ndarray | None = None) -> DataFrame:
    """Dark and flat correction, crop or pad to n about the centre, orientation and binning of every frame."""
    from wavesift.functions import arrays

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images, masks, sizes = [], [], []
            for size, a, m in zip(pdf["n"], pdf["intensity"], pdf["mask"], strict=True):
                x, w = np.frombuffer(a, "<f4").reshape(size, size).astype(float), np.frombuffer(m, np.uint8).reshape(size, size).astype(float)
                x = np.maximum(x - dark, 0) if dark is not None else x
                x = x / flat if flat is not None else x
                w = w * mask if mask is not None else w
                x, w = (arrays.orient(arrays.crop_pad_symmetric(y, (n, n), center)[0], orientation) for y in (x, w))
                if rebin > 1:
                    x, w = arrays.rebin(x, rebin), arrays.rebin(w, rebin)
                    w = w == w.max()
                images.append(x.astype("<f4").tobytes())
                masks.append((w > 0).astype(np.uint8).tobytes())
                sizes.append(x.shape[-1])
            yield pdf.assign(intensity=images, mask=masks, n=sizes)

    return frames.mapInPandas(run, FRAMES)


def auto_center(frames: DataFrame) -> tuple[float, float]:
    """Mean over frames of each frame's masked centroid; two numbers on the driver."""
    from wavesift.operators import reduce

    p = pixels(frames)
    r = reduce.auto_center(p, "frame_idx", F.col("i") * F.col("m").cast("int"), {"r": F.col("r"), "c": F.col("c")}).first()
    return r["r"], r["c"]
