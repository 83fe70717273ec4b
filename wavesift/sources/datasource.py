"""Synthetic frames as a Python data source, for batches and for streams.

    spark.dataSource.register(MoonflowerSource)
    spark.read.format("moonflower").option("frames", 100).option("shape", 32).load()
    spark.readStream.format("moonflower").option("frames", 100).option("per_batch", 10).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wavesift.sources.frames import FRAMES


class Block(InputPartition):
    """Frames lo to hi, the end left out."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _frames(options: dict, lo: int, hi: int) -> Iterator[tuple]:
    from wavesift.functions import generate

    n, total, density = int(options.get("shape", 32)), int(options.get("frames", 100)), float(options.get("density", 0.2))
    side, step = int(np.ceil(np.sqrt(total))), max(1, round(n * density))
    size = n + step * (side - 1) + 2
    probe, obj = generate.moon(n, float(options.get("photons", 1e6))), generate.flower((size, size))
    mask = np.ones(n * n, np.uint8).tobytes()
    for k in range(lo, hi):
        r, c = k // side * step, k % side * step
        counts = np.floor(generate.diffraction(probe, obj[r : r + n, c : c + n]))
        yield k, r, c, n, counts.astype("<f4").tobytes(), mask


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Block]:
        total, size = int(self.options.get("frames", 100)), int(self.options.get("per_task", 64))
        return [Block(a, min(a + size, total)) for a in range(0, total, size)]

    def read(self, partition: Block) -> Iterator[tuple]:
        return _frames(self.options, partition.lo, partition.hi)


class _StreamReader(DataSourceStreamReader):
    """Each batch brings ``per_batch`` more frames until all are there; offsets are frame numbers."""

    def __init__(self, options: dict):
        self.options, self.at = options, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + int(self.options.get("per_batch", 10)), int(self.options.get("frames", 100)))
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        self.at = max(self.at, end["frame"])
        size = int(self.options.get("per_task", 64))
        return [Block(a, min(a + size, end["frame"])) for a in range(start["frame"], end["frame"], size)]

    def read(self, partition: Block) -> Iterator[tuple]:
        return _frames(self.options, partition.lo, partition.hi)

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be dropped."""


class MoonflowerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "moonflower"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))
