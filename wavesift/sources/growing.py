"""Scans whose files still grow: frames by pull and as a stream.

A scan is a file of images and two of positions, all of records of one size that
another process appends to. A frame is there once all three files have it. A file
named by ``end`` marks the end of the scan. Paths must be open to every executor.

    spark.dataSource.register(GrowingSource)
    spark.readStream.format("growing").options(data=..., slow=..., fast=..., n=64).load()
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wavesift.sources.frames import FRAMES
from wavesift.streaming.live import FrameFeed

#: Frames that one task reads.
SLAB = 256


@dataclass(frozen=True)
class GrowingScan:
    """Images (n by n of ``dtype``) in ``data``; positions as doubles in ``slow`` and ``fast``, in units of ``resolution``."""

    data: str
    slow: str
    fast: str
    n: int
    dtype: str = "<f4"
    resolution: float = 1.0
    end: str = ""

    def count(self) -> int:
        """Frames that all files have whole."""
        sizes = ((self.data, self.n * self.n * np.dtype(self.dtype).itemsize), (self.slow, 8), (self.fast, 8))
        return min(os.path.getsize(p) // size if os.path.exists(p) else 0 for p, size in sizes)

    def ended(self) -> bool:
        return bool(self.end) and os.path.exists(self.end)

    def rows(self, lo: int, hi: int) -> Iterator[tuple]:
        """Frames lo to hi, the end left out; one read of each file."""
        images = np.fromfile(self.data, self.dtype, (hi - lo) * self.n**2, offset=lo * self.n**2 * np.dtype(self.dtype).itemsize)
        ys, xs = (np.fromfile(p, "<f8", hi - lo, offset=8 * lo) for p in (self.slow, self.fast))
        good = np.ones(self.n**2, np.uint8).tobytes()
        for k, (image, y, x) in enumerate(zip(images.reshape(hi - lo, -1), ys, xs, strict=True)):
            yield lo + k, round(y / self.resolution), round(x / self.resolution), self.n, image.astype("<f4").tobytes(), good

    def load(self, spark: SparkSession, lo: int, hi: int) -> DataFrame:
        """Frames lo to hi as a table; tasks read SLAB frames each."""
        names = [f.split()[0] for f in FRAMES.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in pdf["id"].tolist():
                    yield pd.DataFrame(list(self.rows(start, min(start + SLAB, hi))), columns=names)

        return spark.range(lo, hi, SLAB).mapInPandas(run, FRAMES)

    def feed(self, spark: SparkSession, total: int | None = None, min_frames: int = 1) -> FrameFeed:
        """Pulls: chunks, WAIT while too few frames are there, EOS after the last of ``total``."""
        return FrameFeed(self.count, lambda a, b: self.load(spark, a, b), total, min_frames)


class Slab(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceStreamReader):
    """Offsets are numbers of frames. A batch takes ``per_batch`` frames at most, and waits for ``min_frames`` until the scan ends.

    Spark asks for the latest offset before it says where a stream stands, so the
    place of the last batch is kept in the file that the option ``progress`` names,
    one for each stream; without it the first batch after a start takes all that is there.
    """

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.scan = GrowingScan(given["data"], given["slow"], given["fast"], int(given["n"]), given.get("dtype", "<f4"), float(given.get("resolution", 1)), given.get("end", ""))
        self.per_batch, self.min_frames = int(given.get("per_batch", 1 << 62)), int(given.get("min_frames", 1))
        self.progress = given.get("progress", "")
        self.at = self._kept()

    def _kept(self) -> int | None:
        if not self.progress:
            return None
        if not os.path.exists(self.progress):
            return 0
        with open(self.progress) as f:
            return int(f.read())

    def _keep(self, at: int) -> None:
        self.at = max(self.at or 0, at)
        if self.progress:
            with open(f"{self.progress}.new", "w") as f:
                f.write(str(self.at))
            os.replace(f"{self.progress}.new", self.progress)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"frames": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        ended = self.scan.ended()  # looked at first: what is there after it is the whole scan
        there = self.scan.count()
        if self.at is None:
            return {"frames": there}
        enough = there - self.at >= self.min_frames or ended
        return {"frames": min(there, self.at + self.per_batch) if enough else self.at}

    def partitions(self, start: dict, end: dict) -> list[Slab]:
        self._keep(end["frames"])
        return [Slab(a, min(a + SLAB, end["frames"])) for a in range(start["frames"], end["frames"], SLAB)]

    def read(self, partition: Slab) -> Iterator[tuple]:
        return self.scan.rows(partition.lo, partition.hi)

    def commit(self, end: dict) -> None:
        self._keep(end["frames"])


class GrowingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(dict(self.options))
