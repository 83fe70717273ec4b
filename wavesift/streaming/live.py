"""Live scans: pulling frames in chunks, and reconstructing while they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.operators.engines import State
from wavesift.sources.commits import Commits

WAIT, EOS = "WAIT", "EOS"


@dataclass
class FrameFeed:
    """Hands out frames by index: a chunk, WAIT if too few are there yet, EOS after the last.

    ``available`` says how many frames can be read now, ``total`` how many there
    will be (None: unknown), ``load`` reads a range of them.
    """

    available: Callable[[], int]
    load: Callable[[int, int], DataFrame]
    total: int | None = None
    min_frames: int = 1
    start: int = 0

    def next(self, frames: int) -> DataFrame | str:
        ready = max(0, self.available() - self.start)
        ended = self.total is not None and self.start + ready >= self.total
        if ended and not ready:
            return EOS
        if ready < min(self.min_frames, frames) and not ended or not ready:
            return WAIT
        n = min(frames, ready)
        chunk = self.load(self.start, self.start + n)
        self.start += n
        return chunk


def feed_of(frames: DataFrame, total: int | None = None, min_frames: int = 1) -> FrameFeed:
    """A feed of a table of frames that others may append to."""
    return FrameFeed(
        lambda: frames.agg(F.max("frame_idx")).first()[0] + 1 if frames.head(1) else 0,
        lambda a, b: frames.filter(F.col("frame_idx").between(a, b - 1)),
        total,
        min_frames,
    )


@dataclass
class LiveReconstruction:
    """A projection engine over frames as they arrive; the work of a batch is in proportion to its frames.

    ``make`` builds the engine from (frames, state). A batch's frames get waves of
    their own, which are projected ``iterations`` times; the waves of earlier
    batches stay as they are and count by their sums. Waves, sums and state are
    committed by epoch under ``path`` (in the shared folder): an epoch that is
    delivered again does no harm, and a new driver goes on from the last commit.
    Up to ``min_frames`` frames are only taken in. ``refine`` runs the engine over
    all waves so far.
    """

    make: Callable
    state: State
    path: str
    iterations: int = 1
    min_frames: int = 1

    def __post_init__(self):
        self.epoch, self.kept = -1, None
        self.commits = Commits(SparkSession.active(), self.path)
        if (last := self.commits.last()) >= 0:
            arrays, numbers = self.commits.read(last)
            self.state, self.epoch = State(arrays["probe"], arrays["obj"]), numbers["epoch"]
            self.kept = {"object": (arrays["object_num"], arrays["object_den"]), "probe": (arrays["probe_num"], arrays["probe_den"]), **numbers["totals"]}

    @property
    def frames_seen(self) -> int:
        return self.kept["frames"] if self.kept else 0

    def on_batch(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.epoch:
            return
        engine = self.make(batch, self.state)
        engine.kept = self.kept
        engine.run(0)
        if engine.totals["frames"] == self.frames_seen:
            return
        if engine.totals["frames"] >= self.min_frames:
            engine.run(self.iterations)
        self.state = engine.state
        self._commit(engine, epoch, self.kept, engine.totals)

    def _commit(self, engine, epoch: int, kept: dict | None, totals: dict) -> None:
        sums = engine.wave_sums()
        for name, (num, den) in sums.items():
            sums[name] = (num + kept[name][0], den + kept[name][1]) if kept else (num, den)
        arrays = {"probe": self.state.probe, "obj": self.state.obj} | {f"{k}_{part}": a for k, pair in sums.items() for part, a in zip(("num", "den"), pair, strict=True)}
        self.commits.write(epoch, arrays, {"epoch": epoch, "totals": totals}, engine.waves)
        self.epoch, self.kept = epoch, {**sums, **totals}

    def refine(self, iterations: int) -> State:
        """The engine over all waves that are committed. Nothing is committed by it."""
        waves = self.commits.all_waves(self.epoch)
        engine = self.make(waves.drop("exit", "err_fourier", "err_photon", "err_exit"), self.state)
        engine.waves = waves
        self.state = engine.run(iterations)
        return self.state

    def start(self, frames: DataFrame, checkpoint: str):
        """A query that ends once all that is there has been taken. Frames are told apart by index, also across batches."""
        own = frames.dropDuplicates(["frame_idx"])
        return own.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_chunks(frames: DataFrame, size: int) -> DataFrame:
    """Stream or batch: frames by chunk of ``size`` indices."""
    return frames.groupBy(F.floor(F.col("frame_idx") / size).alias("chunk")).agg(F.count(F.lit(1)).alias("frames"))
