"""Position refinement: candidate shifts of every frame, the best of which is kept if it is strictly better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.functions.propagate import fourier
from wavesift.operators.engines import State, frame_arrays, sent

MOVED = "frame_idx long, r0 int, c0 int, new_r0 int, new_c0 int, error double, old_error double"


def photon_metric(probe, patch, intensity, mask) -> float:
    return K.log_likelihood(probe, patch, intensity, mask, fourier)


METRICS = {"fourier": K.fourier_metric, "photon": photon_metric}


@dataclass(frozen=True)
class PositionRefinement:
    """``method`` 'GridSearch' tries all shifts within max_shift, 'Annealing' random ones of a falling amplitude."""

    start: int = 0
    stop: int = 1000
    interval: int = 1
    nshifts: int = 4
    amplitude: float = 2.0
    max_shift: float = 4.0
    method: str = "Annealing"
    metric: str = "fourier"
    amplitude_decay: bool = True
    seed: int = 0

    def due(self, iteration: int) -> bool:
        return self.start <= iteration < self.stop and iteration % self.interval == 0

    def amplitude_at(self, iteration: int) -> float:
        return self.amplitude * (self.stop - iteration) / (self.stop - self.start) if self.amplitude_decay else self.amplitude

    def shifts(self, frame: int, iteration: int) -> list[tuple[int, int]]:
        if self.method == "GridSearch":
            return K.grid_shifts(int(self.max_shift))
        return K.random_shifts(self.nshifts, self.amplitude_at(iteration), self.max_shift, hash((self.seed, frame, iteration)) % 2**32)


def refine(frames: DataFrame, state: State, how: PositionRefinement, iteration: int = 0) -> DataFrame:
    """Old and new place of every frame with both errors. Candidates stay inside a frame's task."""
    shared = sent(frames.sparkSession, state.probe, state.obj)
    metric = METRICS[how.metric]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, obj = shared.value
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                r, c, _, intensity, mask = frame_arrays(row)
                dr, dc, err, here = K.best_shift(probe, obj, r, c, how.shifts(int(row.frame_idx), iteration), intensity, mask, metric)
                rows.append((row.frame_idx, r, c, r + dr, c + dc, err, here))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in MOVED.split(", ")])

    return frames.mapInPandas(run, MOVED)


def refined(frames: DataFrame, state: State, how: PositionRefinement, iteration: int = 0) -> DataFrame:
    """``frames`` with the best place of each, all other columns as they are."""
    shared = sent(frames.sparkSession, state.probe, state.obj)
    metric = METRICS[how.metric]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, obj = shared.value
        for pdf in batches:
            places = []
            for row in pdf.itertuples():
                r, c, _, intensity, mask = frame_arrays(row)
                dr, dc, *_ = K.best_shift(probe, obj, r, c, how.shifts(int(row.frame_idx), iteration), intensity, mask, metric)
                places.append((r + dr, c + dc))
            yield pdf.assign(r0=[r for r, _ in places], c0=[c for _, c in places])

    return frames.mapInPandas(run, frames.schema)


def move(frames: DataFrame, moved: DataFrame) -> DataFrame:
    """Frames at their new places."""
    new = moved.select("frame_idx", "new_r0", "new_c0")
    return frames.join(new, "frame_idx").withColumn("r0", F.col("new_r0")).withColumn("c0", F.col("new_c0")).drop("new_r0", "new_c0")


def drift(moved: DataFrame, first: DataFrame) -> DataFrame:
    """Distance of each frame from where it was at first."""
    a = first.select("frame_idx", F.col("r0").alias("_r"), F.col("c0").alias("_c"))
    return moved.join(a, "frame_idx").select("frame_idx", F.hypot(F.col("new_r0") - F.col("_r"), F.col("new_c0") - F.col("_c")).alias("drift"))


def bounded_shifts(shifts: np.ndarray, places: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> np.ndarray:
    """Shifts cut so that places + shifts stay within the bounds."""
    return np.clip(places + shifts, low, high) - places
