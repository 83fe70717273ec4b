"""Difference map for three-dimensional Bragg data: one rocking curve is one frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.functions.propagate import BraggGeometry
from wavesift.functions.special import gaussian_filter
from wavesift.operators.engines import DM, ERRORS, SUMS, WITH_EXIT, TileSums, collect_sums, object_sums, register
from wavesift.plans.session import checkpoint
from wavesift.sources.frames import to_frames


@dataclass
class BraggSupport:
    """Shrink-wrapped support along the depth of an object: a thin layer or a rod."""

    cutoff: float = 0.1
    smooth: float | None = None
    coefficient: float = 0.1
    shape: str = "thinlayer"

    def profile(self, obj: np.ndarray) -> np.ndarray:
        """Mean modulus by depth (first axis), or by distance from the axis for a rod."""
        m = np.abs(obj)
        if self.shape == "thinlayer":
            p = m.mean(axis=(1, 2))
        else:
            z, y = np.indices(m.shape[:2]) - np.array([s / 2 - 0.5 for s in m.shape[:2]]).reshape(2, 1, 1)
            bins = np.hypot(z, y).astype(int).ravel()
            p = np.bincount(bins, m.mean(axis=2).ravel()) / np.maximum(np.bincount(bins), 1)
        return gaussian_filter(p, self.smooth) if self.smooth else p

    def apply(self, obj: np.ndarray) -> np.ndarray:
        """What lies where the profile is under the cutoff is scaled by the coefficient."""
        p = self.profile(obj)
        low = p < self.cutoff * p.max()
        if self.shape == "thinlayer":
            return np.where(low[:, None, None], obj * self.coefficient, obj)
        z, y = np.indices(obj.shape[:2]) - np.array([s / 2 - 0.5 for s in obj.shape[:2]]).reshape(2, 1, 1)
        return np.where(low[np.hypot(z, y).astype(int)][:, :, None], obj * self.coefficient, obj)


def bragg_scan(spark: SparkSession, probe: np.ndarray, obj: np.ndarray, places: list[tuple[int, int]]) -> DataFrame:
    """Rocking curves of a volume: one row for each place, its intensity the whole (depth, n, n) block."""
    n = probe.shape[-1]
    index = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(places)], "idx long, r0 int, c0 int")
    g = BraggGeometry()

    def image(i: int, r: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        block = K.abs2(g.fw(probe * obj[:, r : r + n, c : c + n]))
        return block, np.ones(block.shape)

    return to_frames(index, n, image)


@register("DM_3dBragg")
@dataclass
class BraggDM(DM):
    """Difference map of volumes: state.probe is (depth, n, n), state.obj (depth, height, width).

    The object's depth profile is thinned by ``support`` after every update.
    Without a volume (a two-dimensional scan) the depth is 1.
    """

    support: BraggSupport | None = None
    #: Plane by plane: the planes of a volume are no modes.
    wave, probe_part, light = staticmethod(np.multiply), staticmethod(lambda patch, psi, modes: np.conj(patch) * psi), staticmethod(K.abs2)

    def prepare(self) -> None:
        depth = self.state.probe.shape[0]
        super().prepare()
        self.mean_power /= depth
        self.pbound /= depth

    def fourier_update(self) -> dict[str, float]:
        a, b, c = self.coefficients()
        shared, pbound, shape, g = self.broadcast(), self.pbound, self.state.probe.shape, BraggGeometry()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe, obj = shared.value
            for pdf in batches:
                rows = []
                for row in pdf.itertuples():
                    block = np.frombuffer(row.intensity, "<f4").reshape(shape).astype(float)
                    mask = np.frombuffer(row.mask, np.uint8).reshape(shape).astype(float)
                    patch = obj[:, row.r0 : row.r0 + row.n, row.c0 : row.c0 + row.n]
                    psi = np.frombuffer(row.exit, "<c16").reshape(shape)
                    new, fourier, change = K.projection(psi[None], probe[None], patch[None], block, mask, a, b, c, pbound, g.fw, g.bw)
                    photon = K.log_likelihood(probe[None], patch[None], block, mask, g.fw)
                    rows.append((new[0].astype("<c16").tobytes(), fourier, photon, float(np.mean(change))))
                yield pdf.assign(**{k: [x[i] for x in rows] for i, k in enumerate(("exit", *ERRORS))})

        self.waves = checkpoint(self.waves.mapInPandas(run, WITH_EXIT))
        shared.destroy()
        means = self.waves.agg(*[F.avg(e).alias(e) for e in ERRORS]).first()
        return {e: means[e] or 0.0 for e in ERRORS}

    def object_update(self) -> None:
        """As in two dimensions, plane by plane of the depth."""
        shared, shape = self.broadcast(), self.state.probe.shape

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes, probe = [TileSums() for _ in range(shape[0])], shared.value[0]
            for pdf in batches:
                for row in pdf.itertuples():
                    psi = np.frombuffer(row.exit, "<c16").reshape(shape)
                    for d, sums in enumerate(planes):
                        sums.add_patch(int(row.r0), int(row.c0), np.conj(probe[d]) * psi[d], K.abs2(probe[d]))
            for d, sums in enumerate(planes):
                yield sums.rows().assign(what=f"plane{d}")

        sums = collect_sums(self.waves.mapInPandas(partial, SUMS))
        shared.destroy()
        c, new = self.object_inertia * self.mean_power, self.state.obj.copy()
        for d in range(shape[0]):
            own = {("object", i, j): v for (what, i, j), v in sums.items() if what == f"plane{d}"}
            num, den = object_sums(own, new.shape[-2:])
            new[d] = np.where(c + den > 0, (c * new[d] + num) / np.maximum(c + den, 1e-300), new[d])
        self.state.obj = self.limited(self.support.apply(new) if self.support else new)
