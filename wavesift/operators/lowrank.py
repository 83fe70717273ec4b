"""Low-rank approximation of many modes, and engines with a probe for every frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.operators.engines import DM, ERRORS, ML, SUMS, TileSums, collect_sums, frame_arrays, register
from wavesift.plans.session import checkpoint


def _products(df: DataFrame, column: str, vectors: np.ndarray) -> np.ndarray:
    """Sum over rows of conj(coefficients) x row, coefficients being the row's products with ``vectors``."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, v = TileSums(), shared.value
        for pdf in batches:
            if len(pdf):
                a = np.stack([np.frombuffer(b, "<c16") for b in pdf[column]])
                sums.add("product", (a @ v.conj().T).conj().T @ a, np.zeros(1))
        yield sums.rows()

    out = collect_sums(df.select(column).mapInPandas(run, SUMS))["product", 0, 0][0].reshape(vectors.shape)
    shared.destroy()
    return out


def leading_modes(df: DataFrame, column: str, size: int, dim: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """``dim`` orthonormal modes that span most of the rows, strongest first.

    Subspace iteration: each step is one pass in which tasks send a (dim, size)
    product. No matrix of rows by rows is ever made, so the number of rows does
    not matter to the driver.
    """
    rng = np.random.default_rng(seed)
    v = np.linalg.qr((rng.standard_normal((size, dim)) + 1j * rng.standard_normal((size, dim))))[0].T
    for _ in range(steps):
        v = np.linalg.qr(_products(df, column, v).T)[0].T
    w = _products(df, column, v)
    _, vectors = np.linalg.eigh(w @ v.conj().T)
    return vectors[:, ::-1].T @ v


def project(a: np.ndarray, modes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, approximation) of rows in the span of orthonormal modes."""
    coefficients = a @ modes.conj().T
    return coefficients, coefficients @ modes


WITH_PROBE = "frame_idx long, r0 int, c0 int, n int, intensity binary, mask binary, exit binary, err_fourier double, err_photon double, err_exit double, probe binary"


@register("DMOPR")
@dataclass
class DMOPR(DM):
    """Difference map with a probe for every frame, kept in a subspace of ``subspace_dim`` modes."""

    subspace_dim: int = 2

    def prepare(self) -> None:
        super().prepare()
        probe = self.state.probe.astype("<c16").tobytes()
        self.waves = checkpoint(self.waves.withColumn("probe", F.lit(bytearray(probe))))

    def fourier_update(self) -> dict[str, float]:
        a, b, c = self.coefficients()
        shared, pbound, shape = self.broadcast(), self.pbound, self.state.probe.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            obj = shared.value[1]
            for pdf in batches:
                rows = []
                for row in pdf.itertuples():
                    r, q, n, intensity, mask = frame_arrays(row)
                    patch, probe = obj[:, r : r + n, q : q + n], np.frombuffer(row.probe, "<c16").reshape(shape)
                    psi, fourier, change = K.projection(np.frombuffer(row.exit, "<c16").reshape(shape), probe, patch, intensity, mask, a, b, c, pbound)
                    rows.append((psi.astype("<c16").tobytes(), fourier, K.log_likelihood(probe, patch, intensity, mask), change))
                yield pdf.assign(**{k: [x[i] for x in rows] for i, k in enumerate(("exit", *ERRORS))})

        self.waves = checkpoint(self.waves.mapInPandas(run, WITH_PROBE))
        shared.destroy()
        means = self.waves.agg(*[F.avg(e).alias(e) for e in ERRORS]).first()
        return {e: means[e] or 0.0 for e in ERRORS}

    def probe_update(self) -> float:
        """Each frame's probe from its own exit wave, then all of them into the subspace; the state's probe is their mean."""
        shared, shape, inertia = self.broadcast(), self.state.probe.shape, 0.1

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            obj = shared.value[1]
            for pdf in batches:
                probes = []
                for row in pdf.itertuples():
                    patch = obj[:, row.r0 : row.r0 + row.n, row.c0 : row.c0 + row.n]
                    old, psi = (np.frombuffer(x, "<c16").reshape(shape) for x in (row.probe, row.exit))
                    probes.append(((inertia * old + np.conj(patch) * psi) / (inertia + K.abs2(patch))).astype("<c16").tobytes())
                yield pdf.assign(probe=probes)

        raw = checkpoint(self.waves.mapInPandas(own, WITH_PROBE))
        shared.destroy()
        modes = leading_modes(raw, "probe", int(np.prod(shape)), self.subspace_dim, steps=3)

        def into(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    low = project(np.stack([np.frombuffer(b, "<c16") for b in pdf["probe"]]), modes)[1]
                    pdf = pdf.assign(probe=[x.astype("<c16").tobytes() for x in low])
                yield pdf

        self.waves, self.modes = checkpoint(raw.mapInPandas(into, WITH_PROBE)), modes.reshape(-1, *shape)

        def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = TileSums()
            for pdf in batches:
                for b in pdf["probe"]:
                    sums.add("probe", np.frombuffer(b, "<c16"), np.ones(1))
            yield sums.rows()

        num, n = collect_sums(self.waves.select("probe").mapInPandas(total, SUMS))["probe", 0, 0]
        new = (num / max(n[0], 1)).reshape(shape)
        change = np.sqrt(K.abs2(new - self.state.probe).sum() / max(K.abs2(new).sum(), 1e-300))
        self.state.probe = new
        return float(change)

    def object_update(self) -> None:
        shared, shape = self.broadcast(), self.state.probe.shape

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = TileSums()
            for pdf in batches:
                for row in pdf.itertuples():
                    probe, psi = (np.frombuffer(x, "<c16").reshape(shape) for x in (row.probe, row.exit))
                    sums.add_patch(int(row.r0), int(row.c0), (np.conj(probe) * psi).sum(axis=0), K.abs2(probe).sum(axis=0))
            yield sums.rows()

        from wavesift.operators.engines import object_sums

        num, den = object_sums(collect_sums(self.waves.mapInPandas(partial, SUMS)), self.state.obj.shape[-2:])
        shared.destroy()
        c = self.object_inertia * self.mean_power
        self.state.obj = self.limited(np.where(c + den > 0, (c * self.state.obj[0] + num) / np.maximum(c + den, 1e-300), self.state.obj[0])[None])


@register("MLOPR")
@dataclass
class MLOPR(ML):
    """Maximum likelihood whose probe step is kept in the span of a DMOPR's modes."""

    modes: np.ndarray | None = None

    def gradient(self):
        g_obj, g_probe, cost = super().gradient()
        if self.modes is not None:
            flat = self.modes.reshape(len(self.modes), -1)
            g_probe = project(g_probe.reshape(1, -1), flat)[1].reshape(g_probe.shape)
        return g_obj, g_probe, cost
