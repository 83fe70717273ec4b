"""Transmission and differential phase maps of a scan, and first guesses made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavesift.functions.arrays import grids, mass_center
from wavesift.functions.special import phase_from_dpc
from wavesift.operators.engines import SUMS, TileSums, collect_sums, frame_arrays, object_sums


def stxm_analysis(frames: DataFrame, probe, shape: tuple[int, int], psize: float = 1.0, resolution: float = 1.0, lz: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transmission, dpc_row, dpc_col) of an object of ``shape``.

    Every frame adds the root of its counts and the place of its centroid,
    weighted by the probe's modulus, to the pixels it lights. ``probe`` is an
    array, or the width of a Gaussian.
    """
    def weight(n: int) -> np.ndarray:
        return np.exp(-(grids((n, n)) ** 2).sum(axis=0) / probe**2) if np.isscalar(probe) else np.abs(np.asarray(probe))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, top = {k: TileSums() for k in ("trans", "row", "col")}, 0.0
        for pdf in batches:
            for row in pdf.itertuples():
                r, c, n, intensity, _ = frame_arrays(row)
                w, total = weight(n), intensity.sum()
                top = max(top, total)
                q = (mass_center(intensity) - n // 2) * psize * resolution * 2 * np.pi / lz if total > 0 else np.zeros(2)
                for k, v in (("trans", np.sqrt(total)), ("row", q[0]), ("col", q[1])):
                    sums[k].add_patch(r, c, v * w, w)
        for k, s in sums.items():
            yield s.rows().assign(what=lambda d, k=k: k)
        yield pd.DataFrame([("top", 0, 0, np.array([top], "<c16").tobytes(), np.zeros(1).tobytes())], columns=["what", "i", "j", "num", "den"])

    parts = frames.mapInPandas(partial, SUMS).persist()
    from pyspark.sql import functions as F

    top = max((np.frombuffer(r["num"], "<c16")[0].real for r in parts.filter(F.col("what") == "top").collect()), default=1.0)  # a number for each task
    sums = collect_sums(parts.filter(F.col("what") != "top"))
    parts.unpersist()
    out = []
    for k in ("trans", "row", "col"):
        num, den = object_sums({("object", i, j): v for (what, i, j), v in sums.items() if what == k}, shape)
        out.append(num.real / (den + 1e-10))
    return out[0] / np.sqrt(top or 1.0), out[1], out[2]


def stxm_object(frames: DataFrame, probe, shape: tuple[int, int], **geometry) -> np.ndarray:
    """A first object: the transmission with the phase that its gradients integrate to."""
    trans, row, col = stxm_analysis(frames, probe, shape, **geometry)
    return (trans * np.exp(-1j * phase_from_dpc(row, col)))[None]


def mean_amplitude_probe(frames: DataFrame, n: int) -> np.ndarray:
    """A first probe: the back transform of the root of the mean frame."""
    from wavesift.functions.propagate import inverse

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = TileSums()
        for pdf in batches:
            for row in pdf.itertuples():
                sums.add("mean", frame_arrays(row)[3], np.ones(1))
        yield sums.rows()

    num, den = collect_sums(frames.mapInPandas(partial, SUMS))["mean", 0, 0]
    return inverse(np.sqrt(num.real.reshape(n, n) / max(den[0], 1)))[None]
