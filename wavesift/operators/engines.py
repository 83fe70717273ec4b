"""Iterative reconstruction engines.

Frames stay distributed; probe and object are small and go out by broadcast.
Each pass sends back sums of the image tiles that a task's frames touch, added
up by tile in a tree, so what moves grows with the image and not with the
frames. Exit waves of the projection engines are state: they are written to the
shared checkpoint folder in every iteration.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.functions.arrays import grids, mass_center
from wavesift.functions.special import gaussian_filter, shift_zoom
from wavesift.operators.partition import by_load
from wavesift.plans.session import checkpoint, small_batches

TILE = 256
#: Probe and object go out by broadcast up to this size.
BROADCAST_BYTES = 4 << 30
#: Frames that one domain of a sequential engine sweeps, where their number is not given.
DOMAIN_FRAMES = 4096
#: Sums of up to this many tasks are added at once.
FAN_IN = 16
SUMS = "what string, i int, j int, num binary, den binary"
ENGINES: dict[str, type] = {}


def register(name: str):
    """Class decorator: the engine can be asked for by this name."""

    def add(cls):
        ENGINES[name] = cls
        cls.name = name
        return cls

    return add


def by_name(name: str) -> type:
    if name not in ENGINES:
        raise KeyError(f"no engine {name!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


@dataclass
class State:
    """Probe modes (m, n, n) and object modes (k, H, W); every probe mode meets every object mode."""

    probe: np.ndarray
    obj: np.ndarray


def frame_arrays(row) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    n = int(row.n)
    return int(row.r0), int(row.c0), n, np.frombuffer(row.intensity, "<f4").reshape(n, n).astype(float), np.frombuffer(row.mask, np.uint8).reshape(n, n).astype(float)


class TileSums:
    """Sums over image tiles and named whole arrays, made by one task."""

    def __init__(self):
        self.parts: dict[tuple[str, int, int], list[np.ndarray]] = {}

    def add(self, what: str, num: np.ndarray, den: np.ndarray, key: tuple[int, int] = (0, 0)) -> None:
        own = self.parts.get((what, *key))
        if own is None:
            self.parts[(what, *key)] = [np.array(num, complex), np.array(den, float)]
        else:
            own[0] += num
            own[1] += den

    def add_patch(self, r: int, c: int, num: np.ndarray, den: np.ndarray, what: str = "object") -> None:
        """Adds a patch, of one mode or of several, to the tiles that it touches."""
        h, w = num.shape[-2:]
        for i in range(r // TILE, (r + h - 1) // TILE + 1):
            for j in range(c // TILE, (c + w - 1) // TILE + 1):
                own = self.parts.get((what, i, j))
                if own is None:
                    own = self.parts[(what, i, j)] = [np.zeros((*num.shape[:-2], TILE, TILE), complex), np.zeros((TILE, TILE))]
                y0, y1, x0, x1 = max(r, i * TILE), min(r + h, (i + 1) * TILE), max(c, j * TILE), min(c + w, (j + 1) * TILE)
                to, of = (slice(y0 - i * TILE, y1 - i * TILE), slice(x0 - j * TILE, x1 - j * TILE)), (slice(y0 - r, y1 - r), slice(x0 - c, x1 - c))
                own[0][(..., *to)] += num[(..., *of)]
                own[1][to] += den[of]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(*k, num.astype("<c16").tobytes(), den.astype("<f8").tobytes()) for k, (num, den) in self.parts.items()], columns=["what", "i", "j", "num", "den"])


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    num = sum(np.frombuffer(b, "<c16") for b in pdf["num"])
    den = sum(np.frombuffer(b, "<f8") for b in pdf["den"])
    first = pdf.iloc[0]
    return pd.DataFrame([(first.what, first.i, first.j, num.astype("<c16").tobytes(), den.astype("<f8").tobytes())], columns=["what", "i", "j", "num", "den"])


def tree_levels(tasks: int, fan_in: int = FAN_IN) -> int:
    """Levels of the tree before the last, in which ``fan_in`` sums at most are added at a time."""
    levels = 0
    while tasks > fan_in:
        tasks, levels = -(-tasks // fan_in), levels + 1
    return levels


def collect_sums(parts: DataFrame) -> dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]]:
    """Task sums added by key up a tree of fan-in FAN_IN; the driver gets one row for each tile or array.

    No task of any level holds more than FAN_IN sums of a key, however many tasks there were.
    """
    levels = tree_levels(parts.rdd.getNumPartitions())
    if levels:
        parts = parts.withColumn("node", F.spark_partition_id())
    for _ in range(levels):
        above = parts.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        parts = above.groupBy("what", "i", "j", "node").applyInPandas(lambda key, p: _add_up(p.drop(columns="node")).assign(node=key[3]), SUMS + ", node int")
    return {
        (r["what"], r["i"], r["j"]): (np.frombuffer(r["num"], "<c16"), np.frombuffer(r["den"], "<f8"))
        for r in parts.drop("node").groupBy("what", "i", "j").applyInPandas(_add_up, SUMS).collect()
    }


def object_sums(sums: dict, shape: tuple[int, int], modes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tiles put together to images of ``shape``; the first has an axis of ``modes`` where that is given."""
    h, w = (-(-s // TILE) * TILE for s in shape)
    num, den = np.zeros((max(modes, 1), h, w), complex), np.zeros((h, w))
    for (what, i, j), (a, b) in sums.items():
        if what == "object":
            at = (slice(i * TILE, (i + 1) * TILE), slice(j * TILE, (j + 1) * TILE))
            num[(..., *at)], den[at] = a.reshape(-1, TILE, TILE), b.reshape(TILE, TILE)
    num = num[:, : shape[0], : shape[1]]
    return num if modes else num[0], den[: shape[0], : shape[1]]


@dataclass
class Engine:
    """Book-keeping that all engines share. ``log`` has a row for each iteration."""

    frames: DataFrame
    state: State
    numiter: int = 10
    seed: int = 0
    probe_update_start: int = 0
    clip_object: tuple[float, float] | None = None
    probe_support: float | None = None
    probe_fourier_support: float | None = None
    #: A posref.PositionRefinement: places are looked for again after the iterations that it names.
    position_refinement: object | None = None
    after: Callable[[Engine], None] | None = None
    log: list[dict] = field(default_factory=list)
    prepared: bool = field(default=False, init=False)
    name = "engine"

    def __post_init__(self) -> None:
        small_batches(self.frames.sparkSession)

    def prepare(self) -> None:
        """Called once before the first iteration, and again when frames are new."""

    def iterate(self) -> dict[str, float]:
        raise NotImplementedError

    def run(self, iterations: int | None = None) -> State:
        if not self.prepared:
            self.prepare()
            self.prepared = True
        for _ in range(self.numiter if iterations is None else iterations):
            began = time.time()
            errors = self.iterate()
            self.log.append({"engine": self.name, "iteration": len(self.log) + 1, "duration": time.time() - began, **errors})
            if self.position_refinement and self.position_refinement.due(len(self.log)):
                self.refine_positions()
            if self.after:
                self.after(self)
        return self.state

    def placed(self) -> DataFrame:
        """The frames with their places, as the engine uses them."""
        return self.frames

    def replace_frames(self, frames: DataFrame) -> None:
        self.frames = frames

    def refine_positions(self) -> None:
        """Every frame to the best of its candidate places under the present probe and object; in place, without a shuffle."""
        from wavesift.operators.posref import refined

        self.replace_frames(checkpoint(refined(self.placed(), self.state, self.position_refinement, len(self.log))))

    @property
    def iteration(self) -> int:
        return len(self.log)

    def snapshot(self) -> tuple[dict[str, np.ndarray], dict, DataFrame | None]:
        """(arrays, numbers, waves) that the next iteration depends on, beside frames and parameters."""
        return {"probe": self.state.probe, "obj": self.state.obj}, {"log": self.log}, None

    def restore(self, arrays: dict[str, np.ndarray], numbers: dict, waves: DataFrame | None = None) -> None:
        """As it was when ``snapshot`` gave these."""
        self.prepare()
        self.prepared = True
        self.state, self.log = State(arrays["probe"], arrays["obj"]), list(numbers["log"])

    def iter_info(self) -> DataFrame:
        names = ("engine", "iteration", "duration", "err_fourier", "err_photon", "err_exit")
        rows = [tuple(float(r.get(k, 0.0)) if k.startswith(("err", "dur")) else r[k] for k in names) for r in self.log]
        return self.frames.sparkSession.createDataFrame(rows, "engine string, iteration int, duration double, err_fourier double, err_photon double, err_exit double")

    def broadcast(self, *more: np.ndarray):
        return sent(self.frames.sparkSession, self.state.probe, self.state.obj, *more)

    def limited(self, obj: np.ndarray) -> np.ndarray:
        if self.clip_object is None:
            return obj
        low, high = self.clip_object
        m = np.abs(obj)
        return np.where(m > 0, obj / np.maximum(m, 1e-300), 1.0) * np.clip(m, low, high)

    def supported(self, probe: np.ndarray) -> np.ndarray:
        """Disc supports in real and in Fourier space, radii as parts of half the frame."""
        r = np.hypot(*grids(probe.shape[-2:])) / (probe.shape[-1] / 2)
        if self.probe_support:
            probe = probe * (r <= self.probe_support)
        if self.probe_fourier_support:
            probe = K.inverse(K.fourier(probe) * (r <= self.probe_fourier_support))
        return probe


def sent(spark, *arrays: np.ndarray):
    """A broadcast of ``arrays``, up to BROADCAST_BYTES."""
    size = sum(a.nbytes for a in arrays)
    if size > BROADCAST_BYTES:
        raise ValueError(f"probe and object have {size} bytes, more than the {BROADCAST_BYTES} that are broadcast; engines of operators.tiled keep the object in tiles")
    return spark.sparkContext.broadcast(arrays)


WITH_EXIT = "frame_idx long, r0 int, c0 int, n int, intensity binary, mask binary, exit binary, err_fourier double, err_photon double, err_exit double"
ERRORS = ("err_fourier", "err_photon", "err_exit")


@dataclass
class ProjectionEngine(Engine):
    """psi <- [x + a O + b F (c O + y)] psi for every frame at once, then overlap updates until the probe settles."""

    object_inertia: float = 1e-4
    probe_inertia: float = 1e-9
    overlap_max_iterations: int = 3
    overlap_converge_factor: float = 0.05
    update_object_first: bool = True
    obj_smooth_std: float | None = None
    fourier_relax_factor: float = 0.05
    fourier_power_bound: float | None = None
    probe_center_tol: float | None = None
    compute_log_likelihood: bool = True
    #: Exit waves to go on with; without them each frame starts with probe times object.
    waves: DataFrame | None = None
    #: Sums of frames that are kept elsewhere: object and probe (num, den), frames, power, top.
    kept: dict | None = None

    #: Exit waves of a probe and a patch, their part in the probe's sum, and the light of a patch.
    wave, probe_part, light = staticmethod(K.pairs), staticmethod(K.probe_sum), staticmethod(lambda patch: K.abs2(patch).sum(axis=0))

    def coefficients(self) -> tuple[float, float, float]:
        raise NotImplementedError

    def prepare(self) -> None:
        def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"p": [float((np.frombuffer(a, "<f4") * np.frombuffer(m, np.uint8)).sum()) for a, m in zip(pdf["intensity"], pdf["mask"], strict=True)]})

        s = self.frames.select("intensity", "mask").mapInPandas(power, "p double").agg(F.max("p").alias("top"), F.sum("p").alias("power"), F.count(F.lit(1)).alias("n")).first()
        kept, npix = self.kept or {"frames": 0, "power": 0.0, "top": 0.0}, self.state.probe.shape[-1] ** 2
        self.totals = {"frames": s["n"] + kept["frames"], "power": (s["power"] or 0.0) + kept["power"], "top": max(s["top"] or 0.0, kept["top"])}
        self.num_frames = self.totals["frames"]
        self.mean_power = self.totals["power"] / max(self.num_frames, 1) / npix
        self.pbound = self.fourier_power_bound if self.fourier_power_bound is not None else 0.25 * self.fourier_relax_factor**2 * self.totals["top"] / npix
        if self.waves is not None:
            return
        shared, wave = self.broadcast(), type(self).wave

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe, obj = shared.value
            for pdf in batches:
                waves = [wave(probe, obj[:, r : r + n, c : c + n]).astype("<c16").tobytes() for r, c, n in zip(pdf["r0"], pdf["c0"], pdf["n"], strict=True)]
                yield pdf.assign(exit=waves, err_fourier=0.0, err_photon=0.0, err_exit=0.0)

        self.waves = checkpoint(self.frames.mapInPandas(first, WITH_EXIT))
        shared.destroy()

    def fourier_update(self) -> dict[str, float]:
        a, b, c = self.coefficients()
        shared, pbound, likelihood = self.broadcast(), self.pbound, self.compute_log_likelihood

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe, obj = shared.value
            for pdf in batches:
                rows = []
                for row in pdf.itertuples():
                    r, q, n, intensity, mask = frame_arrays(row)
                    patch = obj[:, r : r + n, q : q + n]
                    psi = np.frombuffer(row.exit, "<c16").reshape(-1, n, n)
                    psi, fourier, change = K.projection(psi, probe, patch, intensity, mask, a, b, c, pbound)
                    photon = K.log_likelihood(probe, patch, intensity, mask) if likelihood else 0.0
                    rows.append((psi.astype("<c16").tobytes(), fourier, photon, change))
                yield pdf.assign(**{k: [x[i] for x in rows] for i, k in enumerate(("exit", *ERRORS))})

        self.waves = checkpoint(self.waves.mapInPandas(project, WITH_EXIT))
        shared.destroy()
        means = self.waves.agg(*[F.avg(e).alias(e) for e in ERRORS]).first()
        return {e: means[e] or 0.0 for e in ERRORS}

    def snapshot(self):
        arrays, numbers, _ = super().snapshot()
        return arrays, numbers, self.waves

    def restore(self, arrays, numbers, waves=None) -> None:
        self.waves = waves
        super().restore(arrays, numbers)

    def placed(self) -> DataFrame:
        return self.waves

    def replace_frames(self, frames: DataFrame) -> None:
        self.waves = frames

    def frame_error(self) -> DataFrame:
        return self.waves.select("frame_idx", *ERRORS)

    def object_update(self) -> None:
        """O = (c O + sum conj(P) psi) / (c + sum |P|^2)."""
        shared = self.broadcast()

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, (probe, obj) = TileSums(), shared.value
            den, modes = K.abs2(probe).sum(axis=0), len(obj)
            for pdf in batches:
                for row in pdf.itertuples():
                    psi = np.frombuffer(row.exit, "<c16").reshape(-1, row.n, row.n)
                    sums.add_patch(int(row.r0), int(row.c0), K.object_sum(probe, psi, modes), den)
            yield sums.rows()

        num, den = object_sums(collect_sums(self.waves.mapInPandas(partial, SUMS)), self.state.obj.shape[-2:], len(self.state.obj))
        shared.destroy()
        if self.kept:
            num, den = num + self.kept["object"][0], den + self.kept["object"][1]
        c = self.object_inertia * self.mean_power
        old = gaussian_filter(self.state.obj, (0, self.obj_smooth_std, self.obj_smooth_std)) if self.obj_smooth_std else self.state.obj
        total = c + den
        self.state.obj = self.limited(np.where(total > 0, (c * old + num) / np.maximum(total, 1e-300), self.state.obj))

    def wave_sums(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Sums of the present waves for both updates, without those that are kept elsewhere."""
        shared = self.broadcast()

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, (probe, obj) = TileSums(), shared.value
            lit, modes = K.abs2(probe).sum(axis=0), len(obj)
            for pdf in batches:
                for row in pdf.itertuples():
                    patch = obj[:, row.r0 : row.r0 + row.n, row.c0 : row.c0 + row.n]
                    psi = np.frombuffer(row.exit, "<c16").reshape(-1, row.n, row.n)
                    sums.add_patch(int(row.r0), int(row.c0), K.object_sum(probe, psi, modes), lit)
                    sums.add("probe", K.probe_sum(patch, psi, len(probe)), np.broadcast_to(K.abs2(patch).sum(axis=0), probe.shape))
            yield sums.rows()

        sums = collect_sums(self.waves.mapInPandas(partial, SUMS))
        shared.destroy()
        shape = self.state.probe.shape
        num, den = sums.get(("probe", 0, 0), (np.zeros(shape, complex), np.zeros(shape)))
        return {"object": object_sums(sums, self.state.obj.shape[-2:], len(self.state.obj)), "probe": (num.reshape(shape), den.reshape(shape))}

    def probe_update(self) -> float:
        """P = (c P + sum conj(O) psi) / (c + sum |O|^2); returns the relative change."""
        shared, own, light = self.broadcast(), type(self).probe_part, type(self).light

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, (probe, obj) = TileSums(), shared.value
            for pdf in batches:
                for row in pdf.itertuples():
                    patch = obj[:, row.r0 : row.r0 + row.n, row.c0 : row.c0 + row.n]
                    psi = np.frombuffer(row.exit, "<c16").reshape(-1, row.n, row.n)
                    sums.add("probe", own(patch, psi, len(probe)), np.broadcast_to(light(patch), probe.shape))
            yield sums.rows()

        num, den = (x.reshape(self.state.probe.shape) for x in collect_sums(self.waves.mapInPandas(partial, SUMS))["probe", 0, 0])
        shared.destroy()
        if self.kept:
            num, den = num + self.kept["probe"][0], den + self.kept["probe"][1]
        old = self.state.probe
        c = self.probe_inertia * self.num_frames
        new = self.supported((c * old + num) / (c + den + 1e-300))
        self.state.probe = new
        return float(np.sqrt(K.abs2(new - old).sum() / max(K.abs2(new).sum(), 1e-300)))

    def overlap_update(self) -> None:
        with_probe = self.iteration >= self.probe_update_start
        for inner in range(self.overlap_max_iterations):
            if self.update_object_first or inner or not with_probe:
                self.object_update()
            if not with_probe or self.probe_update() < self.overlap_converge_factor:
                break

    def center_probe(self) -> None:
        """Probe, object and exit waves moved so that the probe's centroid is the frame's centre."""
        if self.probe_center_tol is None:
            return
        at = mass_center(K.abs2(self.state.probe).sum(axis=0))
        to = np.array(self.state.probe.shape[-2:]) // 2
        if np.linalg.norm(at - to) < self.probe_center_tol:
            return
        self.state = State(*(shift_zoom(x, (1, 1), at, to) for x in (self.state.probe, self.state.obj)))
        n = self.state.probe.shape[-1]

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(exit=[shift_zoom(np.frombuffer(e, "<c16").reshape(-1, n, n), (1, 1), at, to).astype("<c16").tobytes() for e in pdf["exit"]])

        self.waves = checkpoint(self.waves.mapInPandas(move, WITH_EXIT))

    def iterate(self) -> dict[str, float]:
        errors = self.fourier_update()
        self.overlap_update()
        self.center_probe()
        return errors


@register("DM")
@dataclass
class DM(ProjectionEngine):
    """Difference map."""

    alpha: float = 1.0

    def coefficients(self):
        return -self.alpha, 1.0, 1.0 + self.alpha


@register("RAAR")
@dataclass
class RAAR(ProjectionEngine):
    """Relaxed averaged alternating reflections."""

    beta: float = 0.75

    def coefficients(self):
        return 1.0 - 2.0 * self.beta, self.beta, 2.0


@register("AP")
@dataclass
class AP(ProjectionEngine):
    """Alternating projections: the difference map with alpha 0."""

    def coefficients(self):
        return 0.0, 1.0, 1.0


@register("DM_object_regul")
@dataclass
class DMObjectRegul(DM):
    """Difference map that fills a masked part of the object from an iteration on."""

    object_regul_mask: np.ndarray | None = None
    object_regul_fill: complex = 1.0
    object_regul_start: int = 0

    def object_update(self) -> None:
        super().object_update()
        if self.object_regul_mask is not None and self.iteration >= self.object_regul_start:
            self.state.obj = np.where(self.object_regul_mask, self.object_regul_fill, self.state.obj)


# ---- maximum likelihood -----------------------------------------------------


@register("ML")
@dataclass
class ML(Engine):
    """Conjugate gradients on a noise model's cost; every step is one gradient pass and one line-search pass."""

    ml_type: str = "gaussian"
    floating_intensities: bool = False
    reg_del2: bool = False
    reg_del2_amplitude: float = 0.01
    smooth_gradient: float = 0.0
    smooth_gradient_decay: float = 0.0
    wavefield_precond: bool = False
    wavefield_delta_object: float = 0.1
    wavefield_delta_probe: float = 0.1
    scale_precond: bool = False
    scale_probe_object: float = 1.0
    poly_line_coeffs: str = "quadratic"

    def prepare(self) -> None:
        self.old: tuple[np.ndarray, np.ndarray] | None = None
        self.step: tuple[np.ndarray, np.ndarray] | None = None
        self.num_frames = self.frames.count()

    def snapshot(self):
        """With the last gradient and direction, both of object and probe."""
        arrays, numbers, _ = super().snapshot()
        own = {"old": self.old, "step": self.step}
        return arrays | {f"{k}_{part}": a for k, pair in own.items() if pair for part, a in zip(("obj", "probe"), pair, strict=True)}, numbers, None

    def restore(self, arrays, numbers, waves=None) -> None:
        super().restore(arrays, numbers)
        self.old, self.step = ((arrays[f"{k}_obj"], arrays[f"{k}_probe"]) if f"{k}_obj" in arrays else None for k in ("old", "step"))

    def gradient(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(object gradient, probe gradient, cost) at the current state, with the regulariser.

        With ``wavefield_precond`` the same pass sums the fluences of object and probe.
        """
        shared, model, floating, fluence = self.broadcast(), self.ml_type, self.floating_intensities, self.wavefield_precond

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, (probe, obj) = TileSums(), shared.value
            for pdf in batches:
                for row in pdf.itertuples():
                    r, c, n, intensity, mask = frame_arrays(row)
                    patch = obj[:, r : r + n, c : c + n]
                    g_obj, g_probe, cost = K.gradients(model, probe, patch, intensity, mask, floating)
                    sums.add_patch(r, c, g_obj, K.abs2(probe).sum(axis=0) if fluence else np.zeros((n, n)))
                    sums.add("probe", g_probe, np.broadcast_to(K.abs2(patch).sum(axis=0), g_probe.shape) if fluence else np.zeros(1))
                    sums.add("cost", np.zeros(1), np.array([cost]))
            yield sums.rows()

        sums = collect_sums(self.frames.mapInPandas(partial, SUMS))
        shared.destroy()
        g_obj, lit = object_sums(sums, self.state.obj.shape[-2:], len(self.state.obj))
        cost = float(sums["cost", 0, 0][1][0])
        if fluence:
            self.damping = np.sqrt(lit + self.wavefield_delta_object), np.sqrt(sums["probe", 0, 0][1].reshape(self.state.probe.shape) + self.wavefield_delta_probe)
        if self.reg_del2:
            g, value = del2(self.state.obj, self.reg_del2_amplitude)
            g_obj, cost = g_obj + g, cost + value
        return g_obj, sums["probe", 0, 0][0].reshape(self.state.probe.shape), cost

    def line(self, h_obj: np.ndarray, h_probe: np.ndarray) -> np.ndarray:
        """Coefficients of the cost along the direction."""
        shared, model, whole = self.broadcast(h_probe, h_obj), self.ml_type, self.poly_line_coeffs == "all"

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, (probe, obj, hp, ho) = TileSums(), shared.value
            for pdf in batches:
                for row in pdf.itertuples():
                    r, c, n, intensity, mask = frame_arrays(row)
                    at = (slice(None), slice(r, r + n), slice(c, c + n))
                    own = K.line_coefficients_all(model, probe, obj[at], hp, ho[at], intensity, mask) if whole else K.line_coefficients(model, probe, obj[at], hp, ho[at], intensity, mask)
                    sums.add("line", np.zeros(1), own)
            yield sums.rows()

        b = collect_sums(self.frames.mapInPandas(partial, SUMS))["line", 0, 0][1].copy()
        shared.destroy()
        if self.reg_del2:
            b[:3] += del2_line(self.state.obj, h_obj, self.reg_del2_amplitude)
        return b

    def best_step(self, b: np.ndarray) -> float:
        if len(b) == 3:
            return float(-0.5 * b[1] / b[2]) if b[2] > 0 else 0.0
        roots = np.roots(np.polyder(np.poly1d(b[::-1])).coeffs)
        real = [r.real for r in roots if abs(r.imag) < 1e-8 * (1 + abs(r.real))]
        return float(min(real, key=lambda t: np.polyval(b[::-1], t), default=0.0))

    def iterate(self) -> dict[str, float]:
        g_obj, g_probe, cost = self.gradient()
        plain_obj, damp_obj, damp_probe = g_obj, *(self.damping if self.wavefield_precond else (1.0, 1.0))
        g_obj, g_probe = g_obj / damp_obj, g_probe / damp_probe
        if self.smooth_gradient:
            sigma = self.smooth_gradient * (1 - self.smooth_gradient_decay) ** (self.iteration + 1)
            g_obj = gaussian_filter(g_obj, (0, sigma, sigma))
        if self.iteration < self.probe_update_start:
            g_probe = np.zeros_like(g_probe)
        elif self.scale_precond:
            ratio = K.abs2(g_obj).sum() / max(K.abs2(g_probe).sum(), 1e-300)
            g_probe = g_probe * math.sqrt(self.scale_probe_object * ratio * K.abs2(self.state.probe).sum() / max(K.abs2(self.state.obj).sum(), 1e-300))
        dot = lambda x, y: float((np.conj(x[0]) * y[0]).sum().real + (np.conj(x[1]) * y[1]).sum().real)
        g = (g_obj, g_probe)
        beta = 0.0
        if self.old is not None and dot(self.old, self.old) > 0:
            beta = max(0.0, (dot(g, g) - dot(g, self.old)) / dot(self.old, self.old))
        down = (-g_obj / damp_obj, -g_probe / damp_probe)
        h = tuple(x + beta * (s if self.step is not None else 0) for x, s in zip(down, self.step or (0, 0), strict=True))
        if dot(h, (plain_obj, g_probe * damp_probe) if self.wavefield_precond else g) > 0:
            h = down
        t = self.best_step(self.line(*h))
        self.state = State(self.supported(self.state.probe + t * h[1]), self.limited(self.state.obj + t * h[0]))
        self.old, self.step = g, h
        return {"err_photon": cost / max(self.num_frames, 1) / self.state.probe.shape[-1] ** 2}


def del2(obj: np.ndarray, amplitude: float) -> tuple[np.ndarray, float]:
    """(gradient, cost) of the squared-gradient regulariser on the last two axes."""
    g, cost = np.zeros_like(obj), 0.0
    for axis in (-2, -1):
        d = np.diff(obj, axis=axis)
        pad = [(0, 0)] * obj.ndim
        pad[axis] = (0, 1)
        fwd = np.pad(d, pad)
        pad[axis] = (1, 0)
        bwd = np.pad(d, pad)
        g += 2 * amplitude * (bwd - fwd)
        cost += amplitude * float(K.abs2(fwd).sum() + K.abs2(bwd).sum())
    return 2 * g, cost


def del2_line(obj: np.ndarray, h: np.ndarray, amplitude: float) -> np.ndarray:
    out = np.zeros(3)
    for axis in (-2, -1):
        x, y = np.diff(obj, axis=axis), np.diff(h, axis=axis)
        out += 2 * amplitude * np.array([K.abs2(x).sum(), 2 * (x * np.conj(y)).real.sum(), K.abs2(y).sum()])
    return out


# ---- sequential engines -----------------------------------------------------


@dataclass
class SequentialEngine(Engine):
    """Frame after frame in an order that seed and iteration decide, or by ``frame_idx`` (``order="frame"``).

    ``domains`` is 1 for the textbook order, in which every step needs the one
    before and so a single task does them all; 0 stands for as many as give each
    DOMAIN_FRAMES frames or so. More domains deal the frames by place, as many to
    each wherever they cluster: each is swept by a task of its own on a copy of probe
    and object, and the copies are averaged by the light that fell on them after
    every ``synchronise`` sweeps. Frames are streamed, never held together.
    """

    domains: int = 0
    synchronise: int = 1
    order: str = "random"
    object_norm_is_global: bool = False

    def prepare(self) -> None:
        if len(self.state.obj) > 1:
            raise ValueError("sequential engines take one object mode; DM, RAAR, AP and ML take several")
        self.deal()

    def deal(self) -> None:
        """Gives each frame its domain."""
        if self.domains == 0:
            self.domains = -(-self.frames.count() // DOMAIN_FRAMES) or 1
        own = self.frames.withColumn("domain", F.lit(0).cast("long")) if self.domains == 1 else by_load(self.frames, "r0", "c0", "frame_idx", self.domains)
        self.dealt = checkpoint(own)

    def replace_frames(self, frames: DataFrame) -> None:
        self.frames = frames.drop("domain")
        self.deal()

    def coefficients(self) -> tuple[float, float, float]:
        return 0.0, 1.0, 1.0

    def steps(self) -> tuple[float, float, float, float]:
        """(a, b) of the object's and of the probe's step."""
        return 0.0, 1.0, 0.0, 1.0

    def start(self, shared):
        """Copies of what a domain changes."""
        return tuple(x.copy() for x in shared)

    def step(self, own, row, iteration: int, sums: TileSums):
        """One frame: (what a domain has, errors)."""
        probe, obj = own
        a, b, c = self.coefficients()
        oa, ob, pa, pb = self.steps()
        r, q, n, intensity, mask = frame_arrays(row)
        at = (slice(None), slice(r, r + n), slice(q, q + n))
        patch, old = obj[at], probe * obj[at]
        psi, fourier, change = K.projection(old, probe, patch, intensity, mask, a, b, c)
        diff = psi - old
        power = K.abs2(obj).sum(axis=0).max() * np.ones((n, n)) if self.object_norm_is_global and pa == 0 else None
        obj[at] = K.step_update(patch, probe, diff, oa, ob)
        if iteration >= self.probe_update_start:
            probe = K.step_update(probe, obj[at], diff, pa, pb, power) if probe.shape[0] == 1 else probe + (pa + pb) * np.conj(obj[at]) * diff / ((1 - pa) * K.abs2(obj[at]).sum(axis=0).max() + pa * K.abs2(obj[at]).sum(axis=0))
        self.visited(sums, probe, obj[at], psi, r, q)
        return (probe, obj), (fourier, K.log_likelihood(probe, obj[at], intensity, mask), change)

    def visited(self, sums: TileSums, probe, patch, psi, r, c) -> None:
        """What is kept of each step for the merge: where the probe's light was."""
        sums.add_patch(r, c, np.zeros(psi.shape[-2:]), K.abs2(probe).sum(axis=0))

    def merge(self, sums: dict, count: int) -> None:
        num, den = object_sums(sums, self.state.obj.shape[-2:])
        self.state.obj = self.limited(np.where(den > 0, num / np.maximum(den, 1e-300), self.state.obj[0])[None])
        probe, n = sums["probe", 0, 0]
        self.state.probe = self.supported((probe / max(n[0], 1)).reshape(self.state.probe.shape))

    def hand_over(self, sums: TileSums, own, count: int) -> None:
        """The domain's object, weighted by the light that fell on it, and its probe."""
        probe, obj = own
        weigh(sums, "object", obj[0])
        sums.add("probe", probe * count, np.array([float(count)]))

    def domains_of(self, shared, iteration: int):
        """For mapInPandas over frames sorted by domain, sweep and order: sums of each domain's last sweep."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, own, sums, errors, count = None, None, None, np.zeros(3), 0

            def done() -> pd.DataFrame:
                self.hand_over(sums, own, count)
                sums.add("errors", np.zeros(1), np.array([*errors, count]))
                return sums.rows()

            for pdf in batches:
                for row in pdf.itertuples():
                    if at is None or at[0] != row.domain:
                        if at is not None:
                            yield done()
                        own = self.start(shared.value)
                    if at != (row.domain, row.sweep):
                        at, sums, errors, count = (row.domain, row.sweep), TileSums(), np.zeros(3), 0
                    own, error = self.step(own, row, iteration, sums)
                    errors, count = errors + error, count + 1
            if at is not None:
                yield done()

        return run

    def what_goes_out(self):
        return self.broadcast()

    def iterate(self) -> dict[str, float]:
        shared, it = self.what_goes_out(), self.iteration
        rank = F.col("frame_idx") if self.order == "frame" else F.xxhash64("frame_idx", F.lit(self.seed), F.lit(it), "sweep")
        frames = self.dealt.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(self.synchronise - 1)))).withColumn("rank", rank)
        frames = frames.repartition("domain").sortWithinPartitions("domain", "sweep", "rank", "frame_idx")
        kept = {k: self.__dict__.pop(k) for k in ("frames", "dealt", "after", "log", "state", "slices") if k in self.__dict__}  # the task needs the parameters only
        try:
            sums = collect_sums(frames.mapInPandas(self.domains_of(shared, it), SUMS))
        finally:
            self.__dict__.update(kept)
        shared.destroy()
        *total, n = sums["errors", 0, 0][1]
        self.merge(sums, int(n))
        return {e: float(t / n) for e, t in zip(ERRORS, total, strict=True)}


def weigh(sums: TileSums, what: str, image: np.ndarray) -> None:
    """Tiles of ``image`` times the light that ``sums`` have of it."""
    h, w = image.shape
    for (name, i, j), part in sums.parts.items():
        if name == what:
            own = image[i * TILE : min((i + 1) * TILE, h), j * TILE : min((j + 1) * TILE, w)]
            part[0][..., : own.shape[0], : own.shape[1]] = own * part[1][: own.shape[0], : own.shape[1]]


@register("EPIE")
@dataclass
class EPIE(SequentialEngine):
    """alpha is the object's step, beta the probe's."""

    alpha: float = 1.0
    beta: float = 1.0

    def steps(self):
        return 0.0, self.alpha, 0.0, self.beta


@register("EPIEParallel")
@dataclass
class EPIEParallel(EPIE):
    """ePIE in spatial domains that are averaged."""

    domains: int = 4


@register("SDR")
@dataclass
class SDR(SequentialEngine):
    """Semi-implicit relaxed Douglas-Rachford."""

    sigma: float = 1.0
    tau: float = 1.0
    beta_probe: float = 0.1
    beta_object: float = 0.9

    def coefficients(self):
        return 1.0 - self.tau * (1.0 + self.sigma), self.tau, 1.0 + self.sigma

    def steps(self):
        return self.beta_object, 0.0, self.beta_probe, 0.0


@register("WASP")
@dataclass
class WASP(SequentialEngine):
    """Sequential projections within domains, then weighted averages of all exit waves."""

    alpha: float = 0.95
    beta: float = 0.95

    def steps(self):
        return self.alpha, 0.0, self.beta, 0.0

    def visited(self, sums, probe, patch, psi, r, c) -> None:
        sums.add_patch(r, c, (np.conj(probe) * psi).sum(axis=0), K.abs2(probe).sum(axis=0))
        sums.add("probe", np.conj(patch) * psi, np.broadcast_to(K.abs2(patch), psi.shape))

    def hand_over(self, sums, own, count) -> None:
        pass

    def merge(self, sums: dict, count: int) -> None:
        num, den = object_sums(sums, self.state.obj.shape[-2:])
        lit = den >= 1e-8
        self.state.obj = self.limited(np.where(lit, num / np.where(lit, den, 1), self.state.obj[0])[None])
        if self.iteration >= self.probe_update_start:
            num, den = (x.reshape(self.state.probe.shape) for x in sums["probe", 0, 0])
            self.state.probe = self.supported(np.where(np.abs(den) < 1e-8, num, num / np.where(den == 0, 1, den)))


@register("ThreePIE")
@dataclass
class ThreePIE(EPIE):
    """Multislice ePIE: the object is a stack of slices, with free space between them.

    Domains sweep copies of the stack; each slice is averaged by the light of the
    waves that reached it.
    """

    slices: list[np.ndarray] | None = None
    fw_between: Callable | None = None
    bw_between: Callable | None = None

    def prepare(self) -> None:
        super().prepare()
        self.slices = self.slices or [self.state.obj, np.ones_like(self.state.obj)]

    def what_goes_out(self):
        return sent(self.frames.sparkSession, self.state.probe, np.concatenate(self.slices))

    def step(self, own, row, iteration, sums):
        probe, stack = own
        r, c, n, intensity, mask = frame_arrays(row)
        same = lambda w: w
        at = (slice(r, r + n), slice(c, c + n))
        new, out, error, lights = K.multislice(probe, [s[at] for s in stack], self.fw_between or same, intensity, mask, self.alpha, self.beta, bw_between=self.bw_between or same)
        for k, (s, x, light) in enumerate(zip(stack, out, lights, strict=True)):
            s[at] = x
            sums.add_patch(r, c, np.zeros((n, n)), light, f"slice{k}")
        return (new if iteration >= self.probe_update_start else probe, stack), (error, 0.0, 0.0)

    def hand_over(self, sums, own, count) -> None:
        probe, stack = own
        for k, s in enumerate(stack):
            weigh(sums, f"slice{k}", s)
        sums.add("probe", probe * count, np.array([float(count)]))

    def merge(self, sums: dict, count: int) -> None:
        for k, old in enumerate(self.slices):
            num, den = object_sums({("object", i, j): v for (what, i, j), v in sums.items() if what == f"slice{k}"}, old.shape[-2:])
            self.slices[k] = np.where(den > 0, num / np.maximum(den, 1e-300), old[0])[None]
        probe, n = sums["probe", 0, 0]
        self.state = State(self.supported((probe / max(n[0], 1)).reshape(self.state.probe.shape)), np.prod(self.slices, axis=0))

    def snapshot(self):
        arrays, numbers, waves = super().snapshot()
        return arrays | {f"slice{k}": s for k, s in enumerate(self.slices)}, numbers, waves

    def restore(self, arrays, numbers, waves=None) -> None:
        super().restore(arrays, numbers, waves)
        self.slices = [arrays[f"slice{k}"] for k in range(len(self.slices))]
