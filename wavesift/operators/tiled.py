"""Engines whose object is a table of tiles, for objects larger than a broadcast.

A tile is a row (i, j, o) with all modes of a square of the object. A frame is at
home in the tile that holds its first pixel; with frames no larger than a tile it
touches that one and its three neighbours below and to the right. In a pass,
frames are dealt by home, each home gets copies of its four tiles, and what is
summed goes back by tile. Homes of many frames are dealt to several tasks. The
driver gets the probe's sums, costs and norms, and never a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.operators.engines import AP, DM, ERRORS, ML, RAAR, SUMS, State, collect_sums
from wavesift.plans.session import checkpoint

#: Side of a tile, where none is given.
TILE = 256
#: Frames of one home that one task takes.
FRAMES = 4096
#: Homes that are dealt to several tasks are broadcast up to this many.
BROADCAST_ROWS = 50_000
CELL = ("hi", "hj", "salt")
WAVES = "hi int, hj int, salt int, frame_idx long, r0 int, c0 int, n int, intensity binary, mask binary, exit binary, err_fourier double, err_photon double, err_exit double"
TILES = "i int, j int, o binary"


def _complex(b: bytes, tile: int) -> np.ndarray:
    return np.frombuffer(b, "<c16").reshape(-1, tile, tile)


def filled(spark: SparkSession, shape: tuple[int, int], values: list[complex], tile: int = TILE) -> DataFrame:
    """Tiles of an object with a mode for each of ``values``, made where they are kept."""
    rows, columns = (-(-s // tile) for s in shape)
    own = np.concatenate([np.full((1, tile, tile), v, "<c16") for v in values]).tobytes()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf["id"].tolist():
                yield pd.DataFrame({"i": [at // columns], "j": [at % columns], "o": [own]})

    return spark.range(rows * columns).mapInPandas(make, TILES)


def cut(spark: SparkSession, obj: np.ndarray, tile: int = TILE) -> DataFrame:
    """Tiles of an array that the driver has."""
    rows, columns = (-(-s // tile) for s in obj.shape[-2:])
    padded = np.pad(obj.astype("<c16"), [(0, 0), *((0, n * tile - s) for n, s in zip((rows, columns), obj.shape[-2:], strict=True))])
    data = [(i, j, padded[:, i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].tobytes()) for i in range(rows) for j in range(columns)]
    return spark.createDataFrame(data, TILES)


def pixels(tiles: DataFrame, shape: tuple[int, int], tile: int) -> DataFrame:
    """(mode, y, x, re, im) of an object kept in tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, j, o in zip(pdf["i"], pdf["j"], pdf["o"], strict=True):
                own = _complex(o, tile)[:, : max(shape[0] - i * tile, 0), : max(shape[1] - j * tile, 0)]
                mode, y, x = (a.ravel() for a in np.indices(own.shape))
                yield pd.DataFrame({"mode": mode.astype(np.int32), "y": (y + i * tile).astype(np.int32), "x": (x + j * tile).astype(np.int32), "re": own.real.ravel(), "im": own.imag.ravel()})

    return tiles.select("i", "j", "o").mapInPandas(run, "mode int, y int, x int, re double, im double")


class Cell:
    """The tiles around one home: images over them and sums, 2 by 2 tiles large."""

    def __init__(self, key: tuple[int, int, int], tile: int, modes: int):
        self.key, self.tile = key, tile
        self.images: dict[str, np.ndarray] = {}
        self.num, self.den, self.used = np.zeros((modes, 2 * tile, 2 * tile), complex), np.zeros((2 * tile, 2 * tile)), False

    def at(self, r: int, c: int, n: int) -> tuple:
        y, x = r - self.key[0] * self.tile, c - self.key[1] * self.tile
        return ..., slice(y, y + n), slice(x, x + n)

    def put(self, i: int, j: int, name: str, image: np.ndarray) -> None:
        own = self.images.setdefault(name, np.zeros_like(self.num))
        y, x = (i - self.key[0]) * self.tile, (j - self.key[1]) * self.tile
        own[:, y : y + self.tile, x : x + self.tile] = image

    def add(self, at: tuple, num: np.ndarray, den: np.ndarray | float) -> None:
        self.num[at] += num
        self.den[at] += den
        self.used = True

    def sums(self) -> Iterator[tuple[str, int, int, bytes, bytes]]:
        """Rows of SUMS for the tiles that something was added to."""
        for a, b in product(range(2), range(2)) if self.used else ():
            at = (..., slice(a * self.tile, (a + 1) * self.tile), slice(b * self.tile, (b + 1) * self.tile))
            if self.num[at].any() or self.den[at].any():
                yield "object", self.key[0] + a, self.key[1] + b, self.num[at].astype("<c16").tobytes(), self.den[at].astype("<f8").tobytes()


def over_cells(batches: Iterator[pd.DataFrame], tile: int, modes: int, images: Callable | None = None) -> Iterator[tuple[Cell, object]]:
    """(cell, frame) for every frame, and (cell, None) after the last of a cell; rows are sorted by cell, tiles first.

    ``images`` gives the named images of a tile's row.
    """
    cell = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key = (row.hi, row.hj, row.salt)
            if cell is None or key != cell.key:
                if cell is not None:
                    yield cell, None
                cell = Cell(key, tile, modes)
            if getattr(row, "kind", 1) == 0:
                for name, image in images(row).items():
                    cell.put(int(row.i), int(row.j), name, image)
            else:
                yield cell, row
    if cell is not None:
        yield cell, None


def frame_of(row) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    n = int(row.n)
    return int(row.r0), int(row.c0), n, np.frombuffer(row.intensity, "<f4").reshape(n, n).astype(float), np.frombuffer(row.mask, np.uint8).reshape(n, n).astype(float)


def deal(frames: DataFrame, tile: int, most: int = FRAMES) -> tuple[DataFrame, DataFrame]:
    """(frames with their cell, cells): a home of more than ``most`` frames has several cells."""
    own = frames.withColumn("hi", F.floor(F.col("r0") / tile).cast("int")).withColumn("hj", F.floor(F.col("c0") / tile).cast("int"))
    homes = checkpoint(own.groupBy("hi", "hj").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("cut")))
    full = homes.filter("cut > 1")
    if full.count() <= BROADCAST_ROWS:
        full = F.broadcast(full)
    own = own.join(full, ["hi", "hj"], "left").withColumn("salt", F.pmod(F.xxhash64("frame_idx"), F.coalesce("cut", F.lit(1))).cast("int")).drop("cut")
    return own, homes.select("hi", "hj", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("salt"))


class Tiled:
    """What tiled engines share. Beside the fields of their kind they take ``tiles`` and ``tile``; ``state.obj`` has no pixels."""

    tiles: DataFrame
    tile: int

    def check(self, **off) -> None:
        n = self.state.probe.shape[-1]
        if n > self.tile:
            raise ValueError(f"frames of {n} pixels need tiles of {n} or more, not {self.tile}")
        for name, default in {"position_refinement": None, **off}.items():
            if getattr(self, name) != default:
                raise ValueError(f"{name} is not there for tiled objects")

    def met(self, frames: DataFrame, columns: list[str]) -> DataFrame:
        """Frames and copies of the tiles that they touch, by cell, tiles first."""
        offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product(range(2), range(2))]))
        near = self.cells.withColumn("to", offsets).select(*CELL, (F.col("hi") + F.col("to.a")).alias("i"), (F.col("hj") + F.col("to.b")).alias("j"))
        tiles = near.join(self.tiles.select("i", "j", *columns), ["i", "j"]).withColumn("kind", F.lit(0))
        rows = frames.withColumn("kind", F.lit(1)).unionByName(tiles, allowMissingColumns=True)
        rows = rows.fillna(0, [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long")])  # whole numbers stay whole in pandas
        return rows.repartition(*CELL).sortWithinPartitions(*CELL, "kind", "frame_idx")

    def changed(self, sums: DataFrame, columns: list[str], schema: str, change: Callable) -> DataFrame:
        """``change(tile row, num, den)`` of every tile with its sums added up; a tile and one sum are in memory at a time."""
        tile = self.tile

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            row, num, den = None, None, None
            for pdf in batches:
                for own in pdf.itertuples(index=False):
                    if own.kind == 0:
                        if row is not None:
                            yield change(row, num, den)
                        row, num, den = own, 0, 0
                    else:
                        num, den = num + _complex(own.num, tile), den + np.frombuffer(own.den).reshape(tile, tile)
            if row is not None:
                yield change(row, num, den)

        old = self.tiles.select("i", "j", *columns).withColumn("kind", F.lit(0))
        own = sums.filter("what = 'object'").select("i", "j", "num", "den").withColumn("kind", F.lit(1))
        rows = old.unionByName(own, allowMissingColumns=True).repartition("i", "j").sortWithinPartitions("i", "j", "kind")
        return checkpoint(rows.mapInPandas(run, schema))


class TiledProjection(Tiled):
    """The passes of a projection engine over tiles. The first sums of an iteration come with the projection itself."""

    def prepare(self) -> None:
        self.check(obj_smooth_std=None, probe_center_tol=None)
        self.modes = len(self.state.obj)
        placed, self.cells = deal(self.frames, self.tile)

        def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"p": [float((np.frombuffer(a, "<f4") * np.frombuffer(m, np.uint8)).sum()) for a, m in zip(pdf["intensity"], pdf["mask"], strict=True)]})

        s = self.frames.select("intensity", "mask").mapInPandas(power, "p double").agg(F.max("p").alias("top"), F.avg("p").alias("mean"), F.count(F.lit(1)).alias("n")).first()
        npix = self.state.probe.shape[-1] ** 2
        self.num_frames, self.mean_power = s["n"], (s["mean"] or 0.0) / npix
        self.pbound = self.fourier_power_bound if self.fourier_power_bound is not None else 0.25 * self.fourier_relax_factor**2 * (s["top"] or 0.0) / npix
        none = {"exit": F.lit(None).cast("binary"), **{e: F.lit(0.0) for e in ERRORS}}
        self.waves, self.sums = placed.withColumns(none), None
        self.norms: dict[str, float] = {}

    def fourier_update(self) -> dict[str, float]:
        """Exit waves, and in the same pass the object's sums. A frame without a wave starts with that of probe and object."""
        (a, b, c), pbound, likelihood, tile, modes, shared = self.coefficients(), self.pbound, self.compute_log_likelihood, self.tile, self.modes, self.broadcast()

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe, out = shared.value[0], []
            den = K.abs2(probe).sum(axis=0)
            for cell, row in over_cells(batches, tile, modes, lambda t: {"o": _complex(t.o, tile)}):
                if row is None:
                    yield pd.DataFrame(out, columns=[f.split()[0] for f in WAVES.split(", ")])
                    yield pd.DataFrame(list(cell.sums()), columns=["what", "i", "j", "num", "den"])
                    out = []
                    continue
                r, q, n, intensity, mask = frame_of(row)
                at = cell.at(r, q, n)
                patch = cell.images["o"][at]
                psi = K.pairs(probe, patch) if row.exit is None else np.frombuffer(row.exit, "<c16").reshape(-1, n, n)
                psi, fourier, change = K.projection(psi, probe, patch, intensity, mask, a, b, c, pbound)
                photon = K.log_likelihood(probe, patch, intensity, mask) if likelihood else 0.0
                cell.add(at, K.object_sum(probe, psi, modes), den)
                out.append((*cell.key, row.frame_idx, r, q, n, row.intensity, row.mask, psi.astype("<c16").tobytes(), fourier, photon, change))
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=[f.split()[0] for f in WAVES.split(", ")])
                    out = []

        both = [*WAVES.split(", "), *SUMS.split(", ")]
        names = [f.split()[0] for f in both]

        def all_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in project(batches):
                whole = pdf.reindex(columns=names)
                yield whole.astype({f.split()[0]: "Int64" if f.split()[1] in ("int", "long") else object for f in both if f.split()[1] != "double"})

        done = checkpoint(self.met(self.waves, ["o"]).mapInPandas(all_columns, ", ".join(both)))
        shared.destroy()
        self.waves = done.filter("what is null").select(*[f.split()[0] for f in WAVES.split(", ")])
        self.sums = done.filter("what is not null").select(*[f.split()[0] for f in SUMS.split(", ")])
        means = self.waves.agg(*[F.avg(e).alias(e) for e in ERRORS]).first()
        return {e: means[e] or 0.0 for e in ERRORS}

    def object_sums(self) -> DataFrame:
        """Sums with the present probe; waves stay where they are, still sorted by cell."""
        tile, modes, shared = self.tile, self.modes, self.broadcast()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe = shared.value[0]
            den = K.abs2(probe).sum(axis=0)
            for cell, row in over_cells(batches, tile, modes):
                if row is None:
                    yield pd.DataFrame(list(cell.sums()), columns=["what", "i", "j", "num", "den"])
                else:
                    n = int(row.n)
                    cell.add(cell.at(int(row.r0), int(row.c0), n), K.object_sum(probe, np.frombuffer(row.exit, "<c16").reshape(-1, n, n), modes), den)

        return self.waves.mapInPandas(run, SUMS)

    def object_update(self) -> None:
        sums, self.sums = self.object_sums() if self.sums is None else self.sums, None
        c, tile, limited = self.object_inertia * self.mean_power, self.tile, _limits(self.clip_object)

        def change(row, num, den) -> pd.DataFrame:
            old = _complex(row.o, tile)
            total = c + den
            new = limited(np.where(total > 0, (c * old + num) / np.maximum(total, 1e-300), old))
            return pd.DataFrame({"i": [row.i], "j": [row.j], "o": [new.astype("<c16").tobytes()], "moved": [float(K.abs2(new - old).sum())], "norm": [float(K.abs2(new).sum())]})

        done = self.changed(sums, ["o"], f"{TILES}, moved double, norm double", change)
        norms = done.agg(F.sum("moved").alias("moved"), F.sum("norm").alias("norm")).first()
        self.norms = {"moved": norms["moved"] or 0.0, "norm": norms["norm"] or 0.0}
        self.tiles = done.select("i", "j", "o")

    def probe_update(self) -> float:
        tile, modes, shared = self.tile, self.modes, self.broadcast()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe = shared.value[0]
            num, den = np.zeros(probe.shape, complex), np.zeros(probe.shape[-2:])
            for cell, row in over_cells(batches, tile, modes, lambda t: {"o": _complex(t.o, tile)}):
                if row is not None:
                    n = int(row.n)
                    patch = cell.images["o"][cell.at(int(row.r0), int(row.c0), n)]
                    num += K.probe_sum(patch, np.frombuffer(row.exit, "<c16").reshape(-1, n, n), len(probe))
                    den += K.abs2(patch).sum(axis=0)
            yield pd.DataFrame([("probe", 0, 0, num.tobytes(), den.tobytes())], columns=["what", "i", "j", "num", "den"])

        num, den = collect_sums(self.met(self.waves.select(*CELL, "frame_idx", "r0", "c0", "n", "exit"), ["o"]).mapInPandas(run, SUMS))["probe", 0, 0]
        shared.destroy()
        old, c = self.state.probe, self.probe_inertia * self.num_frames
        new = self.supported((c * old + num.reshape(old.shape)) / (c + den.reshape(old.shape[-2:]) + 1e-300))
        self.state.probe = new
        return float(np.sqrt(K.abs2(new - old).sum() / max(K.abs2(new).sum(), 1e-300)))


def _limits(clip: tuple[float, float] | None) -> Callable[[np.ndarray], np.ndarray]:
    """Magnitudes clipped, without the engine in the closure."""

    def limited(obj: np.ndarray) -> np.ndarray:
        if clip is None:
            return obj
        m = np.abs(obj)
        return np.where(m > 0, obj / np.maximum(m, 1e-300), 1.0) * np.clip(m, *clip)

    return limited


@dataclass
class TiledDM(TiledProjection, DM):
    """Difference map over tiles."""

    tiles: DataFrame | None = None
    tile: int = TILE


@dataclass
class TiledRAAR(TiledProjection, RAAR):
    """Relaxed averaged alternating reflections over tiles."""

    tiles: DataFrame | None = None
    tile: int = TILE


@dataclass
class TiledAP(TiledProjection, AP):
    """Alternating projections over tiles."""

    tiles: DataFrame | None = None
    tile: int = TILE


@dataclass
class TiledML(Tiled, ML):
    """Conjugate gradients over tiles: a tile keeps the object (o), the last gradient (g) and the last direction (h)."""

    tiles: DataFrame | None = None
    tile: int = TILE

    def prepare(self) -> None:
        self.check(reg_del2=False, smooth_gradient=0.0, wavefield_precond=False, scale_precond=False)
        self.modes = len(self.state.obj)
        self.placed_frames, self.cells = deal(self.frames, self.tile)
        self.num_frames = self.frames.count()
        zero = np.zeros((self.modes, self.tile, self.tile), "<c16").tobytes()
        self.tiles = self.tiles.select("i", "j", "o", F.lit(zero).alias("g"), F.lit(zero).alias("h"))
        self.old_probe: np.ndarray | None = None
        self.step_probe: np.ndarray | None = None

    def gradient_sums(self) -> DataFrame:
        shared, model, floating, tile, modes = self.broadcast(), self.ml_type, self.floating_intensities, self.tile, self.modes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe = shared.value[0]
            g, cost = np.zeros(probe.shape, complex), 0.0
            for cell, row in over_cells(batches, tile, modes, lambda t: {"o": _complex(t.o, tile)}):
                if row is None:
                    yield pd.DataFrame(list(cell.sums()), columns=["what", "i", "j", "num", "den"])
                    continue
                r, c, n, intensity, mask = frame_of(row)
                at = cell.at(r, c, n)
                g_obj, g_probe, own = K.gradients(model, probe, cell.images["o"][at], intensity, mask, floating)
                cell.add(at, g_obj, 0.0)
                g, cost = g + g_probe, cost + own
            yield pd.DataFrame([("probe", 0, 0, g.tobytes(), np.array([cost]).tobytes())], columns=["what", "i", "j", "num", "den"])

        done = checkpoint(self.met(self.placed_frames, ["o"]).mapInPandas(run, SUMS))
        shared.destroy()
        return done

    def line_sums(self, beta: float, h_probe: np.ndarray) -> np.ndarray:
        sc = self.frames.sparkSession.sparkContext
        shared, model, whole, tile, modes = sc.broadcast((self.state.probe, h_probe)), self.ml_type, self.poly_line_coeffs == "all", self.tile, self.modes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probe, hp = shared.value
            total = np.zeros(9 if whole else 3)
            coefficients = K.line_coefficients_all if whole else K.line_coefficients
            for cell, row in over_cells(batches, tile, modes, lambda t: {"o": _complex(t.o, tile), "h": beta * _complex(t.h, tile) - _complex(t.g, tile)}):
                if row is not None:
                    r, c, n, intensity, mask = frame_of(row)
                    at = cell.at(r, c, n)
                    total += coefficients(model, probe, cell.images["o"][at], hp, cell.images["h"][at], intensity, mask)
            yield pd.DataFrame([("line", 0, 0, np.zeros(1, complex).tobytes(), total.tobytes())], columns=["what", "i", "j", "num", "den"])

        b = collect_sums(self.met(self.placed_frames, ["o", "g", "h"]).mapInPandas(run, SUMS))["line", 0, 0][1].copy()
        shared.destroy()
        return b

    def iterate(self) -> dict[str, float]:
        sums, tile = self.gradient_sums(), self.tile
        num, den = collect_sums(sums.filter("what = 'probe'"))["probe", 0, 0]
        g_probe, cost = num.reshape(self.state.probe.shape), float(den[0])
        if self.iteration < self.probe_update_start:
            g_probe = np.zeros_like(g_probe)
        dot = lambda x, y: float((np.conj(x) * y).sum().real)

        def turn(row, num, _) -> pd.DataFrame:
            old, h = _complex(row.g, tile), _complex(row.h, tile)
            g = np.zeros_like(old) + num
            return pd.DataFrame({"i": [row.i], "j": [row.j], "o": [row.o], "g": [g.astype("<c16").tobytes()], "h": [row.h], "gg": [dot(g, g)], "go": [dot(g, old)], "oo": [dot(old, old)], "hg": [dot(h, g)]})

        turned = self.changed(sums, ["o", "g", "h"], f"{TILES}, g binary, h binary, gg double, go double, oo double, hg double", turn)
        gg, go, oo, hg = turned.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("gg", "go", "oo", "hg")]).first()
        beta = 0.0
        if self.old_probe is not None:
            oo += dot(self.old_probe, self.old_probe)
            if oo > 0:
                beta = max(0.0, (gg + dot(g_probe, g_probe) - go - dot(g_probe, self.old_probe)) / oo)
        h_probe = -g_probe + (beta * self.step_probe if self.step_probe is not None else 0)
        if -gg + beta * hg + dot(h_probe, g_probe) > 0:
            beta, h_probe = 0.0, -g_probe
        self.tiles = turned.select("i", "j", "o", "g", "h")
        t, limited = self.best_step(self.line_sums(beta, h_probe)), _limits(self.clip_object)

        def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    h = beta * _complex(row.h, tile) - _complex(row.g, tile)
                    yield pd.DataFrame({"i": [row.i], "j": [row.j], "o": [limited(_complex(row.o, tile) + t * h).astype("<c16").tobytes()], "g": [row.g], "h": [h.astype("<c16").tobytes()]})

        self.tiles = checkpoint(self.tiles.mapInPandas(go_on, f"{TILES}, g binary, h binary"))
        self.state = State(self.supported(self.state.probe + t * h_probe), self.state.obj)
        self.old_probe, self.step_probe = g_probe, h_probe
        return {"err_photon": cost / max(self.num_frames, 1) / self.state.probe.shape[-1] ** 2}
