"""A whole run from one parameter tree: source, model, engines, result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions.arrays import grids
from wavesift.operators import bragg, lowrank  # noqa: F401  register their engines
from wavesift.operators.engines import State, by_name
from wavesift.operators.posref import PositionRefinement
from wavesift.plans.params import Param, as_param, engine_schema
from wavesift.sources import files
from wavesift.sources.frames import FRAMES, moonflower, quickscan
from wavesift.sources.layouts import LAYOUTS

SOURCES: dict[str, Callable] = {}


def source(name: str):
    """Decorator: a function of (spark, parameters) that gives (frames, probe, object shape) by this name."""

    def add(f):
        SOURCES[name] = f
        return f

    return add


@source("moonflower")
def _moonflower(spark: SparkSession, p: Param):
    frames, probe, obj = moonflower(spark, p.num_frames, p.shape, p.density, p.photons)
    return frames, probe, obj.shape


@source("quickscan")
def _quickscan(spark: SparkSession, p: Param):
    n = p.shape
    return quickscan(spark, p.num_frames, n), np.ones((n, n), complex), (n, n)


def _of_files(frames: DataFrame, p: Param):
    """Frames, a first disc probe of their power, and the shape of the object that their places span."""
    r = frames.agg(F.max(F.col("r0") + F.col("n")).alias("h"), F.max(F.col("c0") + F.col("n")).alias("w"), F.max("n").alias("n")).first()
    if r["n"] is None:
        raise ValueError("the scan has no frames")

    def power(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": [float((np.frombuffer(a, "<f4") * np.frombuffer(m, np.uint8)).sum()) for a, m in zip(pdf["intensity"], pdf["mask"], strict=True)]})

    n, total = r["n"], frames.mapInPandas(power, "p double").agg(F.avg("p")).first()[0]
    disc = (np.hypot(*grids((n, n))) <= p.probe_radius * n).astype(complex)
    return frames, disc * np.sqrt(total / max(disc.real.sum(), 1)), (r["h"], r["w"])


@source("parquet")
def _parquet(spark: SparkSession, p: Param):
    return _of_files(files.read_frames(spark, p.path).select(*(f.split()[0] for f in FRAMES.split(", "))), p)


@source("npy")
def _npy(spark: SparkSession, p: Param):
    return _of_files(files.read_npy(spark, p.path, np.load(p.slow), np.load(p.fast), p.resolution), p)


@source("hdf5")
def _hdf5(spark: SparkSession, p: Param):
    layout = LAYOUTS[p.layout]
    return _of_files(files.read_hdf5(spark, p.path, layout["intensity"], p.slow or layout["slow"], p.fast or layout["fast"], p.resolution), p)


class Reconstruction:
    """Levels: 1 parameters, 2 frames, 3 first guesses, 4 engines, 5 run."""

    def __init__(self, spark: SparkSession, pars: dict, level: int = 5):
        schema = engine_schema()
        self.spark, self.pars = spark, schema.defaults()
        self.pars.update(as_param(pars), in_place_depth=4)
        schema.validate(self.pars)
        self.shared = schema.at("engines.*").children
        self.states: dict[str, State] = {}
        self.engines: list = []
        self.frames: DataFrame | None = None
        for step in (self.init_frames, self.init_state, self.init_engines, self.run)[: max(0, level - 1)]:
            step()

    def init_frames(self) -> None:
        self.frames, self.probe, self.shape = SOURCES[self.pars.scan.source](self.spark, self.pars.scan)
        self.frames = self.frames.persist()

    def init_state(self) -> None:
        self.state = State(self.probe[None].astype(complex), np.ones((1, *self.shape), complex))

    def init_engines(self, label: str | None = None) -> None:
        """Engines in the order of their labels, or one of them."""
        labels = sorted(self.pars.engines) if label is None else [label]
        for x in labels:
            if x not in self.pars.engines:
                raise KeyError(f"no engine is labelled {x!r}")
            own = dict(self.pars.engines[x])
            cls = by_name(own.pop("name", "DM"))
            # Defaults that templates fill in for engines of every kind say nothing about this one.
            unknown = sorted(k for k, v in own.items() if k not in cls.__dataclass_fields__ and (k not in self.shared or v != self.shared[k].default))
            if unknown:
                raise ValueError(f"engine {x!r} ({cls.name}) has no parameters {', '.join(unknown)}")
            allowed = {k: v for k, v in own.items() if k in cls.__dataclass_fields__}
            if isinstance(allowed.get("position_refinement"), dict):
                allowed["position_refinement"] = PositionRefinement(**allowed["position_refinement"])
            self.engines.append(cls(self.frames, self.state, **allowed))

    def run(self) -> State:
        for e in self.engines:
            e.state = self.state
            self.state = e.run()
        return self.state

    def copy_state(self, name: str = "baseline", overwrite: bool = False) -> None:
        if name in self.states and not overwrite:
            raise ValueError(f"there is a state {name!r}")
        self.states[name] = State(self.state.probe.copy(), self.state.obj.copy())

    def restore_state(self, name: str = "baseline") -> None:
        if name not in self.states:
            raise KeyError(f"no state {name!r}")
        self.state = State(self.states[name].probe.copy(), self.states[name].obj.copy())

    def iter_info(self) -> DataFrame:
        out = self.engines[0].iter_info()
        for e in self.engines[1:]:
            out = out.unionByName(e.iter_info())
        return out

    def save(self, path: str) -> None:
        from wavesift.plans.params import as_json

        files.write_result(self.spark, path, self.state, self.iter_info() if self.engines else None, as_json(self.pars))

    def close(self) -> None:
        """Frees the frames that were kept in memory."""
        if self.frames is not None:
            self.frames.unpersist()

    def stats(self) -> dict[str, int]:
        return {"frames": self.frames.count() if self.frames is not None else 0, "probe_bytes": self.state.probe.nbytes, "object_bytes": self.state.obj.nbytes}
