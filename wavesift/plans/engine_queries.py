"""Reconstructions as queries: what SQL cannot express. Rows are iterations, frames or pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions.propagate import Geometry
from wavesift.operators import bragg, lowrank  # noqa: F401  register their engines
from wavesift.operators import posref
from wavesift.operators.engines import ENGINES, State, by_name
from wavesift.plans.demo_tables import VECTOR_SQL, read, rounded
from wavesift.sources.frames import moonflower, pixels, prepare, simulated
from wavesift.functions import generate
from wavesift.operators.scan import spiral_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FRAMES, SIZE = 36, 24


def _scan(spark: SparkSession) -> tuple[DataFrame, State]:
    frames, probe, obj = moonflower(spark, FRAMES, SIZE, 0.2)
    return frames.persist(), State(probe[None].astype(complex), np.ones((1, *obj.shape), complex))


def _engine(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, state = _scan(spark)
        e = by_name(name)(frames, state, numiter=3, probe_update_start=1, **({"clip_object": (0.0, 1.3)} if name == "WASP" else {}))
        e.run()
        return e.iter_info().drop("duration")

    QUERIES[f"engine_{name.lower()}"] = run


for _name in ENGINES:
    if _name not in ("DM_3dBragg", "DM", "RAAR", "AP", "DM_object_regul", "ML", "EPIE", "EPIEParallel", "SDR", "WASP"):  # volumes have a query of their own, the others one with SQL
        _engine(_name)


def engine_dm_3dbragg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rocking curves of a thin layer, thinned by its support."""
    obj = np.zeros((6, 24, 24), complex)
    obj[2:4] = generate.flower((24, 24))
    probe = np.repeat(generate.moon(12, 1e5)[None], 6, axis=0)
    frames = bragg.bragg_scan(spark, probe, obj, [(r, c) for r in range(0, 13, 4) for c in range(0, 13, 4)]).persist()
    e = bragg.BraggDM(frames, State(probe, np.full(obj.shape, 0.5 + 0j)), numiter=3, probe_update_start=99, support=bragg.BraggSupport())
    e.run()
    return e.iter_info().drop("duration")


QUERIES["engine_dm_3dbragg"] = engine_dm_3dbragg


def _posref(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, probe, obj = moonflower(spark, FRAMES, SIZE, 0.2)
        off = frames.withColumn("r0", F.greatest(F.col("r0") - (F.col("frame_idx") % 2).cast("int"), F.lit(0)))
        how = posref.PositionRefinement(method=method, nshifts=12, max_shift=2)
        return posref.refine(off, State(probe[None].astype(complex), obj[None]), how)

    QUERIES[f"posref_{method.lower()}"] = run


_posref("Annealing")


def moonflower_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(moonflower(spark, 9, 16, 0.3)[0])


def simulated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spiral scan over a star with a blurred, noisy detector."""
    obj = generate.init_object((96, 96), "star")
    return simulated(spark, generate.moon(24), obj, spiral_scan(spark, 6.0, 30.0), 1.0, generate.DETECTORS["ccd"], 3).drop("mask")


def prepared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cropped, turned and binned."""
    return prepare(moonflower(spark, 9, 16, 0.3)[0], 12, None, 5, 2).select("frame_idx", "n", F.length("intensity").alias("bytes"))


def embedding_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading modes of the embeddings, and how much of their power each holds."""
    e = read(spark, sf_dir, "embeddings")

    def as_bytes(batches):
        for pdf in batches:
            yield pdf.assign(v=[np.asarray(v, float).astype("<c16").tobytes() for v in pdf["embedding"]])[["v"]]

    rows = e.select("embedding").mapInPandas(as_bytes, "v binary")
    modes = lowrank.leading_modes(rows, "v", 64, 4, steps=6)
    w = lowrank._products(rows, "v", modes)
    power = np.einsum("ij,ij->i", modes.conj(), w).real
    return spark.createDataFrame([(i, round(float(p), 3)) for i, p in enumerate(power)], "mode int, power double")


def farfield_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 by 8 wave, carried to the far field and back: power before and after, largest difference."""
    g = Geometry(shape=(8, 8)).resolved()

    def run(batches):
        p = g.propagator()
        for pdf in batches:
            w = np.stack([np.asarray(v, float).reshape(8, 8) for v in pdf["embedding"]]) + 0j
            f = p.fw(w)
            yield pdf[["vec_id"]].assign(before=(np.abs(w) ** 2).sum(axis=(1, 2)), after=(np.abs(f) ** 2).sum(axis=(1, 2)), back=np.abs(p.bw(f) - w).max(axis=(1, 2)))

    waves = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, before double, after double, back double")
    return rounded(waves, 5, "before", "after", "back")


ORACLE["farfield_embeddings"] = f"SELECT vec_id, round(sum(v * v), 5) AS before, round(sum(v * v), 5) AS after, 0.0::DOUBLE AS back FROM {VECTOR_SQL} GROUP BY vec_id"


for _f in (moonflower_pixels, simulated_scan, prepared_frames, embedding_modes, farfield_embeddings):
    QUERIES[_f.__name__] = _f
