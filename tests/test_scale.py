"""What keeps engines bounded: trees of sums, domains by size, broadcast limits, places refined within runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavesift.operators import engines, posref, tiled
from wavesift.operators.engines import State, TileSums, collect_sums, tree_levels
from wavesift.sources.frames import moonflower


def test_levels_grow_with_the_logarithm():
    assert [tree_levels(n) for n in (1, 16, 17, 256, 257, 4096, 10_000, 100_000)] == [0, 0, 1, 1, 2, 2, 3, 4]


def test_no_task_of_the_tree_adds_more_than_its_fan_in(spark, monkeypatch):
    """600 tasks: every group that is added has 16 rows at most, else the sum fails."""
    plain = engines._add_up

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 16:
            raise AssertionError(f"{len(pdf)} sums in one task")
        return plain(pdf)

    monkeypatch.setattr(engines, "_add_up", bounded)

    def partial(batches):
        sums = TileSums()
        for pdf in batches:
            for i in pdf["id"]:
                sums.add("a", np.full(3, i + 1j), np.ones(2))
        yield sums.rows()

    out = collect_sums(spark.range(0, 1200, 1, 600).mapInPandas(partial, engines.SUMS))
    num, den = out["a", 0, 0]
    assert np.allclose(num, sum(range(1200)) + 1200j) and np.array_equal(den, [1200, 1200])


@pytest.mark.parametrize("name", ["AP", "ML", "EPIE"])
def test_places_are_found_again_within_a_run(spark, name):
    """Frames are one pixel off; probe and object are right and held."""
    frames, probe, obj = moonflower(spark, 16, 16, 0.25)
    true = {r["frame_idx"]: (r["r0"], r["c0"]) for r in frames.collect()}
    off = frames.withColumn("r0", F.when(F.col("frame_idx") % 2 == 0, F.greatest(F.col("r0") - 1, F.lit(0))).otherwise(F.col("r0")).cast("int"))
    how = posref.PositionRefinement(method="GridSearch", max_shift=1, start=1)
    held = {"AP": {"object_inertia": 1e12}, "ML": {}, "EPIE": {"alpha": 0.0}}[name]
    e = engines.by_name(name)(off, State(probe[None].astype(complex), obj[None].copy()), numiter=1, probe_update_start=99, position_refinement=how, **held)
    if name == "ML":
        e.best_step = lambda b: 0.0
    e.run()
    assert {r["frame_idx"]: (r["r0"], r["c0"]) for r in e.placed().collect()} == true


def test_domains_follow_the_number_of_frames(spark, monkeypatch):
    frames, probe, obj = moonflower(spark, 16, 16, 0.25)
    monkeypatch.setattr(engines, "DOMAIN_FRAMES", 5)
    e = engines.by_name("SDR")(frames, State(probe[None].astype(complex), np.ones((1, *obj.shape), complex)), numiter=2, probe_update_start=9)
    e.run()
    assert e.domains == 4 and e.log[-1]["err_fourier"] < e.log[0]["err_fourier"]


def test_large_states_are_not_broadcast(spark, monkeypatch):
    frames, probe, obj = moonflower(spark, 4, 16, 0.25)
    monkeypatch.setattr(engines, "BROADCAST_BYTES", 1000)
    with pytest.raises(ValueError, match="broadcast"):
        engines.DM(frames, State(probe[None].astype(complex), obj[None])).run()


@pytest.mark.parametrize("engine", ["AP", "TiledDM", "TiledRAAR", "RAAR"])
@pytest.mark.parametrize("before", ["64m", "67108864b", "1000"])
def test_workers_of_engines_get_frames_in_small_batches(spark, engine, before):
    """What a worker holds at a time does not grow with the frames of its task; lower limits stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    frames = spark.range(0, 3000, 1, 1).selectExpr("id AS frame_idx", "0 AS r0", "0 AS c0", "32 AS n", "cast(repeat('abcd', 1024) AS binary) AS intensity", "cast(repeat('a', 1024) AS binary) AS mask")

    def held(batches):
        for pdf in batches:
            yield pd.DataFrame({"b": [int(pdf["intensity"].str.len().sum() + pdf["mask"].str.len().sum())]})

    spark.conf.set(key, before)
    try:
        getattr(tiled if engine.startswith("Tiled") else engines, engine)(frames, State(np.ones((1, 32, 32), complex), np.ones((1, 32, 32), complex)))
        sizes = [r["b"] for r in frames.mapInPandas(held, "b long").collect()]
    finally:
        spark.conf.unset(key)
    assert sum(sizes) == 3000 * 5120 and max(sizes) <= (8 << 10 if before == "1000" else 2 << 20)
