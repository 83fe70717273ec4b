"""Frames that arrive while a scan runs: bounded work, restarts, curves that complete and such that are given up."""

import shutil
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.operators.engines import AP, DM, ML, State
from wavesift.sources import files
from wavesift.sources.commits import Commits, commit_each, resume
from wavesift.sources.frames import FRAMES, moonflower
from wavesift.streaming.live import LiveReconstruction
from wavesift.streaming.rocking import complete_positions, complete_positions_stream, drain, kept_rows, rocksdb_state

NAMES = [c.split()[0] for c in FRAMES.split(", ")]


@pytest.fixture(scope="module")
def data(spark):
    frames, probe, obj = moonflower(spark, 16, 16, 0.3)
    return frames.persist(), probe, obj


def start(data):
    _, probe, obj = data
    return State(probe[None].astype(complex), np.ones((1, *obj.shape), complex))


def make(frames, state):
    return DM(frames, state, overlap_max_iterations=1)


def batches(data):
    frames = data[0]
    return [frames.filter(F.col("frame_idx") % 3 == k) for k in range(3)]


def test_a_batch_needs_no_frames_of_earlier_ones(data, tmp_path):
    path = str(tmp_path / "live")
    live = LiveReconstruction(make, start(data), path)
    for epoch, batch in enumerate(batches(data)):
        live.on_batch(batch, epoch)
        shutil.rmtree(f"{path}/waves/commit={epoch}")  # nothing reads them again
    assert live.frames_seen == 16 and not np.allclose(live.state.obj, 1)


def test_restart_in_the_middle_gives_the_same(data, tmp_path):
    one = LiveReconstruction(make, start(data), str(tmp_path / "one"), iterations=2, min_frames=6)
    for epoch, batch in enumerate(batches(data)):
        one.on_batch(batch, epoch)
    parts = batches(data)
    two = LiveReconstruction(make, start(data), str(tmp_path / "two"), iterations=2, min_frames=6)
    two.on_batch(parts[0], 0)
    two.on_batch(parts[1], 1)
    shutil.rmtree(tmp_path / "two" / "marks" / "commit=1")  # the driver was lost before its commit
    three = LiveReconstruction(make, start(data), str(tmp_path / "two"), iterations=2, min_frames=6)
    assert three.epoch == 0 and three.frames_seen == parts[0].count()
    for epoch in (0, 1, 1, 2):  # epochs come again
        three.on_batch(parts[epoch], epoch)
    assert three.frames_seen == 16
    assert np.allclose(one.state.obj, three.state.obj) and np.allclose(one.state.probe, three.state.probe)
    assert np.allclose(one.refine(2).obj, three.refine(2).obj)


def test_one_batch_of_all_is_the_batch_run(data, tmp_path):
    live = LiveReconstruction(make, start(data), str(tmp_path / "live"), iterations=2)
    live.on_batch(data[0], 0)
    whole = make(data[0], start(data))
    whole.run(2)
    assert np.allclose(live.state.obj, whole.state.obj)
    whole.run(2)
    assert np.allclose(live.refine(2).obj, whole.state.obj)  # waves and state go on as if never stored


def test_stream_of_files(spark, data, tmp_path):
    files.write_frames(data[0], str(tmp_path / "in"), "s", 8)
    files.write_frames(data[0].limit(3), str(tmp_path / "in"), "s", 8)  # frames that come twice
    stream = files.stream_frames(spark, str(tmp_path / "in"), 1).select(*NAMES)
    live = LiveReconstruction(make, start(data), str(tmp_path / "live"))
    live.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    assert live.frames_seen == 16
    assert live.commits.all_waves(live.epoch).count() == 16


@pytest.mark.parametrize("cls", [DM, AP, ML])
def test_resumed_runs_go_on_as_if_never_stopped(data, tmp_path, cls):
    whole = cls(data[0], start(data), probe_update_start=1)
    whole.run(4)
    path = str(tmp_path / "run")
    first = cls(data[0], start(data), probe_update_start=1)
    commit_each(first, path)
    first.run(2)
    second = resume(cls(data[0], start(data), probe_update_start=1), path)
    assert second.iteration == 2 and [r["iteration"] for r in second.log] == [1, 2]
    second.run(2)
    assert np.allclose(second.state.obj, whole.state.obj) and np.allclose(second.state.probe, whole.state.probe)
    assert [r["iteration"] for r in second.log] == [1, 2, 3, 4]


def test_commits_without_a_mark_do_not_count(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "c"))
    assert c.last() == -1
    c.write(0, {"a": np.arange(4).reshape(2, 2) * 1j}, {"x": 1})
    assert c.last() == 0
    arrays, numbers = c.read(0)
    assert np.array_equal(arrays["a"], np.arange(4).reshape(2, 2) * 1j) and numbers == {"x": 1} and c.waves(0) is None
    shutil.rmtree(tmp_path / "c" / "marks" / "commit=0")
    assert c.last() == -1


def at(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def test_curves_complete_expire_and_leave_no_state(spark, tmp_path):
    schema, path = "pos int, angle int, time timestamp", str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame([(p, a, at(t) if t else None) for p, a, t in rows], schema).coalesce(1).write.mode("append").parquet(path)

    add(*[(0, a, 100 + a) for a in range(4)], (1, 0, 100), (1, 2, 101), (1, 9, 101), (0, 1, 102))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with rocksdb_state(spark):
        q = complete_positions_stream(stream, "pos", "angle", [0, 1, 2, 3], "time", "10 seconds", 60).writeStream.format("memory").queryName("curves").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            def seen():
                q.processAllAvailable()
                return sorted((r["pos"], r["angles"], r["status"]) for r in spark.table("curves").collect())

            assert seen() == [(0, [0, 1, 2, 3], "complete")]
            add((0, 2, 120), (2, 0, 120))  # a complete curve is not opened anew
            assert seen() == [(0, [0, 1, 2, 3], "complete")]
            add((2, 1, 175))  # the watermark passes 161 s: curve 1 is given up, 2 is not
            q.processAllAvailable()
            add((3, 0, 176))
            assert seen() == [(0, [0, 1, 2, 3], "complete"), (1, [0, 2], "given_up")]
            add((1, 1, 20), (1, 3, 21))  # late: dropped
            add((2, 2, 177), (2, 3, 178))
            assert (2, [0, 1, 2, 3], "complete") in seen() and len(seen()) == 3
            add((None, None, 10_000))  # the end of the scan
            drain(q, 60)
            assert (3, [0], "given_up") in seen() and len(seen()) == 4 and kept_rows(q) == 0
        finally:
            q.stop()


def test_complete_positions_of_a_table(spark):
    rows = [(p, a) for p in range(3) for a in range(4) if (p, a) != (2, 1)]
    df = spark.createDataFrame(rows, "pos int, angle int")
    assert {r["pos"]: r["angles"] for r in complete_positions(df, "pos", "angle", 4).collect()} == {0: [0, 1, 2, 3], 1: [0, 1, 2, 3]}
