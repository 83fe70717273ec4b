"""Files that grow while they are read, and stacks read by slab."""

import subprocess
import sys
import time

import numpy as np
import pytest

from wavesift.sources import files, slabs
from wavesift.sources.growing import GrowingScan, GrowingSource
from wavesift.streaming.live import EOS, WAIT

N = 8
#: Appends frames lo to hi to data, slow and fast; positions come a little later than images.
WRITER = """
import sys, time, numpy as np
folder, lo, hi, n = sys.argv[1], *map(int, sys.argv[2:5])
for k in range(lo, hi):
    for name, a in (("data", np.full((n, n), k, "<f4")), ("slow", np.float64(k // 10)), ("fast", np.float64(k % 10))):
        with open(f"{folder}/{name}.bin", "ab") as f:
            f.write(np.asarray(a).tobytes())
"""


def append(folder, lo, hi):
    return subprocess.Popen([sys.executable, "-c", WRITER, str(folder), str(lo), str(hi), str(N)])


def scan_in(folder):
    return GrowingScan(f"{folder}/data.bin", f"{folder}/slow.bin", f"{folder}/fast.bin", N, end=f"{folder}/end")


def test_pulls_from_files_that_another_process_appends_to(spark, tmp_path):
    scan = scan_in(tmp_path)
    assert scan.count() == 0
    append(tmp_path, 0, 30).wait(60)
    feed = scan.feed(spark, total=50)
    first, second = feed.next(10), feed.next(30)
    assert [r["frame_idx"] for r in first.collect()] == list(range(10)) and second.count() == 20
    assert feed.next(30) == WAIT
    append(tmp_path, 30, 50).wait(60)
    last = feed.next(30).collect()
    assert [(r["frame_idx"], r["r0"], r["c0"]) for r in last] == [(k, k // 10, k % 10) for k in range(30, 50)]
    assert all((np.frombuffer(r["intensity"], "<f4") == r["frame_idx"]).all() for r in last)
    assert feed.next(30) == EOS


def test_a_frame_is_there_once_all_files_have_it_whole(tmp_path):
    scan = scan_in(tmp_path)
    append(tmp_path, 0, 3).wait(60)
    with open(tmp_path / "data.bin", "ab") as f:
        f.write(b"\0" * (4 * N * N + 10))  # one frame more and a part of the next
    assert scan.count() == 3
    for name in ("slow", "fast"):
        with open(tmp_path / f"{name}.bin", "ab") as f:
            f.write(np.float64(1).tobytes())
    assert scan.count() == 4


def test_stream_of_growing_files(spark, tmp_path):
    spark.dataSource.register(GrowingSource)
    writer = append(tmp_path, 0, 50)
    options = {"data": f"{tmp_path}/data.bin", "slow": f"{tmp_path}/slow.bin", "fast": f"{tmp_path}/fast.bin", "n": N, "per_batch": 20, "min_frames": 15, "end": f"{tmp_path}/end", "progress": f"{tmp_path}/progress"}
    sizes = []

    def start():
        return (
            spark.readStream.format("growing").options(**options).load().writeStream.foreachBatch(lambda df, _: sizes.append(sorted(r["frame_idx"] for r in df.collect())))
            .option("checkpointLocation", str(tmp_path / "cp")).start()
        )

    def until(frames):
        for _ in range(600):
            if sum(map(len, sizes)) >= frames:
                return
            time.sleep(0.1)

    q = start()
    try:
        writer.wait(60)
        until(35)  # 20 and 15 or more; fewer than 15 are left and wait
    finally:
        q.stop()
    q = start()  # goes on from its checkpoint
    try:
        append(tmp_path, 50, 53).wait(60)
        (tmp_path / "end").touch()
        until(53)
    finally:
        q.stop()
    seen = [k for own in sizes for k in own]
    assert seen == list(range(53))
    assert all(len(own) <= 20 for own in sizes) and len(sizes[0]) >= 15


#: The layouts of positions and data: two grids, two lists, or the axes of a grid.
SLOW, FAST = 2.0 * np.arange(4), 0.5 * np.arange(5)
GRID = np.meshgrid(SLOW, FAST, indexing="ij")
CASES = {
    "grids, grid": (GRID[0], GRID[1], (4, 5)),
    "lists, list": (GRID[0].ravel(), GRID[1].ravel(), (20,)),
    "grids, list": (GRID[0], GRID[1], (20,)),
    "axes, grid": (SLOW, FAST, (4, 5)),
    "axes, list": (SLOW, FAST, (20,)),
}


@pytest.mark.parametrize("case", CASES)
def test_slabs_give_what_single_reads_give(spark, tmp_path, monkeypatch, case):
    slow, fast, shape = CASES[case]
    monkeypatch.setattr(slabs, "SLAB_BYTES", 4 * 36 * 7)  # slabs of a row of five, or of seven
    r = np.random.default_rng(5)
    data, keep = r.integers(0, 1000, (20, 6, 6)).astype(np.int32), np.arange(20).reshape(shape) % 3 != 0
    for name, a in (("d", data.reshape(*shape, 6, 6)), ("slow", slow), ("fast", fast), ("keep", keep)):
        np.save(tmp_path / f"{name}.npy", a)
    at = {k: str(tmp_path / f"{k}.npy") for k in ("d", "slow", "fast", "keep")}
    how = files.Corrections(dark=np.full((6, 6), 10.0), norm=np.arange(1.0, 21), crop=(1, 5, 2, 6))
    for ours, theirs in (({}, {}), ({"skip": 4}, {"skip": 4}), ({"box": ((2.0, 4.0), (0.4, 1.1))},) * 2, ({"keep": at["keep"], "skip": 2}, {"keep": keep, "skip": 2})):
        got = slabs.read_slabs(spark, at["d"], at["slow"], at["fast"], 0.5, how, **ours)
        want = files.read_npy(spark, at["d"], slow, fast, 0.5, how, **theirs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_slabs_are_whole_rows_and_positions_stay_off_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slabs, "SLAB_BYTES", 1 << 16)
    np.save(tmp_path / "d.npy", np.zeros((300, 40, 4, 4), np.float32))
    np.save(tmp_path / "s.npy", np.arange(300.0))
    np.save(tmp_path / "f.npy", np.arange(40.0))
    shape, dtype = slabs.header(str(tmp_path / "d.npy"))
    assert slabs.slab_frames(shape, dtype) % 40 == 0
    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: made(rows, *a, **k) if len(rows) < 100 else pytest.fail("a list of positions on the driver"))
    assert slabs.read_slabs(spark, *[str(tmp_path / f"{n}.npy") for n in "dsf"]).count() == 12_000
    with pytest.raises(ValueError, match="don't fit"):
        slabs.positions(spark, *[str(tmp_path / f"{n}.npy") for n in "dff"])
