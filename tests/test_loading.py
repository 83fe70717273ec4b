"""Stacks of images with positions: layouts, subsets, corrections, and runs over files."""

import numpy as np
import pytest

from wavesift.plans.reconstruct import Reconstruction
from wavesift.sources import files
from wavesift.sources.frames import moonflower

RNG = np.random.default_rng(2)


def loaded(df):
    rows = df.orderBy("frame_idx").collect()
    images = np.stack([np.frombuffer(r["intensity"], "<f4").reshape(r["n"], r["n"]) for r in rows])
    return [(r["r0"], r["c0"]) for r in rows], images, np.stack([np.frombuffer(r["mask"], np.uint8).reshape(r["n"], r["n"]) for r in rows])


#: Positions as two grids, as lists, and as axes of a grid; data as a grid and as a list.
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
def test_layouts(spark, tmp_path, case):
    slow, fast, shape = CASES[case]
    data = RNG.integers(0, 1000, (20, 6, 6)).astype(np.int32)
    np.save(tmp_path / "d.npy", data.reshape(*shape, 6, 6))
    path = str(tmp_path / "d.npy")
    places, images, masks = loaded(files.read_npy(spark, path, slow, fast, 0.5, partitions=3))
    assert np.array_equal(images, data) and masks.all()
    assert places == [(4 * i, j) for i in range(4) for j in range(5)]
    keep = np.arange(20).reshape(shape) % 3 != 0
    for subset, used in (
        ({"skip": 4}, [*range(0, 20, 4)]),
        ({"box": ((2.0, 4.0), (0.4, 1.1))}, [6, 7, 11, 12]),
        ({"keep": keep}, [i for i in range(20) if i % 3]),
        ({"order": [5, 2, 9]}, [5, 2, 9]),
        ({"keep": keep, "skip": 2}, [i for i in range(20) if i % 3][::2]),
    ):
        places, images, _ = loaded(files.read_npy(spark, path, slow, fast, 0.5, **subset))
        low = min(u // 5 for u in used), min(u % 5 for u in used)
        assert np.array_equal(images, data[used]) and places == [(4 * (u // 5 - low[0]), u % 5 - low[1]) for u in used]
    with pytest.raises(ValueError, match="don't fit"):
        files.read_npy(spark, path, np.arange(3), np.arange(5))


def test_corrections(spark, tmp_path):
    data = RNG.integers(0, 1000, (6, 8, 10)).astype(np.int32)
    np.save(tmp_path / "d.npy", data)
    dark, flat, mask = RNG.uniform(0, 50, (8, 10)), RNG.uniform(0.5, 2, (8, 10)), RNG.integers(0, 2, (8, 10))
    flat[2, 3] = 0
    norm = RNG.uniform(1, 3, 6)
    how = files.Corrections(dark, flat, mask, norm, (0, 8, 1, 9))
    _, images, masks = loaded(files.read_npy(spark, str(tmp_path / "d.npy"), np.arange(6), np.arange(6), 1.0, how))
    want = np.where(flat > 0, np.maximum(data - dark, 0) / np.where(flat > 0, flat, 1), 0) / norm[:, None, None]
    assert np.allclose(images, want[:, :, 1:9], rtol=1e-5)
    assert np.array_equal(masks, np.repeat(((mask > 0) & (flat > 0))[None, :, 1:9], 6, axis=0))
    with pytest.raises(Exception, match="not square"):
        files.read_npy(spark, str(tmp_path / "d.npy"), np.arange(6), np.arange(6)).collect()


def test_runs_over_files(spark, tmp_path):
    frames, probe, obj = moonflower(spark, 16, 16, 0.25)
    files.write_frames(frames, str(tmp_path / "frames"))
    rows = frames.orderBy("frame_idx").collect()
    np.save(tmp_path / "d.npy", np.stack([np.frombuffer(r["intensity"], "<f4").reshape(16, 16) for r in rows]))
    for axis, k in (("slow", "r0"), ("fast", "c0")):
        np.save(tmp_path / f"{axis}.npy", np.array([1e-6 * r[k] for r in rows]))
    for scan in ({"source": "parquet", "path": str(tmp_path / "frames")}, {"source": "npy", "path": str(tmp_path / "d.npy"), "slow": str(tmp_path / "slow.npy"), "fast": str(tmp_path / "fast.npy"), "resolution": 1e-6}):
        r = Reconstruction(spark, {"scan": scan, "engines": {"a": {"name": "DM", "numiter": 4}}})
        log = r.iter_info().orderBy("iteration").collect()
        assert len(log) == 4 and log[-1]["err_photon"] < 0.5 * log[0]["err_photon"]  # the first probe is a guess
        assert r.state.obj.shape == (1, max(x["r0"] for x in rows) + 16, max(x["c0"] for x in rows) + 16)
        r.close()
    with pytest.raises(ValueError, match="no parameters alfa"):
        Reconstruction(spark, {"scan": {"num_frames": 4, "shape": 16}, "engines": {"a": {"name": "DM", "alfa": 2.0}}})


def test_hdf5(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    data = RNG.integers(0, 1000, (4, 5, 6, 6)).astype(np.int32)
    with h5py.File(tmp_path / "d.h5", "w") as f:
        f["i"], f["y"], f["x"], f["dark"] = data, SLOW, FAST, np.ones((3, 6, 6))
    places, images, _ = loaded(files.read_hdf5(spark, str(tmp_path / "d.h5"), "i", "y", "x", 0.5, dark="dark", skip=2))
    assert np.array_equal(images, np.maximum(data.reshape(20, 6, 6)[::2] - 1, 0)) and places[1] == (0, 2)
