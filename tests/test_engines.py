"""Engines on a small synthetic scan: errors fall, and the object is found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.operators import bragg, engines, lowrank, posref
from wavesift.operators.engines import ENGINES, State
from wavesift.plans.reconstruct import Reconstruction
from wavesift.sources.frames import auto_center, moonflower, pixels


@pytest.fixture(scope="module")
def data(spark):
    frames, probe, obj = moonflower(spark, 25, 16, 0.25)
    return frames.persist(), probe, obj


@pytest.mark.parametrize("name", sorted(set(ENGINES) - {"DM_3dBragg"}))
def test_error_falls(data, name):
    frames, probe, obj = data
    state = State(probe[None].astype(complex), np.ones((1, *obj.shape), complex))
    e = engines.by_name(name)(frames, state, numiter=3, probe_update_start=5, **({"clip_object": (0.0, 1.3)} if name == "WASP" else {}))
    e.run()
    key = "err_photon" if name in ("ML", "MLOPR") else "err_fourier"
    assert e.log[-1][key] < 0.7 * e.log[0][key]
    assert e.iter_info().count() == 3


def test_true_state_is_a_fixed_point(data):
    frames, probe, obj = data
    e = engines.DM(frames, State(probe[None].astype(complex), obj[None].copy()), numiter=1)
    e.run()
    assert e.log[0]["err_fourier"] < 0.5
    lit = np.abs(obj) > 0
    assert np.abs(e.state.obj[0][lit][200:300] - obj[lit][200:300]).mean() < 0.1


def test_object_update_equals_dense_sums(data):
    frames, probe, obj = data
    e = engines.AP(frames, State(probe[None].astype(complex), obj[None].copy()))
    e.prepare()
    e.object_update()
    num, den = np.zeros(obj.shape, complex), np.zeros(obj.shape)
    for r in e.waves.collect():
        at = (slice(r["r0"], r["r0"] + r["n"]), slice(r["c0"], r["c0"] + r["n"]))
        num[at] += np.conj(probe) * np.frombuffer(r["exit"], "<c16").reshape(probe.shape)
        den[at] += np.abs(probe) ** 2
    c = e.object_inertia * e.mean_power
    assert np.allclose(e.state.obj[0], (c * obj + num) / (c + den))


def test_grid_search_finds_the_shift(data):
    frames, probe, obj = data
    off = frames.filter((F.col("r0") > 1) & (F.col("c0") > 1)).withColumn("r0", F.col("r0") - 1)
    state = State(probe[None].astype(complex), obj[None])
    moved = posref.refine(off, state, posref.PositionRefinement(method="GridSearch", max_shift=2))
    rows = moved.collect()
    assert all(r["new_r0"] == r["r0"] + 1 and r["new_c0"] == r["c0"] for r in rows)
    assert posref.move(off, moved).count() == len(rows)
    assert all(r["error"] <= r["old_error"] for r in posref.refine(off, state, posref.PositionRefinement()).collect())


def test_leading_modes_are_those_of_the_svd(spark):
    rng = np.random.default_rng(0)
    a = (rng.standard_normal((40, 3)) * [9, 4, 2]) @ (rng.standard_normal((3, 12)) + 1j * rng.standard_normal((3, 12))) + 0.01 * rng.standard_normal((40, 12))
    df = spark.createDataFrame([(bytearray(x.astype("<c16").tobytes()),) for x in a], "v binary")
    modes = lowrank.leading_modes(df, "v", 12, 3)
    low = lowrank.project(a, modes)[1]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(low, (u[:, :3] * s[:3]) @ vt[:3], atol=1e-3)


def test_bragg_support_thins():
    obj = np.zeros((10, 4, 4))
    obj[4:6] = 1
    obj[0] = 0.05
    out = bragg.BraggSupport(cutoff=0.1, coefficient=0.0).apply(obj)
    assert out[0].max() == 0 and out[4].min() == 1


def test_pixels_and_centre(spark, data):
    frames = data[0]
    assert pixels(frames).count() == 25 * 256
    r, c = auto_center(frames)
    assert abs(r - 8) < 1.5 and abs(c - 8) < 1.5


def test_run_from_parameters(spark, tmp_path):
    r = Reconstruction(spark, {"scan": {"num_frames": 9, "shape": 16}, "engines": {"a": {"name": "DM", "numiter": 1}, "b": {"name": "ML", "numiter": 1}}})
    r.copy_state("x")
    with pytest.raises(KeyError):
        r.restore_state("y")
    r.restore_state("x")
    r.save(str(tmp_path / "out"))
    from wavesift.sources import files

    state, pars = files.read_result(spark, str(tmp_path / "out"))
    assert np.allclose(state.obj, r.state.obj) and pars["engines"]["b"]["name"] == "ML"
    with pytest.raises(ValueError):
        Reconstruction(spark, {"engines": {"a": {"numiter": 0}}}, level=1)
    with pytest.raises(KeyError):
        engines.by_name("nothing")


def test_scatter_add_on_the_small_grid(spark):
    """Four positions, two probe and two object modes: the sums are known whole numbers."""
    from wavesift.operators.scatter import scatter_add

    n, sums, rows = 5, engines.TileSums(), []
    for p, (y, x) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]):
        for pm in range(2):
            probe, wave = np.full((n, n), (pm + 1) * (1 + 1j)), np.full((n, n), (4 * p + 2 * pm + 1) * (1 + 1j))  # object mode 0
            num, den = np.conj(probe) * wave, np.abs(probe) ** 2
            sums.add_patch(y, x, num, den)
            rows += [(y + r, x + c, float(num[r, c].real), float(den[r, c])) for r in range(n) for c in range(n)]
    num, den = engines.object_sums({k: (a.ravel(), b.ravel()) for k, (a, b) in sums.parts.items()}, (7, 7))
    assert (num[0].real + 1).tolist() == [15, 53, 53, 53, 53, 39, 1]
    assert np.allclose(den[0] + 2, [12, 22, 22, 22, 22, 12, 2])
    long = scatter_add(spark.createDataFrame(rows, "r int, c int, num double, den double"), ["r", "c"], num=F.col("num"), den=F.col("den"))
    for row in long.collect():
        assert row["num"] == pytest.approx(num[row["r"], row["c"]].real) and row["den"] == pytest.approx(den[row["r"], row["c"]])


@pytest.mark.parametrize("ml_type", ["gaussian", "poisson", "euclid"])
def test_ml_preconditioned_by_the_wavefield_gets_better(spark, ml_type):
    r = Reconstruction(spark, {"scan": {"num_frames": 9, "shape": 16}, "engines": {"a": {"name": "ML", "numiter": 4, "ml_type": ml_type, "wavefield_precond": True, "poly_line_coeffs": "all", "smooth_gradient": 1.0, "smooth_gradient_decay": 0.5}}})
    errors = [x["err_photon"] for x in r.engines[0].iter_info().orderBy("iteration").collect()]
    assert errors[-1] < errors[0]
