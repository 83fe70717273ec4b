"""Maps from scans, the data source, and the command line."""

import json

import numpy as np

from wavesift.operators import bragg, stxm
from wavesift.operators.engines import State
from wavesift.plans import cli
from wavesift.sources.datasource import MoonflowerSource
from wavesift.sources.frames import moonflower


def test_stxm_equals_dense_sums(spark):
    frames, probe, obj = moonflower(spark, 16, 16, 0.3)
    trans, row, _ = stxm.stxm_analysis(frames, probe, obj.shape)
    num, den, top = np.zeros(obj.shape), np.zeros(obj.shape), 0.0
    for r in frames.collect():
        total, at = np.frombuffer(r["intensity"], "<f4").astype(float).sum(), (slice(r["r0"], r["r0"] + 16), slice(r["c0"], r["c0"] + 16))
        num[at] += np.sqrt(total) * np.abs(probe)
        den[at] += np.abs(probe)
        top = max(top, total)
    assert np.allclose(trans, num / (den + 1e-10) / np.sqrt(top))
    assert np.isfinite(row).all()
    assert stxm.stxm_object(frames, 5.0, obj.shape).shape == (1, *obj.shape)
    assert stxm.mean_amplitude_probe(frames, 16).shape == (1, 16, 16)


def test_data_source_in_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(MoonflowerSource)
    batch = spark.read.format("moonflower").option("frames", 20).option("shape", 8).option("per_task", 6).load()
    assert batch.count() == 20 and batch.rdd.getNumPartitions() == 4
    stream = spark.readStream.format("moonflower").option("frames", 20).option("shape", 8).option("per_batch", 7).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in got.select("frame_idx").collect()) == list(range(20))
    assert got.join(batch, ["frame_idx", "intensity"]).count() == 20


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["template"]) == 0
    pars = json.loads(capsys.readouterr().out)
    assert pars["engines"]["engine00"]["name"] == "DM"
    pars["scan"] |= {"num_frames": 9, "shape": 16}
    (tmp_path / "p.json").write_text(json.dumps(pars))
    assert cli.main(["run", str(tmp_path / "p.json"), str(tmp_path / "out"), "--set", "engines.engine00.numiter=1"]) == 0
    assert cli.main(["inspect", str(tmp_path / "out")]) == 0
    assert "container" in capsys.readouterr().out


def test_bragg_volume(spark):
    from wavesift.functions import generate
    from wavesift.operators import bragg
    from wavesift.operators.engines import State

    obj = np.zeros((4, 20, 20), complex)
    obj[1:3] = generate.flower((20, 20))
    probe = np.repeat(generate.moon(10, 1e5)[None], 4, axis=0)
    frames = bragg.bragg_scan(spark, probe, obj, [(r, c) for r in range(0, 11, 3) for c in range(0, 11, 3)]).persist()
    e = bragg.BraggDM(frames, State(probe, np.full(obj.shape, 0.5 + 0j)), probe_update_start=99, support=bragg.BraggSupport(coefficient=0.0))
    e.run(4)
    assert e.log[-1]["err_fourier"] < e.log[0]["err_fourier"]
    same = bragg.BraggDM(frames, State(probe, obj.copy()), probe_update_start=99)
    same.run(1)
    assert same.log[0]["err_fourier"] < 1e-3 * e.log[0]["err_fourier"]


def test_autosave_and_description(spark, tmp_path):
    from wavesift.operators.engines import AP, State
    from wavesift.sources import files
    from wavesift.streaming.progress import Progress, autosave

    frames, probe, obj = moonflower(spark, 9, 16, 0.3)
    AP(frames, State(probe[None].astype(complex), np.ones((1, *obj.shape), complex)), numiter=2, after=autosave(str(tmp_path / "a"), 2)).run()
    parts = {r["part"] for r in files.describe(spark, str(tmp_path / "a")).collect()}
    assert parts == {"content", "iter_info", "params"}
    assert files.run_paths("/x/", "r", "DM", 7)["result"] == "/x/r/result_DM_0007"
    assert Progress().table(spark).count() == 0


def test_probe_update_of_volumes_is_plane_by_plane(spark):
    rng = np.random.default_rng(3)
    obj = 1 + 0.1 * rng.normal(size=(4, 16, 16)) + 0j
    probe = rng.normal(size=(4, 8, 8)) + 1j * rng.normal(size=(4, 8, 8))
    frames = bragg.bragg_scan(spark, probe, obj, [(0, 0), (3, 4), (8, 8)])
    e = bragg.BraggDM(frames, State(probe.copy(), obj.copy()))
    e.prepare()
    e.probe_update()
    assert np.allclose(e.state.probe, probe)  # waves of probe and object themselves
