"""Objects in tiles and several modes give what dense arrays give; domains have as many frames each."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.operators import engines, tiled
from wavesift.operators.engines import AP, DM, ML, RAAR, State, ThreePIE, frame_arrays
from wavesift.operators.partition import by_load
from wavesift.sources.frames import moonflower

TILE = 24


@pytest.fixture(scope="module")
def data(spark):
    frames, probe, obj = moonflower(spark, 20, 16, 0.3)
    probes = np.stack([probe, 0.3j * probe * np.arange(16)[None] / 16]).astype(complex)
    objects = np.stack([np.ones(obj.shape), 0.2 + 0.1j * (np.indices(obj.shape)[0] % 3)]).astype(complex)
    return frames.persist(), probes, objects


def dense(tiles, shape):
    rows = tiled.pixels(tiles, shape, TILE).toPandas()
    out = np.zeros((rows["mode"].max() + 1, *shape), complex)
    out[rows["mode"], rows["y"], rows["x"]] = rows["re"] + 1j * rows["im"]
    return out


def in_tiles(cls, data, **how):
    frames, probes, objects = data
    return cls(frames, State(probes.copy(), np.zeros((len(objects), 0, 0), complex)), tiles=tiled.cut(frames.sparkSession, objects, TILE), tile=TILE, **how)


@pytest.mark.parametrize("cls,plain", [(tiled.TiledDM, DM), (tiled.TiledRAAR, RAAR), (tiled.TiledAP, AP), (tiled.TiledML, ML)])
@pytest.mark.parametrize("most", [4096, 2])
def test_tiles_give_what_arrays_give(data, monkeypatch, cls, plain, most):
    frames, probes, objects = data
    monkeypatch.setattr(tiled.deal, "__defaults__", (most,))  # crowded homes in several tasks
    seen = []
    monkeypatch.setattr(tiled, "collect_sums", lambda parts: seen.append(engines.collect_sums(parts)) or seen[-1])
    e = in_tiles(cls, data, numiter=2)
    e.run()
    a = plain(frames, State(probes.copy(), objects.copy()), numiter=2)
    a.run()
    assert np.allclose(dense(e.tiles, objects.shape[1:]), a.state.obj, atol=1e-8) and np.allclose(e.state.probe, a.state.probe, atol=1e-8)
    for x, y in zip(e.log, a.log, strict=True):
        assert all(np.isclose(x[k], y[k]) for k in y if k.startswith("err"))
    assert not any(what == "object" for sums in seen for what, *_ in sums)  # no tile comes to the driver


def test_a_home_of_many_frames_has_several_cells(data):
    dealt, cells = tiled.deal(data[0], TILE, 2)
    sizes = {tuple(r)[:3]: r["count"] for r in dealt.groupBy(*tiled.CELL).count().collect()}
    assert set(sizes) <= {tuple(r) for r in cells.collect()} and len(cells.collect()) >= data[0].count() / 2


def test_what_tiles_cannot_do_is_said(data):
    with pytest.raises(ValueError, match="tiles of 16 or more"):
        e = in_tiles(tiled.TiledDM, data)
        e.tile = 8
        e.run()
    with pytest.raises(ValueError, match="reg_del2"):
        in_tiles(tiled.TiledML, data, reg_del2=True).run()


def test_filled_tiles_are_made_where_they_are_kept(spark):
    tiles = tiled.filled(spark, (50, 30), [1.0, 2j], TILE)
    assert tiles.count() == 3 * 2
    assert np.array_equal(dense(tiles, (50, 30)), np.stack([np.ones((50, 30)), np.full((50, 30), 2j)]))


def test_modes_are_pairs():
    r = np.random.default_rng(1)
    probe, patch = (r.normal(size=(n, 8, 8)) + 1j * r.normal(size=(n, 8, 8)) for n in (3, 2))
    waves = K.pairs(probe, patch)
    assert np.allclose(waves, [p * o for p in probe for o in patch])
    assert np.allclose(K.object_sum(probe, waves, 2), (np.abs(probe) ** 2).sum(axis=0) * patch)
    assert np.allclose(K.probe_sum(patch, waves, 3), (np.abs(patch) ** 2).sum(axis=0) * probe)


def test_gradients_of_modes_are_the_slopes_of_the_cost():
    r = np.random.default_rng(2)
    probe, patch, dp, do = (r.normal(size=(2, 8, 8)) + 1j * r.normal(size=(2, 8, 8)) for _ in range(4))
    intensity, mask = r.uniform(1, 5, (8, 8)), np.ones((8, 8))
    for model in ("gaussian", "poisson", "euclid"):
        g_obj, g_probe, _ = K.gradients(model, probe, patch, intensity, mask)
        t = 1e-6
        up, down = (K.gradients(model, probe + s * dp, patch + s * do, intensity, mask)[2] for s in (t, -t))
        slope = (np.conj(g_obj) * do).real.sum() + (np.conj(g_probe) * dp).real.sum()
        slope *= 2 if model == "gaussian" else 1  # its gradient is given without the square's factor
        b = K.line_coefficients(model, probe, patch, dp, do, intensity, mask)
        assert np.isclose((up - down) / (2 * t), slope, rtol=1e-4) and np.isclose(b[1], slope, rtol=1e-6)


def test_sequential_engines_say_that_they_take_one_object_mode(data):
    with pytest.raises(ValueError, match="one object mode"):
        engines.EPIE(data[0], State(data[1], data[2])).run()


@pytest.mark.parametrize("domains", [1, 2, 7, 12])
def test_domains_are_fair_however_rows_cluster(spark, domains):
    rows = [(i, 5, 5) for i in range(2000)] + [(2000 + i, i % 100, i // 100) for i in range(1000)]  # one pixel has two thirds
    own = by_load(spark.createDataFrame(rows, "frame_idx long, r0 int, c0 int"), "r0", "c0", "frame_idx", domains)
    sizes = [r["count"] for r in own.groupBy("domain").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) == domains and max(sizes) <= 1.2 * len(rows) / domains
    assert own.columns == ["frame_idx", "r0", "c0", "domain"]


def test_domains_are_cut_at_the_very_row_that_parts_them(spark):
    """Against ranks in plain Python: many rows, level ones, and places that are null."""
    rows = [(i, i * i % 977 // 100 if i % 7 else 3, i * 31 % 8 if i % 50 else None) for i in range(25_000)]

    def parts(own, base, m):
        if m == 1 or not own:
            return dict.fromkeys((k for k, _, _ in own), base)
        sides = [[r[c] for r in own if r[c] is not None] for c in (1, 2)]
        wide = [max(s) - min(s) if s else None for s in sides]
        c = 1 if None not in wide and wide[0] >= wide[1] else 2
        own = sorted(own, key=lambda r: (r[c] is None, r[c] or 0, r[0]))
        first = math.ceil((m // 2) * len(own) / m)
        return parts(own[:first], base, m // 2) | parts(own[first:], base + m // 2, m - m // 2)

    at = lambda k, x: None if x is None else x + k * 7919 % 10007 / 10007
    expected = parts([(k, at(k, x), at(k, y)) for k, x, y in rows], 0, 12)
    got = by_load(spark.createDataFrame(rows, "frame_idx long, r0 int, c0 int"), "r0", "c0", "frame_idx", 12).select("frame_idx", "domain").collect()
    assert {r["frame_idx"]: r["domain"] for r in got} == expected


def test_slices_of_domains_are_averaged_by_their_light(spark, data):
    frames, probes, objects = data
    shape, probe = objects.shape[1:], probes[:1]
    e = ThreePIE(frames, State(probe.copy(), objects[:1].copy()), numiter=1, domains=2, order="frame", probe_update_start=9)
    e.run()
    parts = by_load(frames, "r0", "c0", "frame_idx", 2).collect()
    num, den = np.zeros((2, *shape), complex), np.zeros((2, *shape))
    for domain in (0, 1):
        stack, light = np.stack([objects[0], np.ones(shape)]), np.zeros((2, *shape))
        for row in sorted((r for r in parts if r["domain"] == domain), key=lambda r: r["frame_idx"]):
            r, c, n, intensity, mask = frame_arrays(row)
            at = (slice(r, r + n), slice(c, c + n))
            _, out, _, lights = K.multislice(probe, [s[at] for s in stack], lambda w: w, intensity, mask, bw_between=lambda w: w)
            for k in range(2):
                stack[k][at], light[k][at] = out[k], light[k][at] + lights[k]
        num, den = num + stack * light, den + light
    expected = np.where(den > 0, num / np.maximum(den, 1e-300), np.stack([objects[0], np.ones(shape)]))
    assert np.allclose(np.concatenate(e.slices), expected) and np.allclose(e.state.obj[0], expected.prod(axis=0))


def test_a_domain_holds_one_batch_of_frames(spark, data, monkeypatch):
    """Frames are streamed: with batches of one frame a sweep over all of them gives the same."""
    frames, probes, objects = data
    out = []
    for records in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            e = engines.EPIE(frames, State(probes[:1].copy(), objects[:1].copy()), numiter=1, domains=3, synchronise=2)
            e.run()
            out.append(e.state.obj)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(*out)
    assert frames.filter(F.col("frame_idx") >= 0).count() == 20


@pytest.mark.parametrize("name, domains", [("EPIEParallel", 4), ("SDR", 3), ("WASP", 6)])
def test_sequential_engines_sweep_the_frames_of_exact_domains(spark, data, name, domains):
    """The first cut of many frames is at its very rank."""
    frames = spark.range(25_000).selectExpr("id AS frame_idx", "cast(id * id % 977 AS int) AS r0", "cast(id * 31 % 8 AS int) AS c0", "16 AS n", "cast('' AS binary) AS intensity", "cast('' AS binary) AS mask")
    e = engines.by_name(name)(frames, State(data[1][:1], data[2][:1]), domains=domains)
    e.prepare()
    rows = sorted((r["r0"] + r["frame_idx"] * 7919 % 10007 / 10007, r["frame_idx"], r["domain"]) for r in e.dealt.collect())
    first = math.ceil(domains // 2 * len(rows) / domains)
    assert [r[2] < domains // 2 for r in rows] == [True] * first + [False] * (len(rows) - first)
