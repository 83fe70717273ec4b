"""Numeric functions against literal values and against one another."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavesift.functions import arrays, complexcol, generate, kernels, propagate, special, text, units
from wavesift.operators import link, partition, scan, scatter, stencil


def test_dot_of_powers():
    y, x, _ = np.indices((3, 3, 1001))
    a = 10.0**y + 1j * 10.0**x
    assert int((a * a.conj()).real.sum()) == 60666606


def test_forward_difference(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 1.0, 2.0, 4.0, 8.0, 0.0, 6.0])), "k int, v double").withColumn("g", F.lit(0))
    got = [r[0] for r in df.select("k", stencil.delxf(F.col("v"), ["g"], ["k"]).alias("d")).orderBy("k").select("d").collect()]
    assert got == [1, 1, 2, 4, -8, 6, 0]


def test_raster_is_slow_in_first_coordinate(spark):
    rows = scan.raster_scan(spark, 1e-6, 2e-6, 5, 6).orderBy("idx").collect()
    assert len(rows) == 30
    assert np.allclose([r["y"] for r in rows], np.repeat(np.arange(6) * 2e-6, 5))
    assert np.allclose([r["x"] for r in rows], np.tile(np.arange(5) * 1e-6, 6))


def test_sum_to_buffer(spark):
    planes = spark.createDataFrame([(p % 2, r, c, float(p + 1)) for p in range(4) for r in range(4) for c in range(4)], "to int, r int, c int, v double")
    got = scatter.scatter_add(planes, ["to", "r", "c"], v=F.col("v")).groupBy("to").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert {(r["to"], r["lo"], r["hi"]) for r in got.collect()} == {(0, 4.0, 4.0), (1, 6.0, 6.0)}


@pytest.mark.parametrize("n,ranks,load", [(10, 3, None), (7, 7, None), (5, 8, None), (10, 3, [6, 0, 0]), (0, 2, None)])
def test_block_sizes_even_out(n, ranks, load):
    sizes = partition.block_sizes(n, ranks, load)
    assert sum(sizes) == n and min(sizes) >= 0
    if not load:
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes)


def test_half_pixels_round_to_even_after_the_nudge(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.4,), (-0.5,)], "v double")
    got = [r[0] for r in df.select(link.pixel_coordinate(F.col("v"), 1.0)[0]).collect()]
    assert got == [int(np.round(v + 1e-5)) for v in (0.5, 1.5, 2.4, -0.5)]


@given(st.integers(0, 7), st.integers(2, 5), st.integers(2, 5))
@settings(deadline=None, max_examples=30)
def test_orientation_moves_the_centre(o, h, w):
    a = np.arange(h * w).reshape(h, w)
    out, c = arrays.orient(a, o, (1, 0))
    assert out[tuple(c)] == a[1, 0]


def test_crop_pad_keeps_the_centre():
    a = np.arange(25.0).reshape(5, 5)
    out, c = arrays.crop_pad_symmetric(a, (8, 3))
    assert out.shape == (8, 3) and out[tuple(c)] == a[2, 2]
    assert np.array_equal(arrays.crop_pad(a, [[1, -2]], how="mirror")[:, 0], a[:, 0])


def test_rebin_and_masks():
    a = np.arange(16.0).reshape(4, 4)
    assert np.array_equal(arrays.rebin(a, 2), [[2.5, 4.5], [10.5, 12.5]])
    with pytest.raises(ValueError):
        arrays.rebin(a, 3)


@pytest.mark.parametrize("kind", ["farfield", "nearfield"])
def test_propagation_is_unitary(kind):
    g = propagate.Geometry(propagation=kind, psize=172e-6 if kind == "farfield" else 1e-7, distance=7.0 if kind == "farfield" else 1e-4).resolved()
    p = g.propagator()
    w = np.random.default_rng(0).standard_normal((64, 64)) + 0j
    assert np.allclose(p.bw(p.fw(w)), w)
    assert g.misfit == pytest.approx(0, abs=1e-9)


def test_bragg_coordinates_invert():
    b = propagate.BraggGeometry()
    x = np.random.default_rng(1).standard_normal((3, 4))
    for real in (True, False):
        assert np.allclose(b.natural(b.cartesian(x, real), real), x)
    v = np.random.default_rng(2).standard_normal((8, 16, 4))
    assert np.allclose(b.shear(b.shear(v), True), v)
    assert np.allclose(b.bw(b.fw(v)), v)


def test_units():
    assert units.kev_to_nm(units.nm_to_kev(0.2)) == pytest.approx(0.2)
    assert units.kev_to_m(1.0) == pytest.approx(1.24e-9, rel=1e-3)
    assert units.electron_wavelength(300) == pytest.approx(1.97e-12, rel=1e-2)


def test_complex_columns(spark):
    a, b = 1.5 - 2j, -0.5 + 3j
    df = spark.createDataFrame([(a.real, a.imag, b.real, b.imag)], "ar double, ai double, br double, bi double")
    x, y = complexcol.cplx("ar", "ai"), complexcol.cplx("br", "bi")
    for f, want in ((complexcol.mul, a * b), (complexcol.div, a / b), (complexcol.add, a + b), (complexcol.sub, a - b)):
        z = df.select(f(x, y).alias("z")).first()["z"]
        assert complex(z["re"], z["im"]) == pytest.approx(want)
    h = df.select(complexcol.rgb(complexcol.hsv(x, 0, 5)).alias("c")).first()["c"]
    assert all(0 <= v <= 255 for v in h)


def test_special_functions():
    a = np.random.default_rng(3).standard_normal((15, 11))
    assert np.allclose(special.gaussian_filter(np.ones((9, 9)), 1.5), 1)
    assert np.allclose(special.shift_subpixel(special.shift_subpixel(a, (0.3, 0.7)), (-0.3, -0.7)), a)
    assert np.allclose(special.shift_subpixel(a, (1, 0), linear=True)[1:], a[:-1])
    assert np.allclose(special.shift_zoom(a, (1, 1), (3, 3), (3, 3)), a)
    power, modes = special.ortho(a.reshape(3, 5, 11))
    assert power.sum() == pytest.approx(1) and list(power) == sorted(power, reverse=True)
    assert abs(np.vdot(modes[0], modes[1])) < 1e-9
    phase = special.gaussian_filter(a, 2)
    assert np.corrcoef(special.phase_from_dpc(*np.gradient(phase)).ravel(), phase.ravel())[0, 1] > 0.95


def test_generators():
    assert (np.abs(generate.moon(32, 1e6)) ** 2).sum() == pytest.approx(1e6)
    counts, mask = generate.Detector(full_well=50, shot_noise=False).filter(np.full((4, 4), 80.0))
    assert counts.max() == 50 and not mask.any()
    assert np.abs(generate.smooth_noise((16, 16), 0.3)).mean() == pytest.approx(1)
    assert generate.tree((32, 32)).shape == generate.star((32, 32)).shape == (32, 32)


@pytest.mark.parametrize("model", ["gaussian", "poisson", "euclid"])
def test_gradients_agree_with_differences(model):
    rng = np.random.default_rng(4)
    z = lambda *s: rng.standard_normal(s) + 1j * rng.standard_normal(s)
    probe, patch, intensity, mask = z(1, 6, 6) * 2, z(1, 6, 6), rng.uniform(1, 20, (6, 6)), (rng.uniform(size=(6, 6)) > 0.2).astype(float)
    g_obj, g_probe, cost = kernels.gradients(model, probe, patch, intensity, mask)
    ho, hp, t = z(1, 6, 6), z(1, 6, 6), 1e-6
    diff = (kernels.gradients(model, probe + t * hp, patch + t * ho, intensity, mask)[2] - kernels.gradients(model, probe - t * hp, patch - t * ho, intensity, mask)[2]) / (2 * t)
    inner = (np.conj(g_obj) * ho[0]).sum().real + (np.conj(g_probe) * hp).sum().real
    factor = 2.0 if model == "gaussian" else 1.0
    assert diff == pytest.approx(factor * inner, rel=1e-4)
    b = kernels.line_coefficients(model, probe, patch, hp, ho, intensity, mask)
    assert b[1] == pytest.approx(diff, rel=1e-3)


def test_exact_line_polynomial():
    rng = np.random.default_rng(5)
    z = lambda: rng.standard_normal((1, 5, 5)) + 1j * rng.standard_normal((1, 5, 5))
    p, o, hp, ho, i, m = z(), z(), z(), z(), rng.uniform(1, 5, (5, 5)), np.ones((5, 5))
    b = kernels.line_coefficients_all("gaussian", p, o, hp, ho, i, m)
    t = 0.37
    assert np.polyval(b[::-1], t) == pytest.approx(kernels.gradients("gaussian", p + t * hp, o + t * ho, i, m)[2])


@pytest.mark.parametrize("model", ["poisson", "euclid"])
def test_line_series_near_and_to_second_order(model):
    rng = np.random.default_rng(8)
    z = lambda: rng.standard_normal((2, 5, 5)) + 1j * rng.standard_normal((2, 5, 5))
    p, o, hp, ho, i, m = z(), z(), z(), z(), rng.uniform(1, 5, (5, 5)), (rng.uniform(size=(5, 5)) > 0.2).astype(float)
    b = kernels.line_coefficients_all(model, p, o, hp, ho, i, m)
    assert np.allclose(b[:2], kernels.line_coefficients(model, p, o, hp, ho, i, m)[:2])
    cost = lambda t: kernels.gradients(model, p + t * hp, o + t * ho, i, m)[2]
    t = 1e-3
    assert np.polyval(b[::-1], t) - b[0] == pytest.approx(cost(t) - cost(0), rel=1e-3)


@pytest.mark.parametrize("pbound", [None, 0.1, 1e9])
def test_projection_reaches_the_data(pbound):
    rng = np.random.default_rng(6)
    z = lambda *s: rng.standard_normal(s) + 1j * rng.standard_normal(s)
    probe, patch, intensity, mask = z(2, 8, 8), z(1, 8, 8), rng.uniform(1, 9, (8, 8)), np.ones((8, 8))
    psi, err, change = kernels.projection(probe * patch, probe, patch, intensity, mask, 0.0, 1.0, 1.0, pbound)
    after = np.sqrt((np.abs(kernels.fourier(psi)) ** 2).sum(axis=0))
    if pbound is None:
        assert np.allclose(after, np.sqrt(intensity)) and change > 0
    elif pbound > 1:
        assert change == pytest.approx(0)
    else:
        assert ((after - np.sqrt(intensity)) ** 2).mean() == pytest.approx(pbound, rel=1e-3) and err > pbound


def test_parsers():
    assert text.str_to_range("2:9:3") == [2, 5, 8]
    assert text.str_to_index("[1:3, :, 4]") == (slice(1, 3), slice(None), 4)
    spec = text.parse_spec("#S 7 ascan x 0 1\n#D today\n#L x  y\n0 1\n1 2\n")
    assert spec[7]["data"] == [[0.0, 1.0], [1.0, 2.0]] and spec[7]["labels"] == ["x", "y"]


@pytest.mark.parametrize("offset", [(0, 0, 0), (1, -2, 3), (-1, 2, -3), (5, 0, 0), (0, 0, -9), (0, -4, 0)])
def test_paste_cuts_what_is_outside(offset):
    a, b = np.zeros((3, 4, 5)), np.arange(1.0, 61).reshape(3, 4, 5)
    out = arrays.paste(a, b, offset)
    for i in np.ndindex(a.shape):
        j = tuple(x - o for x, o in zip(i, offset, strict=True))
        assert out[i] == (b[j] if all(0 <= x < n for x, n in zip(j, b.shape, strict=True)) else 0)
    assert not a.any()


def test_text_codes_and_back(spark):
    values = ["hallo", "", None, "Ä€😀x"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", text.text_codes(F.col("v"), 7).alias("c")).select("k", "c", text.codes_text(F.col("c")).alias("b")).orderBy("k").collect()
    assert [r["b"] for r in rows] == values
    assert list(rows[0]["c"]) == [104, 97, 108, 108, 111, 0, 0] and list(rows[1]["c"]) == [0] * 7
    assert list(rows[3]["c"]) == list("Ä€😀x".encode())


def test_hue_of_plain_colours(spark):
    rgb = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rgb)], "k int, r double, g double, b double").select("k", complexcol.rgb_to_hsv(F.struct("r", "g", "b")).alias("x")).orderBy("k")
    assert np.allclose([tuple(r["x"]) for r in df.collect()], [(0, 1, 1), (1 / 3, 1, 1), (2 / 3, 1, 1), (0, 0, 0.5), (0, 0, 0), (5 / 6, 1, 1)], atol=1e-5)


def test_probe_extent_by_angles():
    g = propagate.BraggGeometry(theta=30.0)
    e3, e1, e2 = np.array(g.shape) * g.resolution
    theta = np.deg2rad(g.theta)
    far = e1 + e3 * np.sin(theta), e3 * np.cos(theta)
    slant = np.pi / 2 - np.arctan2(*far) - theta
    assert g.probe_extent() == pytest.approx((np.hypot(*far) * np.cos(slant), e2))
