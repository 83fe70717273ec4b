"""Kernels and engines on frames made of the embeddings, each with the same sums in SQL.

An embedding gives an 8 by 8 frame: its values are the object patch, in reverse
order they give the intensities. The library computes with FFTs in Arrow batches,
the SQL with the 64 by 64 sums of a discrete Fourier transform.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wavesift.functions import kernels as K
from wavesift.functions.propagate import fourier
from wavesift.operators.engines import AP, DM, ML, RAAR, SUMS, State, TileSums, collect_sums, object_sums
from wavesift.plans.demo_tables import read, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

N, FIELD = 8, 16  # sides of frames and of the object
_R, _C = np.divmod(np.arange(N * N), N)
_G = np.exp(-((_R - 3.5) ** 2 + (_C - 3.5) ** 2) / 16)
PROBE = (_G * (1 + 0.1j * (_R - _C))).reshape(1, N, N)
PROBE_STEP = (0.3 * _G * (1 - 0.2j)).reshape(1, N, N)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def arrays(embedding) -> dict[str, np.ndarray]:
    """patch, patch_step, psi and change (complex), intensity and mask of one embedding."""
    v = np.asarray(embedding, float)
    square = lambda x: x.reshape(N, N)
    patch = square(1 + v / 2 + 1j * v / 4)[None]
    return {
        "patch": patch, "patch_step": square(np.roll(v, -9) * (0.2 + 0.1j))[None], "psi": 0.8 * PROBE * patch + 0.1 * square(v), "change": square(v * (0.1 + 0.05j))[None],
        "intensity": square((4 * v[::-1] ** 2 + 0.1).astype(np.float32).astype(float)), "mask": square((np.arange(N * N) % 5 != 0).astype(float)),
    }


def by_frame(spark: SparkSession, sf_dir: str, schema: str, rows_of: Callable[[dict[str, np.ndarray]], list[tuple]]) -> DataFrame:
    """Rows of every frame's arrays, with its vec_id."""
    names = ["vec_id", *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True) for row in rows_of(arrays(e))], columns=names)

    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, f"vec_id long, {schema}")


def pixel_rows(*images: np.ndarray) -> list[tuple]:
    return [(k, *x) for k, x in enumerate(zip(*(part for a in images for part in (a.ravel().real.tolist(), a.ravel().imag.tolist())), strict=True))]


# SQL: px has a row for each vec_id and pixel k, tw the turn of pixel k's part in frequency to_k.
_FRAMES = """
px AS (SELECT vec_id, k, (k // 8)::INT AS r, (k % 8)::INT AS c, embedding[k + 1]::DOUBLE AS v, embedding[64 - k]::DOUBLE AS vi, embedding[(k + 9) % 64 + 1]::DOUBLE AS vh
    FROM embeddings, (SELECT unnest(range(64))::INT AS k)),
fr AS (SELECT *, (4 * vi * vi + 0.1)::FLOAT::DOUBLE AS i, (k % 5 <> 0)::INT AS m, exp(-((r - 3.5) * (r - 3.5) + (c - 3.5) * (c - 3.5)) / 16) AS g FROM px),
w AS (SELECT *, g AS pr, g * 0.1 * (r - c) AS pi_, 1 + v / 2 AS o_r, v / 4 AS o_i, 0.3 * g AS hr, -0.06 * g AS hi, 0.2 * vh AS q_r, 0.1 * vh AS q_i FROM fr),
tw AS (SELECT a.k AS to_k, b.k AS k, cos(t) AS cs, sin(t) AS sn FROM (SELECT unnest(range(64))::INT AS k) a, (SELECT unnest(range(64))::INT AS k) b,
    LATERAL (SELECT -2 * pi() * ((a.k // 8 - 4) * (b.k // 8 - 4) + (a.k % 8 - 4) * (b.k % 8 - 4)) / 8 AS t))"""


def _times(a: str, b: str) -> tuple[str, str]:
    """Real and imaginary part of a product, from 'real,imaginary' names."""
    (ar, ai), (br, bi) = a.split(","), b.split(",")
    return f"({ar} * {br} - {ai} * {bi})", f"({ar} * {bi} + {ai} * {br})"


def _fw(source: str, keys: str = "vec_id") -> str:
    return f"(SELECT {keys}, to_k AS k, sum(re * cs - im * sn) / 8 AS re, sum(re * sn + im * cs) / 8 AS im FROM {source} JOIN tw USING (k) GROUP BY {keys}, to_k)"


def _bw(source: str) -> str:
    return f"(SELECT vec_id, to_k AS k, sum(re * cs + im * sn) / 8 AS re, sum(im * cs - re * sn) / 8 AS im FROM {source} JOIN tw USING (k) GROUP BY vec_id, to_k)"


_PO = "(SELECT vec_id, k, {} AS re, {} AS im FROM w)".format(*_times("pr,pi_", "o_r,o_i"))
_MODEL = f"{_FRAMES},\nf AS {_fw(_PO)},\nmo AS (SELECT vec_id, k, f.re AS fr, f.im AS fi, f.re * f.re + f.im * f.im AS a0, i, m FROM f JOIN w USING (vec_id, k))"


@query(f"WITH {_FRAMES} SELECT vec_id, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM {_fw(_PO)}")
def dft_small(spark, sf_dir):
    return rounded(by_frame(spark, sf_dir, "k int, re double, im double", lambda a: pixel_rows(fourier(PROBE * a["patch"]))), 6, "re", "im")


@query(f"WITH {_MODEL} SELECT vec_id, round(sum(m * (a0 - i) * (a0 - i) / (i + 1)) / 64, 6) AS err_photon FROM mo GROUP BY vec_id")
def log_likelihood(spark, sf_dir):
    return rounded(by_frame(spark, sf_dir, "err_photon double", lambda a: [(K.log_likelihood(PROBE, a["patch"], a["intensity"], a["mask"]),)]), 6, "err_photon")


_METRIC = "sum(m * (sqrt(a0) - sqrt(i)) * (sqrt(a0) - sqrt(i))) / sum(m)"


@query(f"WITH {_MODEL} SELECT vec_id, round({_METRIC}, 6) AS err_fourier FROM mo GROUP BY vec_id")
def fourier_error(spark, sf_dir):
    return rounded(by_frame(spark, sf_dir, "err_fourier double", lambda a: [(K.fourier_metric(PROBE, a["patch"], a["intensity"], a["mask"]),)]), 6, "err_fourier")


_FLOAT = "sum(m / (i + 1) * (a0 * s - i) * (a0 * s - i))"


@query(f"WITH {_MODEL}, sc AS (SELECT vec_id, sum(m / (i + 1) * a0 * i) / sum(m / (i + 1) * a0 * a0) AS s FROM mo GROUP BY vec_id) SELECT vec_id, round({_FLOAT}, 6) AS cost FROM mo JOIN sc USING (vec_id) GROUP BY vec_id")
def float_intensity(spark, sf_dir):
    """Cost of the model whose intensity is free in scale."""
    return rounded(by_frame(spark, sf_dir, "cost double", lambda a: [(K.gradients("gaussian", PROBE, a["patch"], a["intensity"], a["mask"], True)[2],)]), 6, "cost")


# ---- projections --------------------------------------------------------------

BOUND = 0.35


def _projection_sql(a: float, b: float, c: float, bound: float | None) -> str:
    x = "(SELECT vec_id, k, (1 - {c}) * (0.8 * pr_ + 0.1 * v) + {c} * pr_ AS re, (1 - {c}) * 0.8 * pi2 + {c} * pi2 AS im FROM p)".format(c=c)
    keep = "0.0" if bound is None else f"sqrt({bound} / err)"
    inside = "FALSE" if bound is None else f"err <= {bound}"
    return f"""WITH {_FRAMES},
p AS (SELECT vec_id, k, v, i, m, {_times("pr,pi_", "o_r,o_i")[0]} AS pr_, {_times("pr,pi_", "o_r,o_i")[1]} AS pi2 FROM w),
f AS {_fw(x)},
q AS (SELECT vec_id, k, re, im, sqrt(re * re + im * im) AS a, sqrt(i) AS t, m, sum(m * (sqrt(re * re + im * im) - sqrt(i)) * (sqrt(re * re + im * im) - sqrt(i))) OVER (PARTITION BY vec_id) / 51 AS err FROM f JOIN p USING (vec_id, k)),
s AS (SELECT vec_id, k, (1 - m + m * (t + (a - t) * {keep}) / (a + 1e-10)) AS z, re, im FROM q),
y AS {_bw("(SELECT vec_id, k, z * re AS re, z * im AS im FROM s)")},
h AS (SELECT vec_id, any_value(err) AS err FROM q GROUP BY vec_id),
d AS (SELECT vec_id, k, err, 0.8 * pr_ + 0.1 * v AS sr, 0.8 * pi2 AS si,
    CASE WHEN {inside} THEN {a + b * c} * (pr_ - (0.8 * pr_ + 0.1 * v)) ELSE {b} * y.re + {a} * pr_ - {a + b} * (0.8 * pr_ + 0.1 * v) END AS cr,
    CASE WHEN {inside} THEN {a + b * c} * (pi2 - 0.8 * pi2) ELSE {b} * y.im + {a} * pi2 - {a + b} * 0.8 * pi2 END AS ci FROM p JOIN y USING (vec_id, k) JOIN h USING (vec_id))
SELECT vec_id, k, round(sr + cr, 6) + 0.0 AS re, round(si + ci, 6) + 0.0 AS im, round(err, 6) AS err_fourier, round(sum(cr * cr + ci * ci) OVER (PARTITION BY vec_id) / 64, 6) AS err_exit FROM d"""


def _projection(name: str, coefficients: tuple[float, float, float], bound: float | None = None) -> None:
    def rows(a: dict[str, np.ndarray]) -> list[tuple]:
        psi, err, change = K.projection(a["psi"], PROBE, a["patch"], a["intensity"], a["mask"], *coefficients, bound)
        return [(*x, err, change) for x in pixel_rows(psi)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(by_frame(spark, sf_dir, "k int, re double, im double, err_fourier double, err_exit double", rows), 6, "re", "im", "err_fourier", "err_exit")

    QUERIES[name], ORACLE[name] = run, _projection_sql(*coefficients, bound)


_projection("projection_dm", (-1.0, 1.0, 2.0))
_projection("projection_raar", (-0.5, 0.75, 2.0))
_projection("projection_ap", (0.0, 1.0, 1.0))
_projection("projection_power_bound", (-1.0, 1.0, 2.0), BOUND)


@query(f"""WITH {_FRAMES}, t AS (SELECT max(pr * pr + pi_ * pi_) AS top FROM w)
SELECT vec_id, k, round(o_r + 1.5 * (pr * 0.1 * v + pi_ * 0.05 * v) / (0.5 * top + 0.5 * (pr * pr + pi_ * pi_)), 6) + 0.0 AS re, round(o_i + 1.5 * (pr * 0.05 * v - pi_ * 0.1 * v) / (0.5 * top + 0.5 * (pr * pr + pi_ * pi_)), 6) + 0.0 AS im FROM w, t""")
def step_update(spark, sf_dir):
    """The object update of the sequential engines."""
    return rounded(by_frame(spark, sf_dir, "k int, re double, im double", lambda a: pixel_rows(K.step_update(a["patch"], PROBE, a["change"], 0.5, 1.0))), 6, "re", "im")


# ---- maximum likelihood -------------------------------------------------------

_COST = {
    "gaussian": ("a0", "m / (i + 1) * (x - i) * (x - i)", "m / (i + 1) * (x - i)"),
    "poisson": ("a0 + 1e-6", "m * (x - i * ln(x) + lgamma(i + 1))", "m * (1 - i / x)"),
    "euclid": ("sqrt(a0) + 1e-10", "m * (x - sqrt(i)) * (x - sqrt(i))", "m * (1 - sqrt(i) / x)"),
}


def _gradient(model: str) -> None:
    value, cost, weight = _COST[model]
    conj_p, conj_o = _times("pr,(-pi_)", "y.re,y.im"), _times("o_r,(-o_i)", "y.re,y.im")
    names = ("cost", "obj_re", "obj_im", "obj_norm2", "probe_re", "probe_im", "probe_norm2")
    sums = ", ".join(f"round(sum({x}), 5) + 0.0 AS {n}" for n, x in zip(names[1:], ("a", "b", "a * a + b * b", "e", "h", "e * e + h * h"), strict=True))
    ORACLE[f"ml_gradient_{model}"] = f"""WITH {_MODEL}, x AS (SELECT *, {value} AS x FROM mo), z AS (SELECT vec_id, k, ({weight}) * fr AS re, ({weight}) * fi AS im FROM x),
y AS {_bw("z")}, c AS (SELECT vec_id, round(sum({cost}), 5) AS cost FROM x GROUP BY vec_id),
g AS (SELECT vec_id, 2 * {conj_p[0]} AS a, 2 * {conj_p[1]} AS b, 2 * {conj_o[0]} AS e, 2 * {conj_o[1]} AS h FROM w JOIN y USING (vec_id, k))
SELECT vec_id, any_value(cost) AS cost, {sums} FROM g JOIN c USING (vec_id) GROUP BY vec_id"""

    def rows(a: dict[str, np.ndarray]) -> list[tuple]:
        obj, probe, total = K.gradients(model, PROBE, a["patch"], a["intensity"], a["mask"])
        return [(total, *(float(x) for g in (obj, probe) for x in (g.sum().real, g.sum().imag, K.abs2(g).sum())))]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(by_frame(spark, sf_dir, ", ".join(f"{n} double" for n in names), rows), 5, *names)

    QUERIES[f"ml_gradient_{model}"] = run


for _model in _COST:
    _gradient(_model)


_GH = (
    "(SELECT vec_id, k, {} + {} AS re, {} + {} AS im FROM w)".format(_times("pr,pi_", "q_r,q_i")[0], _times("hr,hi", "o_r,o_i")[0], _times("pr,pi_", "q_r,q_i")[1], _times("hr,hi", "o_r,o_i")[1]),
    "(SELECT vec_id, k, {} AS re, {} AS im FROM w)".format(*_times("hr,hi", "q_r,q_i")),
)
_LINE = f"""{_MODEL}, g AS {_fw(_GH[0])}, h AS {_fw(_GH[1])},
l AS (SELECT vec_id, i, m, a0, 2 * (fr * g.re + fi * g.im) AS a1, 2 * (fr * h.re + fi * h.im) + g.re * g.re + g.im * g.im AS a2, 2 * (g.re * h.re + g.im * h.im) AS a3, h.re * h.re + h.im * h.im AS a4
    FROM mo JOIN g USING (vec_id, k) JOIN h USING (vec_id, k))"""
_B = {
    "gaussian": ("m / (i + 1) * (a0 - i) * (a0 - i)", "2 * m / (i + 1) * (a0 - i) * a1", "m / (i + 1) * (a1 * a1 + 2 * (a0 - i) * a2)"),
    "poisson": ("m * (x - i * ln(x))", "m * a1 * (1 - i / x)", "m * (a2 * (1 - i / x) + 0.5 * i / x * a1 * a1 / x)"),
    "euclid": ("m * (x - sqrt(i)) * (x - sqrt(i))", "m * (1 - sqrt(i) / x) * a1", "m * ((1 - sqrt(i) / x) * a2 + 0.25 * sqrt(i) * a1 * a1 / (x * x * x))"),
}


def _line(model: str, name: str) -> None:
    sums = ", ".join(f"round(sum({b}), 5) + 0.0 AS b{k}" for k, b in enumerate(_B[model]))
    ORACLE[name] = f"WITH {_LINE} SELECT vec_id, {sums} FROM (SELECT *, {_COST[model][0]} AS x FROM l) GROUP BY vec_id"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = by_frame(spark, sf_dir, "b0 double, b1 double, b2 double", lambda a: [tuple(K.line_coefficients(model, PROBE, a["patch"], PROBE_STEP, a["patch_step"], a["intensity"], a["mask"]).tolist())])
        return rounded(out, 5, "b0", "b1", "b2")

    QUERIES[name] = run


for _model, _name in (("gaussian", "ml_line_coeffs"), ("poisson", "ml_line_poisson"), ("euclid", "ml_line_euclid")):
    _line(_model, _name)

_A = ("(a0 - i)", "a1", "a2", "a3", "a4")
_NINE = [f"b{k}" for k in range(9)]
_B9 = ", ".join(f"round(sum(m / (i + 1) * ({' + '.join(f'{x} * {_A[k - j]}' for j, x in enumerate(_A) if 0 <= k - j < 5)})), 5) + 0.0 AS b{k}" for k in range(9))


@query(f"WITH {_LINE} SELECT vec_id, {_B9} FROM l GROUP BY vec_id")
def ml_line_all(spark, sf_dir):
    """All nine coefficients of the Gaussian cost along a line."""
    return _nine(spark, sf_dir, "gaussian")


def _nine(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    out = by_frame(spark, sf_dir, ", ".join(f"{n} double" for n in _NINE), lambda a: [tuple(K.line_coefficients_all(model, PROBE, a["patch"], PROBE_STEP, a["patch_step"], a["intensity"], a["mask"]).tolist())])
    return rounded(out, 5, *_NINE)


#: Factors of d, d^2, ... where the model intensity of a pixel grows by d = a1 t + ... + a4 t^4; x as in _COST.
_SERIES = {
    "poisson": ("m * (x - i * ln(x))", "m * (1 - i / x)", "m * i / (2 * x * x)"),
    "euclid": ("m * (x - sqrt(i)) * (x - sqrt(i))", "m * (1 - sqrt(i) / x)", "m * sqrt(i) / (4 * x * x * x)", "-m / (8 * x * x * x * x)", "m / (64 * x * x * x * x * x * x)"),
}


def _line_all(model: str) -> None:
    terms: list[list[str]] = [[] for _ in range(9)]
    for p, factor in enumerate(_SERIES[model]):
        for powers in itertools.product(range(1, 5), repeat=p):
            if sum(powers) <= 8:
                terms[sum(powers)].append(" * ".join([f"f{p}", *(f"a{k}" for k in powers)]))
    factors = ", ".join(f"{f} AS f{p}" for p, f in enumerate(_SERIES[model]))
    sums = ", ".join(f"round(sum({' + '.join(t)}), 5) + 0.0 AS b{k}" for k, t in enumerate(terms))
    ORACLE[f"ml_line_all_{model}"] = f"WITH {_LINE} SELECT vec_id, {sums} FROM (SELECT *, {factors} FROM (SELECT *, {_COST[model][0]} AS x FROM l)) GROUP BY vec_id"
    QUERIES[f"ml_line_all_{model}"] = lambda spark, sf_dir: _nine(spark, sf_dir, model)


for _model in _SERIES:
    _line_all(_model)


# ---- positions ------------------------------------------------------------------

_SHIFTS = [(0, 0), *K.grid_shifts(1)]
_CANDIDATES = ", ".join(f"({n}, {dr}, {dc})" for n, (dr, dc) in enumerate(_SHIFTS))


@query(f"""WITH {_FRAMES},
s(n, dr, dc) AS (VALUES {_CANDIDATES}),
po AS (SELECT w.vec_id, n, w.k, pr * (1 + e / 2) - pi_ * e / 4 AS re, pr * e / 4 + pi_ * (1 + e / 2) AS im
    FROM w CROSS JOIN s JOIN (SELECT vec_id, k AS at, v AS e FROM px) o ON o.vec_id = w.vec_id AND o.at = ((w.r + 1 + dr) * 10 + w.c + 1 + dc) % 64),
f AS {_fw("po", "vec_id, n")},
t AS (SELECT vec_id, n, sum(m * (sqrt(re * re + im * im) - sqrt(i)) * (sqrt(re * re + im * im) - sqrt(i))) / sum(m) AS err FROM f JOIN w USING (vec_id, k) GROUP BY vec_id, n),
b AS (SELECT vec_id, arg_min(n, err) AS n, min(err) AS err, max(err) FILTER (n = 0) AS old FROM t GROUP BY vec_id)
SELECT vec_id, dr::INT AS dr, dc::INT AS dc, round(err, 6) AS error, round(old, 6) AS old_error FROM b JOIN s USING (n)""")
def posref_argmin(spark, sf_dir):
    """The best of five places of every frame on an object of its own."""

    def rows(a: dict[str, np.ndarray]) -> list[tuple]:
        obj = a["patch"].ravel()[np.arange(100) % 64].reshape(1, 10, 10)
        return [K.best_shift(PROBE, obj, 1, 1, _SHIFTS[1:], a["intensity"], a["mask"])]

    return rounded(by_frame(spark, sf_dir, "dr int, dc int, error double, old_error double", rows), 6, "error", "old_error")


# ---- sums and engines -------------------------------------------------------------


def scan_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a frame of a scan over a FIELD by FIELD object."""
    schema = "frame_idx long, r0 int, c0 int, n int, intensity binary, mask binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                a = arrays(e)
                rows.append((i, i * 3 % 9, i * 5 % 9, N, a["intensity"].astype("<f4").tobytes(), a["mask"].astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, schema)


_PLACED = "(vec_id * 3 % 9 + r)::INT AS y, (vec_id * 5 % 9 + c)::INT AS x"


@query(f"WITH {_FRAMES} SELECT y, x, round(sum(pr * sqrt(i)), 5) + 0.0 AS num_re, round(sum(-pi_ * sqrt(i)), 5) + 0.0 AS num_im, round(sum(pr * pr + pi_ * pi_), 5) AS den FROM (SELECT *, {_PLACED} FROM w) GROUP BY y, x")
def allreduce(spark, sf_dir):
    """Sums of all tasks over the tiles of an object, added up the tree."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, den = TileSums(), K.abs2(PROBE).sum(axis=0)
        for pdf in batches:
            for row in pdf.itertuples():
                sums.add_patch(int(row.r0), int(row.c0), np.conj(PROBE[0]) * np.sqrt(np.frombuffer(row.intensity, "<f4").reshape(N, N).astype(float)), den)
        yield sums.rows()

    num, den = object_sums(collect_sums(scan_of_embeddings(spark, sf_dir).mapInPandas(partial, SUMS)), (FIELD, FIELD))
    rows = [(int(y), int(x), float(num[y, x].real), float(num[y, x].imag), float(den[y, x])) for y, x in np.argwhere(den > 0)]
    return rounded(spark.createDataFrame(rows, "y int, x int, num_re double, num_im double, den double"), 5, "num_re", "num_im", "den")


def _engine_sql(name: str, coefficients: tuple[float, float, float], iterations: int, inertia: float = 1e-4) -> str:
    """Exit waves, projections and object updates of each iteration, one after the other."""
    a, b, c = coefficients
    ctes, out = [f"fw_ AS (SELECT *, {_PLACED} FROM w)", f"cc AS (SELECT {inertia} * sum(m * i) / count(DISTINCT vec_id) / 64 AS c FROM w)", "psi0 AS (SELECT vec_id, k, pr AS re, pi_ AS im FROM w)", f"ob0 AS (SELECT y, x, 1.0 AS re, 0.0 AS im FROM (SELECT unnest(range({FIELD})) AS y), (SELECT unnest(range({FIELD})) AS x))"], []
    for n in range(iterations):
        po = _times("p.pr,p.pi_", "o.re,o.im")
        ctes += [
            f"po{n} AS (SELECT p.vec_id, p.k, p.i, p.m, {po[0]} AS re, {po[1]} AS im FROM fw_ p JOIN ob{n} o USING (y, x))",
            f"f{n} AS {_fw(f'(SELECT vec_id, k, {1 - c} * s.re + {c} * o.re AS re, {1 - c} * s.im + {c} * o.im AS im FROM psi{n} s JOIN po{n} o USING (vec_id, k))')}",
            f"l{n} AS {_fw(f'po{n}')}",
            f"y{n} AS {_bw(f'(SELECT vec_id, k, z * re AS re, z * im AS im FROM (SELECT vec_id, k, f.re, f.im, 1 - m + m * sqrt(i) / (sqrt(f.re * f.re + f.im * f.im) + 1e-10) AS z FROM f{n} f JOIN po{n} o USING (vec_id, k)))')}",
            f"ch{n} AS (SELECT vec_id, k, s.re AS sr, s.im AS si, {b} * y.re + {a} * o.re - {a + b} * s.re AS re, {b} * y.im + {a} * o.im - {a + b} * s.im AS im FROM psi{n} s JOIN po{n} o USING (vec_id, k) JOIN y{n} y USING (vec_id, k))",
            f"psi{n + 1} AS (SELECT vec_id, k, sr + re AS re, si + im AS im FROM ch{n})",
            f"ob{n + 1} AS (SELECT o.y, o.x, coalesce((c * o.re + a) / (c + d), o.re) AS re, coalesce((c * o.im + b) / (c + d), o.im) AS im FROM ob{n} o CROSS JOIN cc LEFT JOIN (SELECT y, x, sum(pr * s.re + pi_ * s.im) AS a, sum(pr * s.im - pi_ * s.re) AS b, sum(pr * pr + pi_ * pi_) AS d FROM fw_ JOIN psi{n + 1} s USING (vec_id, k) GROUP BY y, x) t ON t.y = o.y AND t.x = o.x)",
            f"""er{n} AS (SELECT avg(fe) AS err_fourier, avg(pe) AS err_photon, avg(ee) AS err_exit FROM (SELECT vec_id, sum(m * (sqrt(f.re * f.re + f.im * f.im) - sqrt(i)) * (sqrt(f.re * f.re + f.im * f.im) - sqrt(i))) / sum(m) AS fe,
    sum(m * (l.re * l.re + l.im * l.im - i) * (l.re * l.re + l.im * l.im - i) / (i + 1)) / 64 AS pe, sum(h.re * h.re + h.im * h.im) / 64 AS ee FROM f{n} f JOIN l{n} l USING (vec_id, k) JOIN po{n} o USING (vec_id, k) JOIN ch{n} h USING (vec_id, k) GROUP BY vec_id))""",
        ]
        out.append(f"SELECT '{name}' AS engine, {n + 1}::INT AS iteration, round(err_fourier, 6) AS err_fourier, round(err_photon, 6) AS err_photon, round(err_exit, 6) AS err_exit FROM er{n}")
    return f"WITH {_FRAMES},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


def _projection_engine(cls: type, coefficients: tuple[float, float, float], iterations: int = 3) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = cls(scan_of_embeddings(spark, sf_dir), State(PROBE.copy(), np.ones((1, FIELD, FIELD), complex)), numiter=iterations, probe_update_start=99, fourier_power_bound=0.0)
        e.run()
        return rounded(e.iter_info().drop("duration"), 6, "err_fourier", "err_photon", "err_exit")

    name = f"engine_{cls.name.lower()}"
    QUERIES[name], ORACLE[name] = run, _engine_sql(cls.name, coefficients, iterations)


_projection_engine(DM, (-1.0, 1.0, 2.0))
_projection_engine(RAAR, (-0.5, 0.75, 2.0))
_projection_engine(AP, (0.0, 1.0, 1.0))


# The direction is the gradient, over the fluence where the wavefield preconditions.
_PH = "(SELECT vec_id, k, {} AS re, {} AS im FROM fw_ JOIN go USING (y, x))".format(*_times("pr,pi_", "(-a),(-b)"))
_ML = f"""WITH {_FRAMES},
fw_ AS (SELECT *, {_PLACED} FROM w),
f AS {_fw("(SELECT vec_id, k, pr AS re, pi_ AS im FROM w)")},
mo AS (SELECT vec_id, k, re, im, re * re + im * im AS a0, i, m FROM f JOIN w USING (vec_id, k)),
y AS {_bw("(SELECT vec_id, k, m / (i + 1) * (a0 - i) * re AS re, m / (i + 1) * (a0 - i) * im AS im FROM mo)")},
go AS (SELECT y, x, 2 * sum(pr * g.re + pi_ * g.im) AS a, 2 * sum(pr * g.im - pi_ * g.re) AS b FROM fw_ JOIN (SELECT * FROM (SELECT vec_id, k, re, im FROM y)) g USING (vec_id, k) GROUP BY y, x),
h AS {_fw(_PH)},
t AS (SELECT -0.5 * sum(2 * m / (i + 1) * (a0 - i) * a1) / sum(m / (i + 1) * (a1 * a1 + 2 * (a0 - i) * a2)) AS t FROM (SELECT i, m, a0, 2 * (mo.re * h.re + mo.im * h.im) AS a1, h.re * h.re + h.im * h.im AS a2 FROM mo JOIN h USING (vec_id, k))),
n AS (SELECT (mo.re + t * h.re) * (mo.re + t * h.re) + (mo.im + t * h.im) * (mo.im + t * h.im) AS a0, i, m, vec_id FROM mo JOIN h USING (vec_id, k), t)
SELECT 'ML' AS engine, 1::INT AS iteration, 0.0::DOUBLE AS err_fourier, round(sum(m / (i + 1) * (a0 - i) * (a0 - i)) / count(DISTINCT vec_id) / 64, 6) AS err_photon, 0.0::DOUBLE AS err_exit FROM mo
UNION ALL SELECT 'ML', 2::INT, 0.0::DOUBLE, round(sum(m / (i + 1) * (a0 - i) * (a0 - i)) / count(DISTINCT vec_id) / 64, 6), 0.0::DOUBLE FROM n"""


@query(_ML)
def engine_ml(spark, sf_dir):
    """Gradient, line search and step of the Gaussian model, and the cost that they lead to."""
    e = ML(scan_of_embeddings(spark, sf_dir), State(PROBE.copy(), np.ones((1, FIELD, FIELD), complex)), numiter=2, probe_update_start=99)
    e.run()
    return rounded(e.iter_info().drop("duration"), 6, "err_photon")


QUERIES["iter_error_mean"], ORACLE["iter_error_mean"] = (lambda spark, sf_dir: QUERIES["engine_ap"](spark, sf_dir).filter("iteration = 1").drop("engine", "iteration")), f"SELECT err_fourier, err_photon, err_exit FROM ({_engine_sql('AP', (0.0, 1.0, 1.0), 1)})"


@query(_ML.replace("2 * sum(pr * g.re + pi_ * g.im) AS a, 2 * sum(pr * g.im - pi_ * g.re) AS b", "2 * sum(pr * g.re + pi_ * g.im) / (0.1 + sum(pr * pr + pi_ * pi_)) AS a, 2 * sum(pr * g.im - pi_ * g.re) / (0.1 + sum(pr * pr + pi_ * pi_)) AS b"))
def engine_ml_wavefield(spark, sf_dir):
    """As engine_ml, with the gradient over the fluence of the object."""
    e = ML(scan_of_embeddings(spark, sf_dir), State(PROBE.copy(), np.ones((1, FIELD, FIELD), complex)), numiter=2, probe_update_start=99, wavefield_precond=True)
    e.run()
    return rounded(e.iter_info().drop("duration"), 6, "err_photon")
