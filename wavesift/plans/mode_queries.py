"""Engines with their probe update on, with several modes and with objects in tiles, on frames made of the embeddings.

The SQL repeats whole iterations: projection with power bound, overlap updates of
object and probe in turn, for any number of modes of either.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import kernels as K
from wavesift.operators.engines import AP, DM, EPIE, RAAR, SDR, WASP, DMObjectRegul, Engine, EPIEParallel, SequentialEngine, State
from wavesift.operators.partition import by_load
from wavesift.operators.posref import PositionRefinement, refine
from wavesift.operators.stxm import stxm_analysis
from wavesift.operators.tiled import TiledDM, TiledML, TiledRAAR, cut, pixels
from wavesift.plans.demo_tables import read, rounded
from wavesift.plans.kernel_queries import _FRAMES, _ML, _PLACED, FIELD, N, PROBE, PROBE_STEP, _CANDIDATES, _bw, _fw, _times, by_frame, scan_of_embeddings

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_R, _C = np.divmod(np.arange(N * N), N)
_G = np.exp(-((_R - 3.5) ** 2 + (_C - 3.5) ** 2) / 16)
_Y, _X = np.divmod(np.arange(FIELD * FIELD), FIELD)
#: Two modes of each; the first ones are those of the other engine queries.
PROBES = np.concatenate([PROBE, (_G * (0.3 * (_R - 3.5) + 0.2j)).reshape(1, N, N)])
OBJECTS = np.stack([np.ones(FIELD * FIELD), 0.3 + 0.02j * (_Y - _X)]).astype(complex).reshape(2, FIELD, FIELD)
MASK = ((_Y + _X) % 5 == 0).reshape(FIELD, FIELD)
FILL = 0.9
TILE = 8
#: A bound that some frames stay under.
BOUND = 0.35


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_START = """
k0 AS (SELECT unnest(range(64))::INT AS k),
g0 AS (SELECT k, k // 8 AS r, k % 8 AS c, exp(-((k // 8 - 3.5) * (k // 8 - 3.5) + (k % 8 - 3.5) * (k % 8 - 3.5)) / 16) AS g FROM k0),
pm0 AS (SELECT 0 AS p, k, g AS re, 0.1 * g * (r - c) AS im FROM g0 UNION ALL SELECT 1, k, 0.3 * g * (r - 3.5), 0.2 * g FROM g0),
yx AS (SELECT (k // 16)::INT AS y, (k % 16)::INT AS x FROM (SELECT unnest(range(256)) AS k)),
ob0 AS (SELECT 0 AS o, y, x, 1.0::DOUBLE AS re, 0.0::DOUBLE AS im FROM yx UNION ALL SELECT 1, y, x, 0.3, 0.02 * (y - x) FROM yx)"""


def _modes_sql(coefficients: tuple[float, float, float], iterations: int, probes: int, objects: int, bound: float, overlaps: int, masked: bool = False) -> tuple[list[str], int]:
    """CTEs of whole iterations: pm and ob of the last number are the final probe and object, er{n} the errors of iteration n."""
    a, b, c = coefficients
    keys = "vec_id, p, o"
    ctes = [
        _FRAMES.strip(),
        _START.strip(),
        f"fw_ AS MATERIALIZED (SELECT vec_id, k, i, m, {_PLACED} FROM w)",
        "cc AS (SELECT 1e-4 * sum(m * i) / count(DISTINCT vec_id) / 64 AS c, 1e-9 * count(DISTINCT vec_id) AS cp FROM fw_)",
        f"pm00 AS MATERIALIZED (SELECT * FROM pm0 WHERE p < {probes})",
        f"ob00 AS MATERIALIZED (SELECT * FROM ob0 WHERE o < {objects})",
    ]
    pm, ob, psi = "pm00", "ob00", None
    for n in range(iterations):
        po = _times("p.re,p.im", "o.re,o.im")
        ctes.append(f"po{n} AS MATERIALIZED (SELECT f.vec_id, p.p, o.o, f.k, {po[0]} AS re, {po[1]} AS im FROM fw_ f JOIN {pm} p USING (k) JOIN {ob} o USING (y, x))")
        psi = psi or "po0"
        ctes += [
            f"f{n} AS MATERIALIZED {_fw(f'(SELECT {keys}, k, {1 - c} * s.re + {c} * t.re AS re, {1 - c} * s.im + {c} * t.im AS im FROM {psi} s JOIN po{n} t USING ({keys}, k))', keys)}",
            f"l{n} AS {_fw(f'po{n}', keys)}",
            f"a{n} AS (SELECT vec_id, k, sqrt(sum(re * re + im * im)) AS a FROM f{n} GROUP BY vec_id, k)",
            f"q{n} AS (SELECT vec_id, k, a, sqrt(i) AS t, m, sum(m * (a - sqrt(i)) * (a - sqrt(i))) OVER (PARTITION BY vec_id) / sum(m) OVER (PARTITION BY vec_id) AS err FROM a{n} JOIN fw_ USING (vec_id, k))",
            f"z{n} AS MATERIALIZED (SELECT vec_id, k, err, 1 - m + m * (t + (a - t) * sqrt({bound} / err)) / (a + 1e-10) AS z FROM q{n})",
            f"y{n} AS MATERIALIZED {_bw(f'(SELECT {keys}, k, z * re AS re, z * im AS im FROM f{n} JOIN z{n} USING (vec_id, k))').replace('SELECT vec_id, to_k', f'SELECT {keys}, to_k').replace('GROUP BY vec_id, to_k', f'GROUP BY {keys}, to_k')}",
            f"ch{n} AS MATERIALIZED (SELECT {keys}, k, s.re AS sr, s.im AS si, "
            + ", ".join(f"CASE WHEN err > {bound} THEN {b} * y.{x} + {a} * t.{x} - {a + b} * s.{x} ELSE {a + b * c} * (t.{x} - s.{x}) END AS {x}" for x in ("re", "im"))
            + f" FROM {psi} s JOIN po{n} t USING ({keys}, k) JOIN y{n} y USING ({keys}, k) JOIN z{n} z USING (vec_id, k))",
            f"psi{n + 1} AS MATERIALIZED (SELECT {keys}, k, sr + re AS re, si + im AS im FROM ch{n})",
            f"""er{n} AS (SELECT avg(fe) AS err_fourier, avg(pe) AS err_photon, avg(ee) AS err_exit FROM (SELECT vec_id, max(err) AS fe FROM q{n} GROUP BY vec_id)
    JOIN (SELECT vec_id, sum(m * (l - i) * (l - i) / (i + 1)) / 64 AS pe FROM (SELECT vec_id, k, sum(re * re + im * im) AS l FROM l{n} GROUP BY vec_id, k) JOIN fw_ USING (vec_id, k) GROUP BY vec_id) USING (vec_id)
    JOIN (SELECT vec_id, sum(re * re + im * im) / 64 AS ee FROM ch{n} GROUP BY vec_id) USING (vec_id))""",
        ]
        psi = f"psi{n + 1}"
        for inner in range(overlaps):
            filled = ("CASE WHEN (o.y + o.x) % 5 = 0 THEN {} ELSE {} END").format
            re, im = "coalesce((c * o.re + a) / (c + d), o.re)", "coalesce((c * o.im + b) / (c + d), o.im)"
            if masked:
                re, im = filled(FILL, re), filled("0.0", im)
            ctes += [
                f"ob{n + 1}{inner} AS MATERIALIZED (SELECT o.o, o.y, o.x, {re} AS re, {im} AS im FROM {ob} o CROSS JOIN cc LEFT JOIN (SELECT o, y, x, sum(p.re * s.re + p.im * s.im) AS a, sum(p.re * s.im - p.im * s.re) AS b FROM {psi} s JOIN fw_ USING (vec_id, k) JOIN {pm} p USING (p, k) GROUP BY o, y, x) t ON t.o = o.o AND t.y = o.y AND t.x = o.x LEFT JOIN (SELECT y, x, sum(d) AS d FROM fw_ JOIN (SELECT k, sum(re * re + im * im) AS d FROM {pm} GROUP BY k) USING (k) GROUP BY y, x) u ON u.y = o.y AND u.x = o.x)",
            ]
            ob = f"ob{n + 1}{inner}"
            ctes += [
                f"pm{n + 1}{inner} AS MATERIALIZED (SELECT p.p, p.k, (cp * p.re + a) / (cp + d) AS re, (cp * p.im + b) / (cp + d) AS im FROM {pm} p CROSS JOIN cc JOIN (SELECT p, k, sum(o.re * s.re + o.im * s.im) AS a, sum(o.re * s.im - o.im * s.re) AS b FROM {psi} s JOIN fw_ USING (vec_id, k) JOIN {ob} o USING (o, y, x) GROUP BY p, k) t USING (p, k) JOIN (SELECT k, sum(o.re * o.re + o.im * o.im) AS d FROM fw_ JOIN {ob} o USING (y, x) GROUP BY k) u USING (k))",
            ]
            pm = f"pm{n + 1}{inner}"
    return ctes, (pm, ob)


def _errors_sql(name: str, coefficients, iterations: int, **how) -> str:
    ctes, _ = _modes_sql(coefficients, iterations, **how)
    out = " UNION ALL ".join(f"SELECT '{name}' AS engine, {n + 1}::INT AS iteration, round(err_fourier, 6) AS err_fourier, round(err_photon, 6) AS err_photon, round(err_exit, 6) AS err_exit FROM er{n}" for n in range(iterations))
    return "WITH " + ",\n".join(ctes) + "\n" + out


def _state_sql(coefficients, iterations: int, **how) -> str:
    ctes, (pm, ob) = _modes_sql(coefficients, iterations, **how)
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT 'object' AS what, o::INT AS mode, y, x, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM {ob}"
        f" UNION ALL SELECT 'probe', p::INT, (k // 8)::INT, (k % 8)::INT, round(re, 5) + 0.0, round(im, 5) + 0.0 FROM {pm}"
    )


def errors(e: Engine) -> DataFrame:
    e.run()
    return rounded(e.iter_info().drop("duration"), 6, "err_fourier", "err_photon", "err_exit")


def state_rows(spark: SparkSession, obj: DataFrame, probe: np.ndarray) -> DataFrame:
    """Pixels of object and probe modes in one table."""
    own = pixels(cut(spark, probe, N), (N, N), N).select(F.lit("probe").alias("what"), "*")
    return rounded(obj.select(F.lit("object").alias("what"), "*").unionByName(own), 5, "re", "im")


# ---- the probe half ----------------------------------------------------------

ONE = {"probes": 1, "objects": 1, "bound": BOUND, "overlaps": 2}
TWO = {"probes": 2, "objects": 2, "bound": BOUND, "overlaps": 2}
BOTH_UPDATES = {"numiter": 2, "fourier_power_bound": BOUND, "overlap_max_iterations": 2, "overlap_converge_factor": 0.0}


def _one(obj: np.ndarray = OBJECTS) -> State:
    return State(PROBE.copy(), obj[:1].copy())


def _probe_half(cls: type, coefficients: tuple[float, float, float]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return errors(cls(scan_of_embeddings(spark, sf_dir), _one(), **BOTH_UPDATES))

    name = f"engine_{cls.name.lower()}_probe"
    QUERIES[name], ORACLE[name] = run, _errors_sql(cls.name, coefficients, 2, **ONE)


_probe_half(DM, (-1.0, 1.0, 2.0))
_probe_half(RAAR, (-0.5, 0.75, 2.0))
_probe_half(AP, (0.0, 1.0, 1.0))


@query(_state_sql((-1.0, 1.0, 2.0), 2, **ONE, masked=True))
def engine_dm_object_regul(spark, sf_dir):
    """A part of the object is held at a value, in every overlap update."""
    e = DMObjectRegul(scan_of_embeddings(spark, sf_dir), _one(), **BOTH_UPDATES, object_regul_mask=MASK, object_regul_fill=FILL)
    e.run()
    return state_rows(spark, pixels(cut(spark, e.state.obj, N), (FIELD, FIELD), N), e.state.probe)


# ---- several modes, and objects in tiles ----------------------------------------


@query(_state_sql((-1.0, 1.0, 2.0), 2, **TWO))
def engine_dm_modes(spark, sf_dir):
    """Two probe modes with two object modes."""
    e = DM(scan_of_embeddings(spark, sf_dir), State(PROBES.copy(), OBJECTS.copy()), **BOTH_UPDATES)
    e.run()
    return state_rows(spark, pixels(cut(spark, e.state.obj, N), (FIELD, FIELD), N), e.state.probe)


def _tiled(cls: type, spark: SparkSession, sf_dir: str, probe: np.ndarray, obj: np.ndarray, **how) -> Engine:
    return cls(scan_of_embeddings(spark, sf_dir), State(probe.copy(), np.zeros((len(obj), 0, 0), complex)), tiles=cut(spark, obj, TILE), tile=TILE, **how)


@query(ORACLE["engine_dm_modes"])
def engine_dm_tiled(spark, sf_dir):
    """As engine_dm_modes, with the object as a table of tiles."""
    e = _tiled(TiledDM, spark, sf_dir, PROBES, OBJECTS, **BOTH_UPDATES)
    e.run()
    return state_rows(spark, pixels(e.tiles, (FIELD, FIELD), TILE), e.state.probe)


@query(ORACLE["engine_raar_probe"])
def engine_raar_tiled(spark, sf_dir):
    return errors(_tiled(TiledRAAR, spark, sf_dir, PROBE, OBJECTS[:1], **BOTH_UPDATES))


@query(_ML)
def engine_ml_tiled(spark, sf_dir):
    """Gradient, line search and step over tiles."""
    e = _tiled(TiledML, spark, sf_dir, PROBE, OBJECTS[:1], numiter=2, probe_update_start=99)
    e.run()
    return rounded(e.iter_info().drop("duration"), 6, "err_photon")



_GRADIENTS = [f"{what}{mode}_{part}" for what in ("obj", "probe") for mode in (0, 1) for part in ("re", "im", "norm2")]


def _gradient_modes_sql() -> str:
    """Two probe modes (probe and step) with two patches (patch and step)."""
    po = _times("p.re,p.im", "o.re,o.im")
    own = []
    for what, conj, side, other in (("obj", "p", "o", "p"), ("probe", "o", "p", "o")):
        a, b = _times(f"{conj}.re,(-{conj}.im)", "y.re,y.im")
        own.append(f"g{what} AS (SELECT vec_id, k, y.{side} AS mode, 2 * sum({a}) AS a, 2 * sum({b}) AS b FROM y JOIN pm p USING (vec_id, p, k) JOIN om o USING (vec_id, o, k) GROUP BY vec_id, k, y.{side})")
    sums = ", ".join(
        f"(SELECT round(sum({x}), 5) + 0.0 FROM g{what} g WHERE g.vec_id = c.vec_id AND mode = {mode}) AS {what}{mode}_{part}"
        for what in ("obj", "probe") for mode in (0, 1) for part, x in (("re", "a"), ("im", "b"), ("norm2", "a * a + b * b"))
    )
    keys = "vec_id, p, o"
    bw = _bw("(SELECT vec_id, p, o, k, m / (i + 1) * (a0 - i) * re AS re, m / (i + 1) * (a0 - i) * im AS im FROM f JOIN mo USING (vec_id, k))")
    bw = bw.replace("SELECT vec_id, to_k", f"SELECT {keys}, to_k").replace("GROUP BY vec_id, to_k", f"GROUP BY {keys}, to_k")
    return f"""WITH {_FRAMES},
pm AS (SELECT vec_id, k, 0 AS p, pr AS re, pi_ AS im FROM w UNION ALL SELECT vec_id, k, 1, hr, hi FROM w),
om AS (SELECT vec_id, k, 0 AS o, o_r AS re, o_i AS im FROM w UNION ALL SELECT vec_id, k, 1, q_r, q_i FROM w),
po AS (SELECT vec_id, p, o, k, {po[0]} AS re, {po[1]} AS im FROM pm p JOIN om o USING (vec_id, k)),
f AS MATERIALIZED {_fw("po", keys)},
mo AS (SELECT vec_id, k, a0, i, m FROM (SELECT vec_id, k, sum(re * re + im * im) AS a0 FROM f GROUP BY vec_id, k) JOIN w USING (vec_id, k)),
y AS MATERIALIZED {bw},
{", ".join(own)},
c AS (SELECT vec_id, round(sum(m / (i + 1) * (a0 - i) * (a0 - i)), 5) AS cost FROM mo GROUP BY vec_id)
SELECT vec_id, cost, {sums} FROM c"""


@query(_gradient_modes_sql())
def ml_gradient_modes(spark, sf_dir):
    """Gradients by mode of two probe modes with two object modes, in every frame."""
    probe = np.concatenate([PROBE, PROBE_STEP])

    def rows(a: dict[str, np.ndarray]) -> list[tuple]:
        obj, own, total = K.gradients("gaussian", probe, np.concatenate([a["patch"], a["patch_step"]]), a["intensity"], a["mask"])
        return [(total, *(float(x) for g in (*obj, *own) for x in (g.sum().real, g.sum().imag, K.abs2(g).sum())))]

    names = ["cost", *_GRADIENTS]
    return rounded(by_frame(spark, sf_dir, ", ".join(f"{n} double" for n in names), rows), 5, *names)


# ---- domains by load, and sequential engines ------------------------------------


def _by_load_sql(source: str, x: str, y: str, key: str, domains: int) -> list[str]:
    """CTEs of which the last, dealt, has key and domain: ``source`` cut again and again at the row that parts its share."""
    shift = f"{key} * 7919 % 10007 / 10007.0"
    ctes, sizes, n = [f"lv0 AS (SELECT {key} AS key, 0 AS base, {domains} AS m, {x} + {shift} AS u, {y} + {shift} AS v FROM {source})"], {domains}, 0
    while any(m > 1 for m in sizes):
        ctes += [
            f"ax{n} AS (SELECT *, max(u) OVER b - min(u) OVER b >= max(v) OVER b - min(v) OVER b AS across, count(*) OVER b AS n FROM lv{n} WINDOW b AS (PARTITION BY base))",
            f"rk{n} AS MATERIALIZED (SELECT *, m > 1 AND row_number() OVER (PARTITION BY base ORDER BY if(across, u, v)) > ceil((m // 2) * n / m) AS after FROM ax{n})",
            f"lv{n + 1} AS (SELECT key, if(after, base + m // 2, base) AS base, CASE WHEN m = 1 THEN 1 WHEN after THEN m - m // 2 ELSE m // 2 END AS m, u, v FROM rk{n})",
        ]
        n += 1
        sizes = {h for m in sizes for h in ((m // 2, m - m // 2) if m > 1 else (1,))}
    return [*ctes, f"dealt AS (SELECT key, base::BIGINT AS domain FROM lv{n})"]


_CROWDED = "(SELECT c_custkey, floor(power((c_acctbal + 1000) / 1000, 3)) AS x, (c_custkey % 7 * (c_custkey % 5)) AS y FROM customer)"


@query("WITH " + ",\n".join(_by_load_sql(_CROWDED, "x", "y", "c_custkey", 12)) + " SELECT key AS c_custkey, domain, count(*) OVER (PARTITION BY domain) <= 1.2 * count(*) OVER () / 12 + 1 AS fair FROM dealt")
def domains_by_load(spark, sf_dir):
    """Crowded places in 12 regions of about as many rows each."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.floor(F.pow((F.col("c_acctbal").cast("double") + 1000) / 1000, 3)).alias("x"), (F.col("c_custkey") % 7 * (F.col("c_custkey") % 5)).alias("y"))
    own = by_load(c, "x", "y", "c_custkey", 12)
    sizes = own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("of"))))
    return own.join(F.broadcast(sizes), "domain").select("c_custkey", "domain", (F.col("n") <= 1.2 * F.col("of") / 12 + 1).alias("fair"))


def _sweep_sql(b: float, steps: tuple[float, float, float, float], domains: int, averaged: bool) -> str:
    """One sweep of every domain, frame after frame: a recursion whose rows hold probe and object as lists."""
    oa, ob, pa, pb = steps
    each = "list_transform(range(1, 65), lambda k: {})".format
    norm = lambda re, im: each(f"{re}[k] * {re}[k] + {im}[k] * {im}[k]")
    fw = lambda re, im: (f"list_transform(range(1, 65), lambda j: (list_dot_product({re}, cs[j]) - list_dot_product({im}, sn[j])) / 8)", f"list_transform(range(1, 65), lambda j: (list_dot_product({re}, sn[j]) + list_dot_product({im}, cs[j])) / 8)")
    bw = lambda re, im: (f"list_transform(range(1, 65), lambda j: (list_dot_product({re}, cs[j]) + list_dot_product({im}, sn[j])) / 8)", f"list_transform(range(1, 65), lambda j: (list_dot_product({im}, cs[j]) - list_dot_product({re}, sn[j])) / 8)")
    put = lambda x: f"list_transform(range(0, 256), lambda j: if(j // 16 BETWEEN r0 AND r0 + 7 AND j % 16 BETWEEN c0 AND c0 + 7, n_{x}[(j // 16 - r0) * 8 + j % 16 - c0 + 1], ob_{x}[j + 1]))"
    conj = lambda a, c: (f"({a}_re[k] * {c}_re[k] + {a}_im[k] * {c}_im[k])", f"({a}_re[k] * {c}_im[k] - {a}_im[k] * {c}_re[k])")
    po, f, y = _times("pr_re[k],pr_im[k]", "o_re[k],o_im[k]"), fw("po_re", "po_im"), bw("zf_re", "zf_im")
    layers = [
        {"o_re": each("ob_re[(r0 + (k - 1) // 8) * 16 + c0 + (k - 1) % 8 + 1]"), "o_im": each("ob_im[(r0 + (k - 1) // 8) * 16 + c0 + (k - 1) % 8 + 1]"), "pp": norm("pr_re", "pr_im")},
        {"po_re": each(po[0]), "po_im": each(po[1])},
        {"f_re": f[0], "f_im": f[1]},
        {"z": each("1 - m[k] + m[k] * amp[k] / (sqrt(f_re[k] * f_re[k] + f_im[k] * f_im[k]) + 1e-10)")},
        {"zf_re": each("z[k] * f_re[k]"), "zf_im": each("z[k] * f_im[k]")},
        {"y_re": y[0], "y_im": y[1]},
        {"d_re": each(f"{b} * (y_re[k] - po_re[k])"), "d_im": each(f"{b} * (y_im[k] - po_im[k])")},
        {"psi_re": each("po_re[k] + d_re[k]"), "psi_im": each("po_im[k] + d_im[k]"), **{f"n_{x}": each(f"o_{x}[k] + {oa + ob} * {v} / ({1 - oa} * list_max(pp) + {oa} * pp[k])") for x, v in zip(("re", "im"), conj("pr", "d"), strict=True)}},
        {"oo": norm("n_re", "n_im")},
        {f"q_{x}": each(f"pr_{x}[k] + {pa + pb} * {v} / ({1 - pa} * list_max(oo) + {pa} * oo[k])") for x, v in zip(("re", "im"), conj("n", "d"), strict=True)},
    ]
    arm = "(SELECT s.domain, s.step, s.pr_re, s.pr_im, s.ob_re, s.ob_im, f.r0, f.c0, f.amp, f.m, tl.cs, tl.sn FROM s JOIN fl f ON f.domain = s.domain AND f.ord = s.step + 1, tl)"
    for layer in layers:
        arm = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer.items()) + f" FROM {arm})"
    deal = _by_load_sql("(SELECT vec_id, vec_id * 3 % 9 AS r0, vec_id * 5 % 9 AS c0 FROM embeddings)", "r0", "c0", "vec_id", domains) if domains > 1 else ["dealt AS (SELECT vec_id AS key, 0::BIGINT AS domain FROM embeddings)"]
    none = "[]::DOUBLE[]"
    if averaged:  # by conj(P) psi over all steps
        obj = "SELECT y, x, CASE WHEN sum(d) >= 1e-8 THEN sum(a) / sum(d) ELSE 1.0 END AS re, CASE WHEN sum(d) >= 1e-8 THEN sum(b) / sum(d) ELSE 0.0 END AS im FROM st GROUP BY y, x"
        probe = "SELECT k, sum(e) / sum(g) AS re, sum(h) / sum(g) AS im FROM st GROUP BY k"
    else:  # by the light that fell on each domain's object
        obj = """SELECT y, x, sum(l * ob_re[y * 16 + x + 1]) / sum(l) AS re, sum(l * ob_im[y * 16 + x + 1]) / sum(l) AS im
    FROM (SELECT domain, y, x, sum(d) AS l FROM st GROUP BY ALL) JOIN en USING (domain) GROUP BY y, x"""
        probe = "SELECT k, sum(step * pr_re[k + 1]) / sum(step) AS re, sum(step * pr_im[k + 1]) / sum(step) AS im FROM en, (SELECT unnest(range(64)) AS k) GROUP BY k"
    return f"""WITH RECURSIVE {_FRAMES.strip()},
{", ".join(deal)},
fl AS MATERIALIZED (SELECT vec_id, domain, r0, c0, amp, m, row_number() OVER (PARTITION BY domain ORDER BY vec_id) AS ord FROM (
    SELECT vec_id, vec_id * 3 % 9 AS r0, vec_id * 5 % 9 AS c0, list(sqrt(i) ORDER BY k) AS amp, list(m::DOUBLE ORDER BY k) AS m FROM w GROUP BY vec_id) JOIN dealt ON key = vec_id),
tl AS MATERIALIZED (SELECT list(cs ORDER BY to_k) AS cs, list(sn ORDER BY to_k) AS sn FROM (SELECT to_k, list(cs ORDER BY k) AS cs, list(sn ORDER BY k) AS sn FROM tw GROUP BY to_k)),
g0 AS (SELECT k, k // 8 AS r, k % 8 AS c, exp(-((k // 8 - 3.5) * (k // 8 - 3.5) + (k % 8 - 3.5) * (k % 8 - 3.5)) / 16) AS g FROM (SELECT unnest(range(64)) AS k)),
s AS (
    SELECT domain, 0::BIGINT AS step, (SELECT list(g::DOUBLE ORDER BY k) FROM g0) AS pr_re, (SELECT list((0.1 * g * (r - c))::DOUBLE ORDER BY k) FROM g0) AS pr_im,
        list_transform(range(256), lambda j: 1.0::DOUBLE) AS ob_re, list_transform(range(256), lambda j: 0.0::DOUBLE) AS ob_im, 0::BIGINT AS r0, 0::BIGINT AS c0, {none} AS n_re, {none} AS n_im, {none} AS psi_re, {none} AS psi_im FROM (SELECT DISTINCT domain FROM dealt)
    UNION ALL
    SELECT domain, step + 1, q_re, q_im, {put("re")}, {put("im")}, r0, c0, n_re, n_im, psi_re, psi_im FROM {arm}),
st AS (SELECT domain, k, r0 + k // 8 AS y, c0 + k % 8 AS x, pr_re[k + 1] * psi_re[k + 1] + pr_im[k + 1] * psi_im[k + 1] AS a, pr_re[k + 1] * psi_im[k + 1] - pr_im[k + 1] * psi_re[k + 1] AS b, pr_re[k + 1] * pr_re[k + 1] + pr_im[k + 1] * pr_im[k + 1] AS d,
    n_re[k + 1] * psi_re[k + 1] + n_im[k + 1] * psi_im[k + 1] AS e, n_re[k + 1] * psi_im[k + 1] - n_im[k + 1] * psi_re[k + 1] AS h, n_re[k + 1] * n_re[k + 1] + n_im[k + 1] * n_im[k + 1] AS g FROM s, (SELECT unnest(range(64)) AS k) WHERE step > 0),
en AS (SELECT * FROM s QUALIFY step = max(step) OVER (PARTITION BY domain))
SELECT 'object' AS what, 0::INT AS mode, y::INT AS y, x::INT AS x, round(coalesce(re, 1.0), 5) + 0.0 AS re, round(coalesce(im, 0.0), 5) + 0.0 AS im FROM (SELECT (k // 16) AS y, (k % 16) AS x FROM (SELECT unnest(range(256)) AS k)) LEFT JOIN ({obj}) USING (y, x)
UNION ALL SELECT 'probe', 0::INT, (k // 8)::INT, (k % 8)::INT, round(re, 5) + 0.0, round(im, 5) + 0.0 FROM ({probe})"""


def _sequential(cls: type[SequentialEngine], steps: tuple[float, float, float, float], domains: int, averaged: bool = False, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = cls(scan_of_embeddings(spark, sf_dir), _one(), numiter=1, domains=domains, order="frame", **how)
        e.run()
        return state_rows(spark, pixels(cut(spark, e.state.obj, N), (FIELD, FIELD), N), e.state.probe)

    name = f"engine_{cls.name.lower()}"
    run.__doc__ = f"One sweep in {domains} domain(s), in the order of the frames."
    QUERIES[name], ORACLE[name] = run, _sweep_sql(1.0, steps, domains, averaged)


_sequential(EPIE, (0.0, 1.0, 0.0, 1.0), 1)
_sequential(EPIEParallel, (0.0, 1.0, 0.0, 1.0), 4)
_sequential(SDR, (0.9, 0.0, 0.1, 0.0), 3)
# Steps short enough that sums in another order stay within the digits that are compared.
_sequential(WASP, (0.5, 0.0, 0.5, 0.0), 6, averaged=True, alpha=0.5, beta=0.5)


# ---- positions on a shared object ------------------------------------------------

#: An object that tells its places apart.
TEXTURE = (1 + 0.05 * ((3 * _Y + 5 * _X) % 7) + 0.02j * (_Y - _X)).astype(complex).reshape(1, FIELD, FIELD)


def _posref(name: str, metric: str, error: str) -> None:
    """The best of five places of every frame, within the object."""
    own = _times("pr,pi_", "(1 + 0.05 * ((3 * y + 5 * x) % 7)),(0.02 * (y - x))")
    ORACLE[name] = f"""WITH {_FRAMES},
s(n, dr, dc) AS (VALUES {_CANDIDATES}),
pl AS (SELECT vec_id, n, (vec_id * 3 % 9)::INT AS r0, (vec_id * 5 % 9)::INT AS c0, dr, dc FROM (SELECT DISTINCT vec_id FROM w) CROSS JOIN s),
po AS (SELECT vec_id, n, k, {own[0]} AS re, {own[1]} AS im FROM (SELECT *, r0 + dr + r AS y, c0 + dc + c AS x FROM w JOIN pl USING (vec_id) WHERE r0 + dr BETWEEN 0 AND 8 AND c0 + dc BETWEEN 0 AND 8)),
f AS {_fw("po", "vec_id, n")},
t AS (SELECT vec_id, n, {error} AS err FROM (SELECT *, re * re + im * im AS a0 FROM f) JOIN w USING (vec_id, k) GROUP BY vec_id, n),
b AS (SELECT vec_id, arg_min(n, err) AS n, min(err) AS err, max(err) FILTER (n = 0) AS old FROM t GROUP BY vec_id)
SELECT vec_id AS frame_idx, r0, c0, r0 + dr::INT AS new_r0, c0 + dc::INT AS new_c0, round(err, 6) AS error, round(old, 6) AS old_error FROM b JOIN pl USING (vec_id, n)"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        how = PositionRefinement(method="GridSearch", max_shift=1, metric=metric)
        return rounded(refine(scan_of_embeddings(spark, sf_dir), State(PROBE.copy(), TEXTURE.copy()), how), 6, "error", "old_error")

    QUERIES[name] = run


_posref("posref_gridsearch", "fourier", "sum(m * (sqrt(a0) - sqrt(i)) * (sqrt(a0) - sqrt(i))) / sum(m)")
_posref("posref_photon", "photon", "sum(m * (a0 - i) * (a0 - i) / (i + 1)) / 64")


# ---- maps ---------------------------------------------------------------------------


@query(f"""WITH {_FRAMES},
q AS (SELECT vec_id, sum(i) AS total, (sum(r * i) / sum(i) - 4) * 2 * pi() AS dr, (sum(c * i) / sum(i) - 4) * 2 * pi() AS dc FROM w GROUP BY vec_id),
p AS (SELECT {_PLACED}, sqrt(pr * pr + pi_ * pi_) AS l, total, dr, dc FROM w JOIN q USING (vec_id)),
m AS (SELECT y, x, sum(l * sqrt(total)) / (sum(l) + 1e-10) / (SELECT sqrt(max(total)) FROM q) AS trans, sum(l * dr) / (sum(l) + 1e-10) AS dpc_row, sum(l * dc) / (sum(l) + 1e-10) AS dpc_col FROM p GROUP BY y, x)
SELECT y, x, round(coalesce(trans, 0), 5) + 0.0 AS trans, round(coalesce(dpc_row, 0), 5) + 0.0 AS dpc_row, round(coalesce(dpc_col, 0), 5) + 0.0 AS dpc_col
FROM (SELECT (k // 16)::INT AS y, (k % 16)::INT AS x FROM (SELECT unnest(range(256)) AS k)) LEFT JOIN m USING (y, x)""")
def stxm_maps(spark, sf_dir):
    """Transmission and both phase gradients of the scan, weighted by the probe's modulus."""
    maps = np.stack(stxm_analysis(scan_of_embeddings(spark, sf_dir), PROBE[0], (FIELD, FIELD)))
    rows = [(int(y), int(x), *maps[:, y, x].tolist()) for y, x in np.ndindex(FIELD, FIELD)]
    return rounded(spark.createDataFrame(rows, "y int, x int, trans double, dpc_row double, dpc_col double"), 5, "trans", "dpc_row", "dpc_col")
