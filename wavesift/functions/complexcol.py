"""Complex numbers as struct<re: double, im: double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re, im=0.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    return F.struct(as_col(re).cast("double").alias("re"), as_col(im).cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return cplx(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def div(a: Column, b: Column) -> Column:
    n = abs2(b)
    c = mul(a, conj(b))
    return cplx(c["re"] / n, c["im"] / n)


def abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def cabs2(a: Column) -> Column:
    """abs2 as a complex number."""
    return cplx(abs2(a), 0.0)


def modulus(a: Column) -> Column:
    return F.sqrt(abs2(a))


def arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def polar(r: Column, phi: Column) -> Column:
    return cplx(r * F.cos(phi), r * F.sin(phi))


def clip_modulus(a: Column, low: float, high: float) -> Column:
    """Modulus kept within [low, high], phase kept; zero goes to ``low`` along the real axis."""
    m, phi = modulus(a), arg(a)
    return F.when(m > high, polar(F.lit(float(high)), phi)).when(m < low, polar(F.lit(float(low)), phi)).otherwise(a)


def hsv(a: Column, vmin: float = 0.0, vmax: float = 1.0) -> Column:
    """Hue from the phase, value from the modulus clipped to [vmin, vmax]."""
    v = (F.least(F.greatest(modulus(a), F.lit(float(vmin))), F.lit(float(vmax))) - vmin) / (vmax - vmin)
    import math

    return F.struct((0.5 * arg(a) / F.lit(math.pi) + 0.5).alias("h"), F.lit(1.0).alias("s"), v.alias("v"))


def rgb_to_hsv(c: Column, eps: float = 1e-6) -> Column:
    """RGB struct to HSV struct; hue 0 where it is grey, saturation 0 where it is black. Of equal largest parts red comes first."""
    r, g, b = (c[k].cast("double") for k in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low + eps
    part = {k: (top - x) / span for k, x in (("r", r), ("g", g), ("b", b))}
    sixth = F.when(top == low, 0.0).when(r == top, part["b"] - part["g"]).when(g == top, 2.0 + part["r"] - part["b"]).otherwise(4.0 + part["g"] - part["r"])
    return F.struct(F.pmod(sixth / 6.0, F.lit(1.0)).alias("h"), F.when(top <= eps, 0.0).otherwise((top - low) / (top + eps)).alias("s"), top.alias("v"))


def rgb(h: Column) -> Column:
    """HSV struct (each 0..1) to RGB struct (0..255, rounded down)."""
    i = F.floor(h["h"] * 6.0)
    f = h["h"] * 6.0 - i
    v, s = h["v"], h["s"]
    p, q, t = v * (1.0 - s), v * (1.0 - f * s), v * (1.0 - (1.0 - f) * s)
    table = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    k = F.pmod(i, F.lit(6))

    def pick(n: int) -> Column:
        out = table[5][n]
        for j in range(5):
            out = F.when(k == j, table[j][n]).otherwise(out)
        return F.floor(out * 255.0).cast("int")

    return F.struct(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
