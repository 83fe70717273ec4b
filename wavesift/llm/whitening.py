"""Whitening of embeddings by a tall and skinny QR (TSQR).

Entries become whole numbers, so sums are exact and rows are centred without
error. Each partition of the distinct vectors is reduced to a triangle by QR, block
after block; triangles are merged up a tree of fan-in FAN, and the SVD of the last
one has the components as right vectors. No covariance of the vectors is ever
formed; the one that measures ``identity_error`` is of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import materialise, small_batches, table

SCALE = 256
COMPONENTS = 4
#: Triangles that one task merges.
FAN = 8
#: Rows that QR takes at a time, as a multiple of the dimension.
BLOCK = 16
#: Whole numbers up to this size are exact in doubles and far from the ends of a long.
SAFE = 2**53
#: Widths of the packed entries in bytes.
WIDTHS = (1, 2, 4, 8)


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of finite entries as longs; beyond the ends of a long, the end."""
    x = np.floor(scale * vectors.astype(np.float64))
    out = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    return np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x < -(2.0**63), np.iinfo(np.int64).min, out))


def usable(vector, length: int) -> bool:
    """Whether a vector is there, has ``length`` entries, and all are finite numbers."""
    return vector is not None and len(vector) == length and bool(np.isfinite(np.asarray(vector, np.float64)).all())


def pack(row: np.ndarray) -> bytes:
    """Equal vectors have equal bytes: entries in the least width that holds them all."""
    width = next(w for w in WIDTHS if w == 8 or (-(1 << (8 * w - 1)) <= row.min() and row.max() < 1 << (8 * w - 1)))
    return row.astype(f"<i{width}").tobytes()


def unpack(packed: pd.Series, d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, f"<i{len(b) // d}")
    return out


def squared(n: int, x: np.ndarray, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x-S)^2 of each row, exact; null where a long cannot hold it."""
    d = len(sums)
    # Python's whole numbers where longs might overflow
    top = max(n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0), 1)
    if top * top * d < 2**63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    rows = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in rows]


def centred(n: int, x: np.ndarray, sums: list[int]) -> np.ndarray:
    """x - S/n, each entry rounded once where n*x-S is exact in a double."""
    top = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if top < SAFE:
        return (n * x - np.array(sums, np.int64)) / n
    whole_part = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if int(np.abs(x.astype(np.float64)).max(initial=0)) < SAFE:
        return (x - whole_part) - rest
    return x.astype(np.float64) - whole_part.astype(np.float64) - rest


def triangle(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of all rows of ``blocks``; a triangle and BLOCK * d rows are in memory at a time."""
    r = np.zeros((0, d))
    for rows in blocks:
        for at in range(0, len(rows), BLOCK * d):
            r = np.linalg.qr(np.concatenate([r, rows[at : at + BLOCK * d]]), mode="r")
    return r


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have, the larger of several."""
    sizes = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """(x): each distinct vector of whole numbers once, packed; written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [v for v in pdf["embedding"] if usable(v, d)]
            yield pd.DataFrame({"x": list({pack(row) for row in whole(np.stack(good))}) if good else []})

    return materialise(small_batches(vectors).select("embedding").mapInPandas(run, "x binary").distinct())


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their sum in each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, [0] * d
        for pdf in batches:
            x = unpack(pdf["x"], d)
            n += len(x)
            # halves of 32 bits cannot overflow in a batch
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
        yield pd.DataFrame({"dim": range(-1, d), "s": [str(s) for s in (n, *sums)]})

    rows = fit.mapInPandas(run, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["dim"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def tsqr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list. The driver gets no more than FAN triangles."""
    d = len(sums)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = triangle((centred(n, unpack(pdf["x"], d), sums) for pdf in batches), d)
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = triangle((np.frombuffer(b).reshape(-1, d) for pdf in batches for b in pdf["r"]), d)
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    triangles = materialise(fit.mapInPandas(first, "r binary"))
    while (count := triangles.count()) > FAN:
        triangles = materialise(triangles.repartition(-(-count // FAN)).mapInPandas(merge, "r binary"))
    return triangle((np.frombuffer(row["r"]).reshape(-1, d) for row in triangles.collect()), d)


def right_vectors(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, their eigenvalues, trace) from the SVD of R; the largest entry of each is positive."""
    d = r.shape[1]
    _, s, v = np.linalg.svd(np.concatenate([r, np.zeros((max(0, d - len(r)), d))]))
    e = s**2 / n
    e[s <= s[:1].max(initial=0) * d * np.finfo(float).eps] = 0
    v = v[:k]
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None], e[:k], float(e.sum())


def whitened(n: int, x: np.ndarray, sums: list[int], components: np.ndarray, e: np.ndarray) -> np.ndarray:
    return centred(n, x, sums) @ components.T / np.sqrt(e)


def identity_error(fit: DataFrame, n: int, sums: list[int], components: np.ndarray, e: np.ndarray) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|.

    Each task gives mean and centred products of its rows; these are merged two by two.
    """
    d, k = len(sums), len(e)

    def joined(a, b):
        (na, ma, pa), (nb, mb, pb) = a, b
        total, gap = na + nb, mb - ma
        return total, ma + gap * (nb / total), pa + pb + np.outer(gap, gap) * (na * nb / total)

    def partial(batches: Iterator[pd.DataFrame], read) -> Iterator[pd.DataFrame]:
        own = None
        for part in (p for pdf in batches for p in read(pdf)):
            own = part if own is None else joined(own, part)
        if own:
            yield pd.DataFrame({"n": [own[0]], "m": [own[1].tobytes()], "p": [own[2].tobytes()]})

    def of_rows(pdf: pd.DataFrame):
        if len(pdf):
            y = whitened(n, unpack(pdf["x"], d), sums, components, e)
            off = y - y.mean(axis=0)
            yield len(y), y.mean(axis=0), off.T @ off

    def of_parts(pdf: pd.DataFrame):
        for c, m, p in zip(pdf["n"], pdf["m"], pdf["p"], strict=True):
            yield c, np.frombuffer(m), np.frombuffer(p).reshape(k, k)

    schema = "n long, m binary, p binary"
    parts = materialise(fit.mapInPandas(lambda b: partial(b, of_rows), schema))
    while (count := parts.count()) > FAN:
        parts = materialise(parts.repartition(-(-count // FAN)).mapInPandas(lambda b: partial(b, of_parts), schema))
    own = None
    for part in of_parts(parts.toPandas()):
        own = part if own is None else joined(own, part)
    return float(np.abs(own[2] / n - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Rows of ``embeddings`` (vec_id, embedding) projected on their first ``k`` components and scaled to unit variance.

    Rows go whose vector is null or holds null or non-finite entries, or has
    another length than most (of two lengths as frequent, the larger counts).
    Repeated rows and vectors each give their rows; the fit has each distinct
    vector once. Vectors of fewer than ``k`` entries have as many components as
    entries; without rows or entries the result is empty. A component without
    variance (all vectors equal, or of less rank) keeps its rows, with whitened
    null and explained 0 (null where nothing varies); identity_error is of the
    components with variance, null where there is none. A deviation beyond a long
    is null. Null vec_ids stay; other columns are ignored.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    vectors = small_batches(embeddings).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = common_length(vectors)
    fit = fit_list(vectors, d) if d else None
    n, sums = exact_sums(fit, d) if d else (0, [])
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    components, e, trace = right_vectors(tsqr(fit, n, sums), n, min(k, d))
    live = int((e > 0).sum())
    error = identity_error(fit, n, sums, components[:live], e[:live]) if live else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf[[usable(v, d) for v in pdf["embedding"]]]
            if own.empty:
                continue
            x = whole(np.stack(list(own["embedding"])))
            y = np.full((len(x), len(e)), None, object)
            y[:, :live] = whitened(n, x, sums, components[:live], e[:live])
            rows = np.repeat(np.arange(len(x)), len(e))
            yield pd.DataFrame(
                {
                    "vec_id": own["vec_id"].astype("Int64").to_numpy()[rows],
                    "component": np.tile(np.arange(1, len(e) + 1, dtype=np.int32), len(x)),
                    "n": n,
                    "deviation": pd.array(squared(n, x, sums), "Int64")[rows],
                    "whitened": y.ravel(),
                    "explained": np.tile(e / trace, len(x)) if trace else None,
                    "identity_error": error,
                }
            )

    return vectors.mapInPandas(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
