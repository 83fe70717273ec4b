"""Secret scan: exact base patterns, and a character CNN over every candidate.

Candidates are what the base patterns find, all other key-like runs of a text
(with or without digits, and the rest of runs that a base span only touches),
passwords of addresses and values under telling names. A convolutional network in numpy reads each with its
surroundings (in windows, where it is long) and is trained on labelled findings.
Its scores are calibrated on findings it has not seen, and for each kind of
candidate the threshold is the largest that still finds the wanted share of their
secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import small_batches, table, text_or_empty
from wavesift.llm.secret_findings import findings

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
#: The password of an address: scheme://user:password@
ADDRESS = re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{6,128})@")
#: A value under a name that tells of a secret.
NAMED = re.compile(r"""(?ai:key|auth|pwd|pass|cred|secret|token|bearer)[A-Za-z_]{0,16}["']?[\x20\t]{0,4}[:=][\x20\t]{0,4}["']?([A-Za-z0-9+/_.=-]{8,})""")
KINDS = ("assign", "access", "hex", "model")
#: Passwords of addresses and values under a name have thresholds of their own; they are given as ``model``, as runs are.
ADDRESSES, VALUES = len(KINDS), len(KINDS) + 1
#: Least lengths: of an assignment's value, and of the other two kinds.
LEAST = {"assign": 6, "access": 20, "hex": 24}

CONTEXT = 32
INSIDE = 64
FILTERS, WIDTH, EMBED = 32, 5, 10
FINDINGS, EPOCHS, SEED = 8000, 8, 7
RECALL = 0.99
#: Key-like runs have this many characters at least, and this many different ones.
RUN_LENGTH, VARIETY = 16, 6

#: Classes of characters that the network tells apart: each ASCII letter and sign, all else as one; 0 is padding.
_CODES = np.full(0x110000 + 1, 96, np.uint8)
_CODES[32:127] = np.arange(1, 96)
_CODES[[9, 10, 13]] = 1


@dataclass(frozen=True)
class Network:
    """Weights, the calibration (scale, shift) and the threshold of each of KINDS, of ADDRESSES and of VALUES."""

    weights: tuple[np.ndarray, ...]
    scale: float
    shift: float
    thresholds: tuple[float, ...]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return _squash(self.scale * logits(codes, self.weights) + self.shift)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def encode(before: str, candidate: str, after: str) -> np.ndarray:
    """Codes of one window: CONTEXT characters, INSIDE of the candidate, CONTEXT characters."""
    out = np.zeros(2 * CONTEXT + INSIDE, np.uint8)
    for at, s in ((CONTEXT - len(before), before), (CONTEXT, candidate), (CONTEXT + INSIDE, after)):
        out[at : at + len(s)] = _CODES[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")]
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """One window for each INSIDE characters of the candidate, the rest of it being context."""
    return [
        encode(text[max(0, a - CONTEXT) : a], text[a : min(a + INSIDE, end)], text[min(a + INSIDE, end) : min(a + INSIDE, end) + CONTEXT])
        for a in range(start, end, INSIDE)
    ]


_ZONE = np.r_[np.zeros(CONTEXT), np.ones(INSIDE), np.full(CONTEXT, 2)].astype(np.int64)


def _forward(codes: np.ndarray, w: tuple[np.ndarray, ...]):
    embed, kernel, bias, dense, out, shift = w
    x = embed[codes.astype(np.int64)] + 0.0
    n, length, _ = x.shape
    cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, -1)
    conv = np.maximum(cols @ kernel + bias, 0)
    mids = _ZONE[WIDTH // 2 : length - WIDTH // 2]
    pools, args = [], []
    for zone in range(3):
        at = np.flatnonzero(mids == zone)
        k = conv[:, at].argmax(axis=1)
        args.append(at[k])
        pools.append(np.take_along_axis(conv[:, at], k[:, None], 1)[:, 0])
    inside = np.flatnonzero(mids == 1)
    filled = (codes[:, CONTEXT : CONTEXT + INSIDE] > 0)[:, : len(inside), None].astype(np.float32)
    size = np.maximum(filled.sum(axis=1), 1)
    pools.append((conv[:, inside] * filled).sum(axis=1) / size)
    pooled = np.concatenate(pools, axis=1)
    hidden = np.maximum(pooled @ dense, 0)
    return cols, conv, args, filled, size, inside, pooled, hidden, hidden @ out + shift


_ONE_HOT = np.eye(97, dtype=np.float32)


def logits(codes: np.ndarray, w: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.concatenate([_forward(codes[i : i + 256], w)[-1] for i in range(0, len(codes), 256)] or [np.empty(0)])


def train(codes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Adam over the logistic loss, with all gradients written out."""
    rng = np.random.default_rng(seed)
    shapes = ((97, EMBED), (WIDTH * EMBED, FILTERS), (FILTERS,), (4 * FILTERS, 16), (16,), ())
    scales = (0.5, 0.15, 0.0, 0.1, 0.3, 0.0)
    w = [np.array(rng.normal(0, s, shape) if s else np.zeros(shape), np.float32) for shape, s in zip(shapes, scales, strict=True)]
    y = y.astype(np.float32)
    w[0][0] = 0
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        rate = np.float32(0.004 if epoch < epochs - 2 else 0.001)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            own = codes[rows].astype(np.int64)
            cols, conv, args, filled, size, inside, pooled, hidden, z = _forward(own, tuple(w))
            n = len(rows)
            dz = (1 / (1 + np.exp(-z)) - y[rows]) / n
            dh = np.outer(dz, w[4]) * (hidden > 0)
            dp = dh @ w[3].T
            dc = np.zeros_like(conv)
            for zone in range(3):
                np.put_along_axis(dc, args[zone][:, None], dp[:, None, zone * FILTERS : (zone + 1) * FILTERS], 1)
            dc[:, inside] += filled * (dp[:, 3 * FILTERS :] / size)[:, None]
            dc *= conv > 0
            dx = (dc @ w[1].T).reshape(n, conv.shape[1], WIDTH, EMBED)
            places = np.zeros((n, codes.shape[1], EMBED), np.float32)  # gradient of each character's place
            for k in range(WIDTH):
                places[:, k : k + conv.shape[1]] += dx[:, :, k]
            de = _ONE_HOT[own.ravel()].T @ places.reshape(-1, EMBED)
            de[0] = 0
            flat = cols.reshape(-1, WIDTH * EMBED)
            grads = (de, flat.T @ dc.reshape(-1, FILTERS), dc.sum(axis=(0, 1)), pooled.T @ dh, hidden.T @ dz, dz.sum())
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        p = _squash(a * z + b)
        g, h = np.array([((p - target) * z).sum(), (p - target).sum()]), p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]]), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def threshold(scores: np.ndarray, recall: float) -> float:
    """The largest threshold that keeps ``recall`` of the secrets with these scores."""
    return float(np.sort(scores)[int((1 - recall) * len(scores))]) if len(scores) else 0.5


def kind_of(before: str, candidate: str, after: str) -> int:
    """The kind of candidate under which the scan meets a finding; -1 if it meets none."""
    text = before + candidate + after
    at, end = len(before), len(before) + len(candidate)
    runs = [m.span() for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    return next((k for a, b, k in base + candidates(text, runs, base) if a < end and at < b), -1)


@lru_cache(maxsize=1)
def network(n: int = FINDINGS, recall: float = RECALL) -> Network:
    """The network, trained on ``n`` labelled findings; a quarter of them calibrates it."""
    rows = findings(n, SEED)
    codes = np.stack([encode(b[-CONTEXT:], c[:INSIDE], (c[INSIDE:] + a)[:CONTEXT]) for b, c, a, _ in rows])
    y = np.array([r[3] for r in rows], float)
    cut = n * 3 // 4
    w = train(codes[:cut], y[:cut])
    z = logits(codes[cut:], w)
    scale, shift = calibrate(z, y[cut:])
    scores, kinds = _squash(scale * z + shift), np.array([kind_of(b, c, a) for b, c, a, _ in rows[cut:]])
    return Network(w, scale, shift, tuple(threshold(scores[(kinds == k) & (y[cut:] > 0)], recall) for k in range(VALUES + 1)))


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns; ``runs`` are those of RUN, which hold all of the last two kinds."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in runs:
        if b - a >= LEAST["access"]:
            for kind, pattern in ((1, ACCESS), (2, HEX)):
                out += [(*m.span(), kind) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, threshold's kind) of what else may be a secret, in order: passwords of addresses, and key-like runs without the base spans in them.

    All lists are in order, so they are swept once.
    """
    covers: list[tuple[int, int]] = []
    for a, b, _ in base:
        if covers and a <= covers[-1][1]:
            covers[-1] = (covers[-1][0], max(covers[-1][1], b))
        else:
            covers.append((a, b))

    def uncovered(spans: list[tuple[int, int]], taken: list[tuple[int, int]], cut: bool) -> list[tuple[int, int]]:
        out, k = [], 0
        for a, b in spans:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            i = k
            if not cut:
                if i == len(taken) or taken[i][0] >= b:
                    out.append((a, b))
                continue
            while i < len(taken) and taken[i][0] < b:
                out.append((a, taken[i][0]))
                a, i = max(a, taken[i][1]), i + 1
            out.append((a, b))
        return out

    passwords = uncovered([m.span(1) for m in ADDRESS.finditer(text)], covers, False) if "://" in text else []
    taken = sorted(covers + passwords)
    values = uncovered([m.span(1) for m in NAMED.finditer(text)], taken, False) if "=" in text or ":" in text else []
    out = [(a, b, ADDRESSES) for a, b in passwords] + [(a, b, VALUES) for a, b in values]
    for a, b in uncovered(runs, sorted(taken + values), True):
        while b > a and text[b - 1] in ".-":
            b -= 1
        if b - a >= RUN_LENGTH and len(set(text[a:b])) >= VARIETY:
            out.append((a, b, 3))
    return sorted(out)


def scored_texts(texts: list[str], net: Network) -> list[tuple[list[tuple[int, int, int]], int]]:
    """All spans (start, end, kind) of each text in order, and how many base spans the network confirms.

    The network reads every candidate, base spans (of assignments the value) as
    well as others: base spans stay whatever it says, others only if it agrees.
    """
    found, codes, owners = [], [], []
    for i, text in enumerate(texts):
        runs = [m.span() for m in RUN.finditer(text)]
        base = base_spans(text, runs)
        found.append(base)
        for a, b, kind in base:
            own = windows(text, ASSIGN.match(text, a).start(2) if kind == 0 else a, b)
            codes += own
            owners += [(i, (a, b), kind)] * len(own)
        for a, b, kind in candidates(text, runs, base):
            own = windows(text, a, b)
            codes += own
            owners += [(i, (a, b), kind)] * len(own)
    confirmed, added = [0] * len(texts), [[] for _ in texts]
    if codes:
        scores = net.scores(np.stack(codes))
        for i, (a, b), kind in dict.fromkeys(o for o, s in zip(owners, scores, strict=True) if s >= net.thresholds[o[2]]):
            if kind < 3:
                confirmed[i] += 1
            else:
                added[i].append((a, b, 3))
    return [(sorted(s + more, key=lambda x: (x[0], x[2])), n) for s, more, n in zip(found, added, confirmed, strict=True)]


def scan_texts(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, end, kind) of each text, in order."""
    return [spans for spans, _ in scored_texts(texts, net)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every span replaced; spans that overlap are replaced as one."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i][:2]
        while i < len(spans) and spans[i][0] <= end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, n_confirmed long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Secrets of every whole text, in code points, ends exclusive.

    Null counts as empty and has no spans. Repeated rows each give a row, an
    empty table none; other columns are ignored. Base spans of different kinds
    may overlap; the network adds spans only where there is no base span. Spans that
    start at one place come in the order of KINDS. Very long texts and runs are read
    whole, in windows.

    Columns: doc_id, n_assign, n_access, n_hex, n_model, n_confirmed (base spans
    that the network confirms), base_sha256, spans.
    """
    net = net or network()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, (spans, confirmed) in zip(pdf["doc_id"], scored_texts(pdf["text"].tolist(), net), strict=True):
                kinds = [k for _, _, k in spans]
                base = joined([s for s in spans if s[2] < 3])
                rows.append((doc_id, *(kinds.count(k) for k in range(4)), confirmed, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, RESULT)


def redacted_column(text: Column, net: Network | None = None) -> Column:
    """Each text with its secrets replaced."""
    net = net or network()

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.tolist()
            yield pd.Series([redact(t, s) for t, s in zip(own, scan_texts(own, net), strict=True)], dtype=object)

    return redacted(text)


def redact_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with secrets replaced; all rows and columns stay. Where ``n_chars`` exists it follows the text."""
    out = small_batches(docs).withColumn("text", redacted_column(text_or_empty(), net))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
