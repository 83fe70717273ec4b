"""Quality classifier by compression.

Zstandard dictionaries are built from good and from bad labelled text. A text
is compressed in blocks with either; the difference of the compressed sizes,
divided by the text's size, says which of the two it resembles. A logistic
calibration, fitted on labelled texts that no dictionary has seen, turns the
difference (and the mean compressed size, for text that either dictionary
compresses to nothing) into the probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import small_batches, table, text_or_empty

#: Bounds of the training sample: rows of each label, and characters of a text that may be in it.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 112_640
#: Bytes that are compressed at a time, so that long texts lean on the dictionary as short ones do.
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstd.ZstdCompressor, ...]:
    out = []
    for raw in (good, bad):
        d = zstd.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(out)


def features(text: str, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """(normalised difference, normalised mean size, 1 / size) of the whole text."""
    raw = text.encode()
    if not raw:
        return 0.0, 0.0, 1.0
    view = memoryview(raw)
    sizes = [sum(len(c.compress(view[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in _compressors(good, bad)]
    n = len(raw)
    return (sizes[1] - sizes[0]) / n, (sizes[0] + sizes[1]) / (2 * n), 1 / n


def design(x: np.ndarray) -> np.ndarray:
    """Terms of the calibration from rows of features."""
    d, m, s = x[:, 0], np.minimum(x[:, 1], 1.5), np.minimum(x[:, 2], 0.05)
    return np.stack([np.ones_like(d), 10 * d, 4 * m, 4 * m * m, 20 * s, 100 * d * s], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge penalty on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    blocks = [raw[i : i + BLOCK] for raw in (t.encode() for t in texts) for i in range(0, len(raw), BLOCK)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except (zstd.ZstdError, MemoryError):
        return b"".join(blocks)[:DICTIONARY_BYTES]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from three fifths of the rows, calibration from the rest.

    Without both labels the score is constant: the share of label 1, or a half
    without any label.
    """
    by = {q: [t for t, own in rows if own == q] for q in (0, 1)}
    if min(len(by[0]), len(by[1])) < 5:
        share = (len(by[1]) + 1) / (len(rows) + 2)
        return Model(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0))
    cut = {q: -(-3 * len(by[q]) // 5) for q in by}
    good, bad = (_dictionary(by[q][: cut[q]]) for q in (1, 0))
    rest = [(t, q) for q in (0, 1) for t in by[q][cut[q] :]]
    x = design(np.array([features(t, good, bad) for t, _ in rest]))
    return Model(good, bad, tuple(fit_logistic(x, np.array([q for _, q in rest], float)).tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` texts of each label that are not held out, chosen by a hash of the id.

    Labels that are null or contradict one another are not used. Of several texts of
    one id the least is taken.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    )
    sample = known.filter("quality = 0").orderBy("h", "doc_id").limit(rows).unionByName(known.filter("quality = 1").orderBy("h", "doc_id").limit(rows))
    ids = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)  # at most 2 * rows
    texts = docs.select("doc_id", text_or_empty().alias("text")).filter(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
    found = sorted(texts.groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")).select("h", "doc_id", "text", "quality").collect())
    return [(r["text"], r["quality"]) for r in found]


def _scores(texts: pd.Series, model: Model) -> np.ndarray:
    if model.good:
        x = design(np.array([features(t, model.good, model.bad) for t in texts]).reshape(-1, 3))
    else:
        x = np.eye(1, len(model.weights)).repeat(len(texts), axis=0)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, in 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_scores(texts, model))

    return score(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score of every document; null texts count as empty and have a score, too.

    Repeated rows each give a row, an empty table gives none; other columns are
    never looked at.

    Columns: doc_id, held_out, score, predicted.
    """
    return small_batches(docs).select("doc_id", held_out().alias("held_out"), score_column(model, text_or_empty()).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def drop_bad(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below the threshold; all columns stay."""
    return small_batches(docs).filter(score_column(model, text_or_empty()) >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
