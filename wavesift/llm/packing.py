"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows. How pieces then share
sequences depends on their lengths alone, so the exact best-fit-decreasing plan
is made from the histogram of lengths (at most ``window`` rows on the driver),
with a segment tree over remaining capacity that finds the tightest open
sequences. The plan is a list of rank ranges, bounded by the window and not by
the corpus; a piece finds its sequence by its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm._common import materialise, small_batches, table, text_or_empty
from wavesift.llm.unit_encoder import unit_encoder

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)
_IDS = T.StructField("ids", T.BinaryType())


class CapacityTree:
    """Segment tree over remaining capacities: how many open groups each range holds."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.counts[i] += n
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= ``need`` that is open."""
        i = need + self.size
        if self.counts[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.counts[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Range:
    """Pieces of ``length`` with rank in [lo, hi) go ``per`` to a sequence, from ``first`` on, at ``offset``."""

    length: int
    lo: int
    hi: int
    first: int
    per: int
    offset: int


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[Range]:
    """Best-fit decreasing over (length -> count), all pieces of a length at once.

    After a piece of length l goes to the tightest sequence of capacity r, that
    sequence has r - l left; if that still holds l it is now the tightest of
    all, so a sequence takes r // l pieces in a row. Open sequences of equal
    capacity are kept as ranges of consecutive ids.
    """
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}
    out: list[Range] = []
    made = 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, per = window, window // length
                first, n = made, -(-left // per)
                made += n
            else:
                first, n = open_[r].pop()
                if not open_[r]:
                    del open_[r]
                tree.add(r, -1)
                per = r // length
            full = min(n, left // per)
            if full:
                out.append(Range(length, rank, rank + full * per, first, per, window - r))
                put(r - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left:  # fewer than `per` are left
                out.append(Range(length, rank, rank + left, first, per, window - r))
                put(r - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(r, first, n)
    return out


def cut_documents(encode: Callable[[list[str]], list[np.ndarray]], window: int, with_ids: bool):
    """For mapInPandas: (doc_id, text) to pieces; ``nth`` counts a length's pieces within the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for pdf in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(pdf["doc_id"], encode(pdf["text"].tolist()), strict=True):
                raw, total = ids.astype("<u4").tobytes(), len(ids)
                for start in range(0, total, window):
                    own = raw[4 * start : 4 * (start + window)]
                    length = len(own) // 4
                    rows.append((doc_id, start, length, zlib.crc32(own), total, task, seen[length], *([own] if with_ids else [])))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=PIECES.names + ["ids"] * with_ids).astype({"doc_id": "Int64"})

    return run


def encode_with_end(name: str, end_id: int):
    """Ids of each text as the tokenizers library gives them, then ``end_id``."""

    def run(texts: list[str]) -> list[np.ndarray]:
        encoder = unit_encoder(public_tokenizers.path(name))
        end = np.array([end_id], "<u4").tobytes()
        return [np.frombuffer(encoder.encode(t) + end, "<u4") for t in texts]

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``window`` tokens.

    Null and empty texts are one piece that holds only ``end_id``. Repeated rows
    are packed each for itself. An empty table gives no rows. Other columns are
    ignored. ``with_ids`` adds the ids of each piece as bytes (``ids``).
    ``sequences`` gives the length that each sequence is padded to.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    schema = T.StructType([*PIECES.fields, *([_IDS] if with_ids else [])])
    own = small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # Written once: ranks within a task must not change if a task runs again.
    pieces = materialise(own.mapInPandas(cut_documents(encode_with_end(tokenizer, end_id), window, with_ids), schema))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    ranges = plan(histogram, window)
    # A row for each task and length; a length has one row for each task at most.
    before = counts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY task) - n")).select("length", "task", "before")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    placed = T.StructType([*(f for f in schema.fields if f.name in columns and f.name != "ids"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *([_IDS] if with_ids else [])])
    return (
        pieces.join(before, ["length", "task"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .mapInPandas(place(plan(histogram, window), columns), placed)
    )


def place(ranges: list[Range], columns: list[str]):
    """For mapInPandas: the sequence and offset of pieces with (length, rank)."""
    starts: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {r.length for r in ranges}:
        own = [r for r in ranges if r.length == length]  # in order of rank
        starts[length] = tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("lo", "first", "per", "offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for length in np.unique(lengths):
                lo, first, per, at = starts[int(length)]
                rows = np.flatnonzero(lengths == length)
                k = np.searchsorted(lo, ranks[rows], side="right") - 1
                nth = ranks[rows] - lo[k]
                sequence[rows] = first[k] + nth // per[k]
                offset[rows] = at[k] + nth % per[k] * length
            yield pdf.assign(sequence_id=sequence, offset=offset)[columns]

    return run


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, tokens and padded_length: own length at a power of two, else ``window``."""
    power = (F.col("tokens").bitwiseAND(F.col("tokens") - 1)) == 0
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens")).withColumn(
        "padded_length", F.when(power, F.col("tokens")).otherwise(F.lit(window)).cast("long")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
