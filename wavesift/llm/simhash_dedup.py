"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their
8 positional bytes. The index lists every distinct fingerprint under sets of
(position, byte): a family of position sets of size 4 such that any 5 positions
hold one of them whole, so every linked pair meets under some key (keys of single
bytes would list a 256th of all fingerprints each). Within a key the shared
positional bytes of every pair are tallied, pairs with at least 5 go on, and the
bits are compared. Only a spanning forest of the links of a key leaves its task,
never all pairs; keys of many fingerprints are cut into blocks that meet two by
two in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import join_counted, join_split, materialise, row_key, rows_of_keys, small_batches, table, text_or_empty

SHINGLE = 3
BITS = 3
SEED = 42
BYTES = 8
#: Tasks that the edges of one node of the component graph are dealt to.
SALTS = 16
#: Fingerprints of one key that a task compares with one another at most, twice this for two blocks.
BLOCK = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    ws = text.encode().lower().split()  # bytes: A-Z only, and space and \\t to \\r only
    if not ws:
        return 0
    if len(ws) < shingle:
        shingle = len(ws)
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8, 8 * min(4096, n - at), 8 * at).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *others: str) -> DataFrame:
    """(doc_id, fp, others): fp as a signed long; other columns are longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp, **{c: pdf[c] for c in others}})

    own = small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *others)
    return own.mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *others)))


def position_sets(shared: int, size: int, positions: int = BYTES) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions such that any ``shared`` positions hold one whole, chosen greedily."""
    open_, sets = set(combinations(range(positions), shared)), list(combinations(range(positions), size))
    out = []
    while open_:
        best = max(sets, key=lambda s: sum(set(s) <= set(o) for o in open_))
        out.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return out


def index_keys(fp: Column, bits: int) -> Column:
    """The keys under which a fingerprint is listed: set number and bytes in one long."""
    keys = []
    for n, positions in enumerate(position_sets(BYTES - bits, BYTES - bits - 1)):
        key = F.lit(n).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    return F.array(*keys)


def tally(differences: np.ndarray) -> np.ndarray:
    """Positional bytes that the fingerprints of each pair share."""
    return (differences.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def forest(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``fps``, breadth first; each fingerprint is expanded once."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            own = queue.pop()
            other = own ^ left
            near = tally(other) >= BYTES - bits
            near[near] = np.bitwise_count(other[near]) <= bits
            if near.any():
                for x in left[near]:
                    yield own, x
                queue += list(left[near])
                left = left[~near]


def _links(bits: int):
    """For mapInPandas over rows sorted by (key, a, b): the forest of each group."""

    def of(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.array([], np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        x, y = fps[two], fps[two + 1]
        near = tally(x ^ y) >= BYTES - bits
        near[near] = np.bitwise_count((x ^ y)[near]) <= bits
        out = [(x[near], y[near])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            pairs = list(forest(np.unique(fps[s : s + n]), bits))
            if pairs:
                out.append(tuple(np.array(p, np.uint64) for p in zip(*pairs, strict=True)))
        a, b = (np.concatenate(c).view(np.int64) for c in zip(*out, strict=True))
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for pdf in batches:
            keys = np.concatenate([keys, pdf[["key", "a", "b"]].to_numpy(np.int64)])
            fps = np.concatenate([fps, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            if not len(keys):
                continue
            last = len(keys) - 1 - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) + 1 if (keys != keys[-1]).any() else 0
            if last:
                yield of(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield of(keys, fps)

    return run


def links(nodes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints that connect all that links connect."""
    listed = nodes.select("fp", F.explode(index_keys(F.col("fp"), bits)).alias("key"))
    large = materialise(listed.groupBy("key").count().filter(F.col("count") > block))
    cut = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    cells = (
        join_counted(listed, large, ["key"], "fp", "left")
        .withColumn("cut", F.coalesce(cut, F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    pairs = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInPandas(_links(bits), "u long, v long")
    return pairs.filter("u != v").distinct()


def salted(edges: DataFrame, least: DataFrame, salts: int = SALTS) -> DataFrame:
    """``edges`` with ``least`` of their u. A hub's edges are dealt to ``salts`` tasks, each with a copy of its least."""
    own = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.join(copies.hint("merge"), ["u", "salt"]).drop("salt")  # never by broadcast: nodes grow with the input


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(u, v): the smallest node v that each linked node u > v reaches.

    Alternating large and small stars; each round is two aggregations and joins,
    written to the shared folder by ``cut``. Ends when a round changes nothing.
    """
    size = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")]
    edges = cut(edges)
    before = edges.agg(*size).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u != v").distinct())
        now = edges.agg(*size).first()
        if now == before:
            return edges
        before = now


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per document with its fingerprint and near-duplicate class.

    Null and empty texts, and those without words, have fingerprint zero and are
    linked like any other. Equal fingerprints are linked. Repeated rows each give
    a row; an empty table gives none; other columns are ignored.

    Columns: doc_id, fingerprint, component_id (smallest doc_id reachable).
    """
    prints = materialise(fingerprints(docs, shingle))
    return classes_of(prints, bits, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes_of(prints: DataFrame, bits: int, block: int) -> DataFrame:
    """``prints`` (doc_id, fp and others) with the root of their class and its least doc_id, component_id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    root = connected_components(links(nodes.select("fp"), bits, block))
    placed = materialise(nodes.join(root.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least_id", "n", F.coalesce("v", "fp").alias("root")))
    classes = materialise(placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_fp")))
    of_print = materialise(join_split(placed, classes, "root", "n_fp").select("fp", "n", "root", "component_id"))
    return join_split(prints, of_print, "fp", "n").drop("n")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class, one with the smallest doc_id; all columns stay, whatever their names.

    Of several rows with that id in one class the one with the least hash of its
    text stays, then the one with the least hash of all columns. A null id is larger than any.
    """
    text_hash = F.xxhash64(text_or_empty())
    rows = fingerprints(docs.select("doc_id", text_or_empty().alias("text"), text_hash.alias("text_hash")), shingle, "text_hash")
    classes = classes_of(materialise(rows), bits, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")
    kept = classes.groupBy("root").agg(first).select(row_key(F.col("f.doc_id"), F.col("f.text_hash")))
    return rows_of_keys(docs, row_key(F.col("doc_id").cast("long"), text_hash), kept)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
