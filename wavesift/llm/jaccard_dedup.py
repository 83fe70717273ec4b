"""Near copies by word 5-gram Jaccard similarity: the SimHash near-duplicate stage of the pipeline.

The way is that of simhash_dedup, a byte-position inverted index with count
filtering over SimHash, for another threshold: at similarity 0.8 a bit of two
SimHashes differs with probability 0.15, so the 8 bytes of one say too little.
Here every text has POSITIONS bytes, 24 SimHashes of 64 bits of its distinct
shingles. A shingle votes on each bit with a byte of its hash, from -127.5 to
127.5, in place of +1 or -1, so that votes of short texts hardly tie. The index
lists a text under the bytes of each of POSITIONS / WIDTH sets of WIDTH positions;
a pair of similarity 0.8 is listed together under none with probability 8e-4, one
of 0.85 with 1e-5. Texts of one key whose first 192 bits differ in MOST or fewer
go on, as components. There the shared bytes of all positions are tallied, pairs
with fewer than LEAST are dropped, and exact shingle sets decide. Only a spanning
forest of the links of a group leaves its task; keys and groups of many texts are
cut into blocks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm._common import join_counted, join_split, materialise, row_key, rows_of_keys, small_batches, text_or_empty
from wavesift.llm.simhash_dedup import connected_components

SHINGLE = 5
#: Texts are near copies from this Jaccard similarity on, in percent.
PERCENT = 80
POSITIONS, WIDTH = 192, 2
#: Positional bytes that a pair must share: five and a half deviations below what is expected at 0.8.
LEAST = 18
#: Of the first 192 bits so many may differ: four deviations above what is expected at 0.8, six below that of other texts.
MOST = 50
SEED = 42
#: Texts of one key that a task compares with one another at most, twice this for two blocks.
BLOCK = 512
#: Fingerprints of one key that a task compares with one another at most, twice this for two blocks.
KEY_BLOCK = 4096
#: Texts of a key are counted by one node in so many, to cut large keys; which texts meet does not depend on it.
COUNTED = 16


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text is one shingle, and no words are one, too."""
    ws = text.encode().lower().split()  # bytes: A-Z only, and space and \\t to \\r only
    n = min(shingle, len(ws)) or 1
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist() or [1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip([0, *ends[:-1]], ends[n - 1 :], strict=False)], np.uint64))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, POSITIONS), np.uint64)
    return flips, factors | np.uint64(1)


_CONSTANTS = _constants()
#: Every other byte of a word. Sums of 256 bytes stay within two.
LANES = np.uint64(0x00FF00FF00FF00FF)


def positional_bytes(own: np.ndarray) -> bytes:
    """The SimHashes of a text with these shingles: a bit is 1 where the bytes that its shingles vote with are above 127.5 on average."""
    flips, factors = _CONSTANTS
    votes = np.zeros((2, POSITIONS * 4), np.int64)
    for at in range(0, len(own), 256):
        words = own[at : at + 256, None] ^ flips
        words *= factors
        words ^= words >> np.uint64(32)
        words *= np.uint64(0x9E3779B97F4A7C15)
        votes[0] += (words & LANES).sum(axis=0).view(np.uint16)
        words >>= np.uint64(8)
        words &= LANES
        votes[1] += words.sum(axis=0).view(np.uint16)
    return np.packbits(2 * votes > 255 * len(own)).tobytes()


def index_keys(fingerprint: bytes) -> np.ndarray:
    """The keys under which a text is listed: the number of a set of positions, and their bytes."""
    own = np.frombuffer(fingerprint, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    return np.arange(len(own)) << 8 * WIDTH | own @ (1 << 8 * np.arange(WIDTH))


def components(key: np.ndarray, *bits: np.ndarray) -> np.ndarray:
    """For rows sorted by key, the first row of each one's component: rows of a key are linked where MOST or fewer bits of their words differ."""
    first, i, step = np.arange(len(key)), np.arange(len(key)), 1
    while True:
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            return first
        j = i + step
        near = sum(np.bitwise_count(x[i] ^ x[j]) for x in bits) <= MOST
        u, v = first[i[near]], first[j[near]]
        while (u != v).any():
            np.minimum.at(first, np.maximum(u, v), np.minimum(u, v))
            while (first[first] != first).any():
                first = first[first]
            u, v = first[u], first[v]
        step += 1


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over rows (cell, node, x, y, z) sorted by cell: components of two or more, by the node of their first row."""

    def of(cell: np.ndarray, node: np.ndarray, *bits: np.ndarray) -> pd.DataFrame:
        first = components(cell, *(x.view(np.uint64) for x in bits))
        some = np.bincount(first, minlength=len(first))[first] > 1
        return pd.DataFrame({"cell": cell[some], "root": node[first[some]], "node": node[some]})

    rows = np.empty((5, 0), np.int64)
    for pdf in batches:
        rows = np.concatenate([rows, pdf[["cell", "node", "x", "y", "z"]].to_numpy(np.int64).T], axis=1)
        last = np.searchsorted(rows[0], rows[0, -1]) if rows.size else 0
        if last:
            yield of(*rows[:, :last])
            rows = rows[:, last:]
    yield of(*rows)


def forest(nodes: np.ndarray, sets: list[np.ndarray], bytes_: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``nodes``, by tally and exact similarity; each is expanded once."""
    size = np.array([len(s) for s in sets])
    left = np.arange(len(nodes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            own = queue.pop()
            n = size[own]
            near = (bytes_[left] == bytes_[own]).sum(axis=1) >= LEAST  # the tally
            near &= 100 * np.minimum(size[left], n) >= percent * np.maximum(size[left], n)
            if not near.any():
                continue
            some = left[near]
            flat = np.concatenate([sets[x] for x in some])
            at = np.minimum(np.searchsorted(sets[own], flat), n - 1)
            common = np.add.reduceat(sets[own][at] == flat, np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            near[near] = 100 * common >= percent * (size[some] + n - common)
            if near.any():
                yield from ((nodes[own], nodes[x]) for x in left[near])
                queue += left[near].tolist()
                left = left[~near]


def _links(percent: int):
    """For mapInPandas over rows sorted by (key, a, b): the forest of each group."""

    def of(group: dict[int, tuple[bytes, bytes]]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(s, np.uint64) for s, _ in group.values()]
        fingerprints = np.frombuffer(b"".join(f for _, f in group.values()), np.uint8).reshape(-1, POSITIONS)
        return list(forest(np.array(list(group), np.int64), sets, fingerprints, percent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        group: dict = {}
        for pdf in batches:
            out = []
            for k, a, b, node, *own in zip(pdf["key"], pdf["a"], pdf["b"], pdf["node"], pdf["shingles"], pdf["fingerprint"], strict=True):
                if (k, a, b) != key:
                    out += of(group) if len(group) > 1 else []
                    key, group = (k, a, b), {}
                group[node] = own
            yield _frame(out)
        yield _frame(of(group) if len(group) > 1 else [])

    return run


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": both.max(axis=1), "v": both.min(axis=1)})


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, first, keys, x, y, z) for each distinct text; node is its 64-bit hash, first its least doc_id, x to z are its first 192 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [positional_bytes(shingles(t, shingle)) for t in pdf["text"]]
            bits = np.frombuffer(b"".join(own), np.int64).reshape(-1, POSITIONS // 8)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "node": pdf["node"], "keys": [index_keys(f) for f in own], "x": bits[:, 0], "y": bits[:, 1], "z": bits[:, 2]})

    text = text_or_empty()
    own = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("node"), text.alias("text"))
    rows = own.mapInPandas(run, "doc_id long, node long, keys array<int>, x long, y long, z long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    return rows.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("keys", "x", "y", "z")])


def meetings(nodes: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """(key, node): groups of two or more texts that may be near copies; every pair listed under one key that passes the bits is in one."""
    listed = nodes.select("node", "x", "y", "z", F.explode("keys").alias("key"))
    count = (F.count(F.lit(1)) * COUNTED).alias("count")
    large = materialise(listed.filter(F.pmod("node", F.lit(COUNTED)) == 0).groupBy("key").agg(count).filter(F.col("count") > block))
    cells = (
        join_counted(listed, large, ["key"], "node", "left")
        .withColumn("cut", F.coalesce(F.ceil(F.col("count") / F.lit(block)).cast("long"), F.lit(1).cast("long")))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
        .select(
            F.shiftleft(F.least("own", "other"), 43).bitwiseOR(F.shiftleft(F.greatest("own", "other"), 23)).bitwiseOR(F.col("key").cast("long")).alias("cell"),
            "node", "x", "y", "z",
        )
    )
    met = cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_meetings, "cell long, root long, node long")
    return met.select(F.xxhash64("cell", "root").alias("key"), "node")


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, key_block: int = KEY_BLOCK) -> DataFrame:
    """(u, v), u > v: links between distinct texts that connect all that links connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingles(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "shingles": [s.tobytes() for s in own], "fingerprint": [positional_bytes(s) for s in own]})

    listed = materialise(meetings(nodes, key_block))
    groups = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    groups = materialise(groups.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n"))  # one key for each set of texts
    met = materialise(join_split(listed, groups, "key", "n"))
    alone = met.select("node").distinct()
    text = text_or_empty()
    sets = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(alone, "node", "left_semi")
    sets = sets.mapInPandas(run, "node long, shingles binary, fingerprint binary").dropDuplicates(["node"])
    cells = (
        met.withColumn("cut", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node")
        .join(sets, "node")
    )
    pairs = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInPandas(_links(percent), "u long, v long")
    return pairs.distinct()


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, key_block: int = KEY_BLOCK) -> DataFrame:
    """``docs`` with one row of each class, one with the smallest doc_id; all columns stay, whatever their names.

    Texts of Jaccard similarity ``percent`` or more are linked; classes are what
    links connect. Null and empty texts and those without words are near copies
    of one another. Of several rows with that id in one class the one with the least
    hash of its text stays, then the one with the least hash of all columns; a null id
    is larger than any. An empty table gives none.
    """
    nodes = materialise(sketches(docs, shingle))
    root = connected_components(links(docs, nodes, shingle, percent, block, key_block))
    placed = nodes.join(root.select(F.col("u").alias("node"), "v"), "node", "left").select("node", "first", F.coalesce("v", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min(F.struct("first", "node")).alias("f")).select(row_key(F.col("f.first.doc_id"), F.col("f.node")))
    return rows_of_keys(docs, row_key(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty())), kept)
