"""Documents whose sets of word n-grams have a Jaccard similarity of PERCENT or more, by T-occurrence search.

A document that is similar to a query of n shingles shares T = ceil(0.8 n) of them
or more. DivideSkip parts the inverted lists of a query's shingles: the long lists
are set aside, the short ones merged by a heap, and documents that come up often
enough for the lists set aside to make up the rest have these probed by binary search.

Across a cluster: frequent shingles (counted over all documents, the MOST_LONG most
frequent are known to every task) have the long lists and come last in one order of
all shingles; else shingles are ordered by hash. The first n - T + K of a document
are its short lists, and two similar documents share K of these at least. Lists of
one document vanish where postings meet, and documents left with fewer than K lists
go. What is left is first linked to leaders, one pair a document, so that large
groups of near copies never meet in pairs; then lists are merged between
documents not yet connected, and candidates are probed in whole sets. A list
gives a query only members whose parity bits leave the overlap possible: each bit
that differs stands for one shingle at least that the sets do not share.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import join_counted, join_split, small_batches, table, text_or_empty, written
from wavesift.llm.simhash_dedup import connected_components

SHINGLE = 5
PERCENT = 80
#: The share of T that the merged lists must reach by themselves, as one in so many.
MERGED = 10
#: Shingles counted as frequent, at most, and the least number of documents that they are in. Which these are
#: decides how much is merged, never which documents are linked.
MOST_LONG, LEAST_LONG = 1 << 17, 32
#: Postings that meet in one bucket, about.
BUCKET = 1 << 17
#: Documents of one list that meet in one task; longer lists are cut into blocks that meet two by two.
BLOCK = 2048
#: Followers whose sets meet one copy of their leader's.
FOLLOWERS = 512
#: Rounds in which documents are linked to leaders, each with other ones.
LEADER_ROUNDS = 2
#: Words whose hashes a worker remembers; bytes of a text that it splits at a time.
VOCABULARY, PIECE = 200_000, 1 << 20
#: Longs of parity bits that a set has where it is listed, and where pairs are looked at once more before their sets travel.
LONGS, WIDE = 4, 64
BITS = tuple(f"b{i}" for i in range(LONGS))
_SPACE = re.compile(rb"[ \t-\r]")
#: The odd factor and the shift of a 64-bit mix.
FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Words(dict):
    """64-bit hashes of words, by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = own = xxhash.xxh64_intdigest(word)
        return own


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def shingle_set(text: str, words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, ascending; with fewer words the whole sequence is one."""
    hashes = []
    for piece in _pieces(text.encode().lower()):  # bytes: A-Z only
        own = piece.split()  # space and \\t to \\r
        hashes.append(np.fromiter(map(words.__getitem__, own), np.uint64, len(own)))
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    if not len(h):
        return h
    size = min(shingle, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed ^= mixed >> SHIFT
        mixed *= FACTOR
        mixed += h[i : i + n]
    mixed ^= mixed >> SHIFT
    mixed *= FACTOR
    mixed ^= mixed >> SHIFT
    mixed.sort()
    return mixed[np.r_[True, mixed[1:] != mixed[:-1]]]


def node_of(own: np.ndarray) -> int:
    """The id of a set: equal sets are one node. 64 bits: two of a billion different sets share one with probability 0.03."""
    return int(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0])


def parity(own: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """For each of 64 * longs classes of hashes, whether an odd number of the shingles is in it; packed in longs."""
    odd = np.bincount((own % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_apart(n_u, n_v, percent: int = PERCENT):
    """Shingles that only one of two similar sets has, at most."""
    return n_u + n_v - 2 * -(-percent * (n_u + n_v) // (100 + percent))


def required(n, percent: int = PERCENT):
    """T: shingles that a set of n shares with any similar one, at least."""
    return -(-percent * n // 100)


def merged(n, percent: int = PERCENT):
    """K: short lists that it shares at least with a similar set of its size or more."""
    return 1 + required(n, percent) // MERGED


def least_merged(n, percent: int = PERCENT):
    """K of the smallest set that can be similar to one of n."""
    return merged(required(n, percent), percent)


def is_long(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def short_lists(own: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The n - T + K first shingles in the order of all: rare ones by hash, then frequent ones by hash."""
    n = len(own)
    last = is_long(own, frequent)
    return np.concatenate([own[~last], own[last]])[: n - required(n, percent) + merged(n, percent)]


def sets_of(pdf: pd.DataFrame, words: Words, shingle: int) -> list[np.ndarray]:
    return [shingle_set(t, words, shingle) for t in pdf["text"]]


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))


def summaries(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, row, node, n, parity bits) of the documents, and rows (token, n) of shingles that several sets of a batch hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            sets = sets_of(pdf, words, shingle)
            node = [node_of(s) if len(s) else None for s in sets]
            bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, LONGS)
            none = pd.array([None] * len(sets), "Int64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "node": pd.array(node, "Int64"), "n": [len(s) for s in sets], "token": none, **dict(zip(BITS, bits.T, strict=True))})
            once = {k: s for k, s in zip(node, sets, strict=True) if k is not None}
            if once:
                token, count = np.unique(np.concatenate(list(once.values())), return_counts=True)
                token, count = token[count > 1].view(np.int64), count[count > 1]
                none = pd.array([None] * len(token), "Int64")
                yield pd.DataFrame({"doc_id": none, "row": none, "node": none, "n": count, "token": pd.array(token, "Int64"), **dict.fromkeys(BITS, none)})

    return _texts(docs).mapInPandas(run, f"doc_id long, row long, node long, n long, token long, {', '.join(f'{b} long' for b in BITS)}")


def frequent_shingles(counted: DataFrame, most: int = MOST_LONG, least: int = LEAST_LONG) -> np.ndarray:
    """The most frequent shingles, ascending; MOST_LONG numbers at most come to the driver."""
    rows = counted.filter("token is not null").groupBy("token").agg(F.sum("n").alias("df")).filter(F.col("df") >= least)
    found = rows.orderBy(F.desc("df"), "token").limit(most).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def postings(docs: DataFrame, frequent: np.ndarray, buckets: int, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(bucket, tokens, nodes): the short lists' postings of a batch, packed by bucket.

    A rare shingle has one bucket. The postings of a frequent one are dealt to
    buckets below zero, as it is shared for sure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            once = {node_of(s): s for s in sets_of(pdf, words, shingle) if len(s)}
            if not once:
                continue
            lists = [short_lists(s, frequent, percent) for s in once.values()]
            token = np.concatenate(lists)
            node = np.repeat(np.array(list(once), np.int64), [len(s) for s in lists])
            dealt = (((token ^ node.view(np.uint64)) * FACTOR) >> SHIFT) % np.uint64(buckets)
            bucket = np.where(is_long(token, frequent), -1 - dealt.astype(np.int64), (token % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket, token, node = bucket[order], token[order], node[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            spans = list(zip(cuts, [*cuts[1:], len(bucket)], strict=True))
            yield pd.DataFrame({"bucket": bucket[cuts], "tokens": [token[a:b].tobytes() for a, b in spans], "nodes": [node[a:b].tobytes() for a, b in spans]})

    return _texts(docs).mapInPandas(run, "bucket long, tokens binary, nodes binary")


def shared_lists(packed: DataFrame) -> DataFrame:
    """(token, node): the postings of lists that hold two sets or more, each once."""

    def of(bucket: int, tokens: list[bytes], nodes: list[bytes]) -> pd.DataFrame:
        token, node = np.frombuffer(b"".join(tokens), np.int64), np.frombuffer(b"".join(nodes), np.int64)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node = token[new], node[new]
        if bucket >= 0:
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            some = np.repeat(sizes > 1, sizes)
            token, node = token[some], node[some]
        return pd.DataFrame({"token": token, "node": node})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tokens, nodes = None, [], []
        for pdf in batches:
            for b, t, d in zip(pdf["bucket"].tolist(), pdf["tokens"], pdf["nodes"], strict=True):
                if b != own and tokens:
                    yield of(own, tokens, nodes)
                    tokens, nodes = [], []
                own = b
                tokens.append(t)
                nodes.append(d)
        if tokens:
            yield of(own, tokens, nodes)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "token long, node long")


def set_table(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, own, n, wide) of the sets ``wanted`` (row, node): only their texts are read again. Of repeated rows each task gives one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, given = Words(), set()
        for pdf in batches:
            sets, keep = sets_of(pdf, words, shingle), []
            for i, (s, node) in enumerate(zip(sets, pdf["node"].tolist(), strict=True)):
                if node not in given and len(s) and node_of(s) == node:
                    given.add(node)
                    keep.append(i)
            yield pd.DataFrame({"node": pdf["node"].iloc[keep], "own": [sets[i].tobytes() for i in keep], "n": [len(sets[i]) for i in keep], "wide": [parity(sets[i], WIDE) for i in keep]})

    rows = join_counted(_texts(docs), wanted, ["row"], "text").select("text", "node")
    return rows.mapInPandas(run, "node long, own binary, n long, wide array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (u, v) that are similar, by binary search of the shingles of u in the set of v.

    Pairs whose parity bits are too far apart go first. The sets of many u meet a copy of the set of their v, FOLLOWERS of them in a task at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, hub = None, None
        for pdf in batches:
            u, v = [], []
            for own_v, salt, own_u, is_hub, packed in zip(pdf["v"].tolist(), pdf["salt"].tolist(), pdf["u"].tolist(), pdf["hub"].tolist(), pdf["own"], strict=True):
                own = np.frombuffer(packed, np.uint64)
                if is_hub:
                    cell, hub = (own_v, salt), own
                    continue
                assert cell == (own_v, salt)
                common = np.count_nonzero(hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own)
                if 100 * common >= percent * (len(own) + len(hub) - common):
                    u.append(own_u)
                    v.append(own_v)
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    of_u, of_v = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "uv")
    total = F.col("n_u") + F.col("n_v")
    apart = F.aggregate(F.zip_with("wide_u", "wide_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = pairs.join(of_u, "u").join(of_v, "v").filter(apart <= total - 2 * F.ceil(total * percent / (100 + percent)))
    pairs = written(near.select("u", "v"))
    sets = sets.select("node", "own")
    hubs = written(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    cut = F.ceil(F.col("n") / F.lit(FOLLOWERS)).cast("long")
    dealt = written(join_split(pairs, hubs, "v", "n").select("u", "v", F.pmod(F.xxhash64("u", "v"), cut).alias("salt")))
    followers = dealt.join(sets.withColumnRenamed("node", "u"), "u").select("v", "salt", "u", F.lit(False).alias("hub"), "own")
    leaders = dealt.select("v", "salt").distinct().join(sets.withColumnRenamed("node", "v"), "v").select("v", "salt", F.col("v").alias("u"), F.lit(True).alias("hub"), "own")
    rows = followers.unionByName(leaders).repartition("v", "salt").sortWithinPartitions("v", "salt", F.desc("hub"))
    return small_batches(rows).mapInPandas(run, "u long, v long")


def leader_pairs(lists: DataFrame, nodes: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """(u, v): for each set u the leader v, of another class, that leads most of its lists; a list is led by the set of least hash."""
    leaders = written(lists.groupBy("token").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("v"), F.count(F.lit(1)).alias("n")))
    led = join_split(lists, leaders, "token", "n").filter("node != v").groupBy(F.col("node").alias("u"), "v").agg(F.count(F.lit(1)).alias("lists"))
    of_u, of_v = (nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "root", *BITS)]) for c in "uv")
    led = written(led.join(of_u, "u"))
    per_leader = written(led.groupBy("v").agg(F.count(F.lit(1)).alias("led")).join(of_v, "v"))
    both = join_split(led, per_leader, "v", "led")
    total = F.col("n_u") + F.col("n_v")
    apart = sum((F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in BITS), F.lit(0))
    fits = (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (apart <= total - 2 * F.ceil(total * percent / (100 + percent)))
    return both.filter("root_u != root_v").filter(fits).groupBy("u").agg(F.max_by("v", F.struct("lists", "v")).alias("v"))


def candidates(lists: DataFrame, nodes: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """(u, v): pairs of different classes that share enough of their short lists.

    The query u is of the smaller class, so a large class of near copies is only
    ever searched. Each list gives u its members of larger classes and fitting
    size; the lists of u are merged by a heap and members counted.
    """

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(rows: np.ndarray) -> pd.DataFrame:
            """For whole cells, sorted: each row with those after it in its cell, one step further at a time."""
            rows = rows[np.lexsort((rows[:, 6], rows[:, 5], *rows[:, 2::-1].T))]
            node, n, root, own, two, bits = rows[:, 3], rows[:, 4], rows[:, 6], rows[:, 7], rows[:, 8], rows[:, 9:].view(np.uint64)
            i, step, pairs = np.arange(len(rows)), 1, [np.empty((2, 0), np.int64)]
            while True:
                i = i[i + step < len(rows)]
                i = i[(rows[i, :3] == rows[i + step, :3]).all(axis=1)]
                if not len(i):
                    break
                j = i + step
                step += 1
                fit = (root[i] != root[j]) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & ((two[i] == 0) | (own[i] != own[j]))
                a, b = i[fit], j[fit]
                near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most_apart(n[a], n[b], percent)
                pairs.append(np.stack([a[near], b[near]]))
            a, b = np.concatenate(pairs, axis=1)
            order = np.lexsort((node[b], a))
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
            members = [node[b[x:y]].tobytes() for x, y in zip(cuts, np.r_[cuts[1:], len(a)][: len(cuts)], strict=True)]
            return pd.DataFrame({"u": node[a[cuts]], "n": n[a[cuts]], "members": members})

        columns = ["token", "a", "b", "node", "n", "size", "root", "own", "two", *BITS]
        rows = np.empty((0, len(columns)), np.int64)
        for pdf in batches:
            rows = np.concatenate([rows, pdf[columns].to_numpy(np.int64)])
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            last = new[-1] + 1 if len(new) else 0
            if last:
                yield of(rows[:last])
                rows = rows[last:]
        if len(rows):
            yield of(rows)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(lists: list[np.ndarray], n: int) -> list[int]:
            least = least_merged(n, percent)
            if len(lists) < least:
                return []
            return [v for v, run in groupby(heapq.merge(*[x.tolist() for x in lists])) if sum(1 for _ in run) >= least]

        own, size, held = None, 0, []
        for pdf in batches:
            out = []
            for u, n, members in zip(pdf["u"].tolist(), pdf["n"].tolist(), pdf["members"], strict=True):
                if u != own:
                    out += [(own, v) for v in of(held, size)]
                    own, size, held = u, n, []
                held.append(np.frombuffer(members, np.int64))
            yield pd.DataFrame(out, columns=["u", "v"])
        yield pd.DataFrame([(own, v) for v in of(held, size)] if held else [], columns=["u", "v"])

    counts = written(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    of_node = written(join_split(nodes.select("node", "n", "root", "lists", *BITS), counts, "root", "size"))
    listed = join_split(lists, of_node, "node", "lists").select("token", "node", "n", "size", "root", *BITS)
    large = written(lists.groupBy("token").count().filter(F.col("count") > block))
    cells = (
        join_counted(listed, large, ["token"], "node", "left")
        .withColumn("cut", F.coalesce(F.ceil(F.col("count") / F.lit(block)).cast("long"), F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
        .select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "n", "size", "root", "own", (F.col("own") != F.col("other")).cast("long").alias("two"), *BITS)
    )
    rows = cells.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b").mapInPandas(partners, "u long, n long, members binary")
    return small_batches(rows.repartition("u").sortWithinPartitions("u")).mapInPandas(merge, "u long, v long")


def ngram_links(docs: DataFrame, sized: DataFrame, counted: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(u, v): for each set u that is similar to others the root v of its class. ``sized``: (node, row, n, parity bits) of every set."""
    frequent = frequent_shingles(counted)
    total = sized.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) * (1 - 1 / MERGED) + 2)).first()[0] or 0
    packed = postings(docs, frequent, int(total // BUCKET) + 1, shingle, percent)
    lists = written(shared_lists(packed))
    own = lists.groupBy("node").agg(F.count(F.lit(1)).alias("lists"))
    least = 1 + F.floor(F.ceil(percent * F.ceil(percent * F.col("n") / 100) / 100) / MERGED)
    nodes = written(sized.join(own, "node").filter(F.col("lists") >= least).select("node", "row", "n", "lists", *BITS))
    lists = written(join_split(lists, nodes.select("node", "lists"), "node", "lists").select("token", "node"))
    sets = written(set_table(docs, written(nodes.select("row", "node")), shingle))

    found = None
    roots = nodes.withColumn("root", F.col("node"))
    for turn in range(rounds + 1):
        pairs = leader_pairs(lists, roots, turn, percent) if turn < rounds else candidates(lists, roots, percent=percent)
        links = verified(written(pairs), sets, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        found = connected_components(links if found is None else found.unionByName(links), written)
        roots = written(nodes.join(found.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("v", "node")).drop("v"))
    return found


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document with the size of its set and its class of similar documents.

    Null and empty texts, and those without words, have an empty set and a class of
    their own. Texts of fewer than ``shingle`` words have one shingle, the whole
    sequence. Equal sets are one class; similar ones are found whatever their
    size. Repeated rows each give a row; a null doc_id is larger than any; an empty
    table gives none; other columns are ignored.

    Columns: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included).
    """
    counted = written(summaries(docs, shingle))
    rows = counted.filter("token is null").drop("token")
    sized = written(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.max("n").alias("n"), F.count(F.lit(1)).alias("docs"), *[F.first(b).alias(b) for b in BITS]))
    root = ngram_links(docs, sized.select("node", "row", "n", *BITS), counted, shingle, percent)
    placed = written(sized.join(root.withColumnRenamed("u", "node"), "node", "left").select("node", "doc_id", "docs", F.coalesce("v", "node").alias("root")))
    classes = written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    of_node = written(join_split(placed.select("node", "docs", "root"), classes, "root", "sets").select("node", "docs", "component_id"))
    linked = join_split(rows.filter("node is not null"), of_node, "node", "docs").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
