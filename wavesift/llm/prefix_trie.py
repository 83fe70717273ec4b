"""Prefix trie of conversations by chained digests.

Turns become digests where they are read, so texts are never shuffled. One shuffle
brings a conversation and the one it borrows its head from together; a stream over
the sorted turns chains the digests and gives every prefix as a row. Grouping by
(depth, digest) makes the nodes, named by their smallest member.

The smallest member of a node is that of every deeper node on its own path, so a
conversation owns the nodes of its path from some depth on: a chain. A chain is
summed before it is exploded to the ancestors above it, which are the other
prefixes of its conversation; so subtree sums take as many rows as there are
prefixes, however long conversations are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.llm._common import join_split, materialise, small_batches, table

#: A conversation borrows from the one whose number is the last multiple of this.
FAMILY = 20
#: It borrows fewer turns than this.
HEADS = 4
#: Ids of conversations that travel in one row to the digest of a node's ends.
CHUNK = 4096
#: Rows that a stream gives at a time.
ROWS = 50_000


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, role, digest, words) of every turn; null role and text are empty, rows without conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    return conversations.filter(conv.isNotNull()).select(
        (conv - conv % F.lit(FAMILY)).alias("base"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefixes of the conversations of families sorted by (base, own first, conv_id, turn); a turn is held at a time."""
    base = conv = None
    head: list[tuple[bytes, int]] = []
    out: list[tuple] = []
    depth, state, seen, skip, pending = 0, b"", 0, 0, None

    def add(digest: bytes, words: int) -> None:
        nonlocal depth, state, pending
        if pending:
            out.append((*pending, False))
        depth, state = depth + 1, hashlib.sha256(state + digest).digest()
        pending = (conv, depth, state, words)

    def end() -> None:
        if conv is not None:
            out.append((*(pending or (conv, 0, b"", 0)), True))

    def rows() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "depth", "digest", "words", "last"])
        out.clear()
        return frame

    for pdf in batches:
        for b, c, digest, words in zip(pdf["base"].tolist(), pdf["conv_id"].tolist(), pdf["digest"], pdf["words"].tolist(), strict=True):
            if c != conv:
                end()
                if b != base:
                    base, head = b, []
                conv, depth, state, seen, pending = c, 0, bytes(32), 0, None
                borrowed = 0 if c == b else zlib.crc32(str(c).encode()) % HEADS
                skip = borrowed
                for d, w in head[:borrowed]:
                    add(d, w)
            seen += 1
            if c == b and seen < HEADS:
                head.append((digest, words))
            if seen > skip:
                add(digest, words)
            if len(out) >= ROWS:
                yield rows()
    end()
    yield rows()


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, last) of every prefix of every rebuilt conversation; depth 0 of those without turns only."""
    turns = turn_digests(conversations).repartition("base")
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    sorted_ = small_batches(turns).sortWithinPartitions(*order).select("base", "conv_id", "digest", "words")
    return sorted_.mapInPandas(_chain, "conv_id long, depth long, digest binary, words long, last boolean")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): SHA-256 of the ``member`` ids of each node in order, comma-joined.

    Ids are sorted over all tasks and joined in rows of CHUNK; a node's task
    streams its rows into the digest.
    """
    key = ["conv_id", "depth"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf[key].to_numpy(np.int64)
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else []
            cuts = np.unique(np.r_[new, np.arange(0, len(k), CHUNK)].astype(np.int64))
            member = pdf["member"].tolist()
            text = [",".join(map(str, member[a:b])) for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True)]
            yield pd.DataFrame({"conv_id": k[cuts, 0], "depth": k[cuts, 1], "first": [member[a] for a in cuts], "ids": text})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in batches:
            out = []
            for c, d, ids in zip(pdf["conv_id"].tolist(), pdf["depth"].tolist(), pdf["ids"], strict=True):
                if (c, d) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["conv_id", "depth", "ends"])

    ordered = ends.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member")
    rows = ordered.mapInPandas(chunks, "conv_id long, depth long, first long, ids string").repartition(*key).sortWithinPartitions(*key, "first")
    return rows.mapInPandas(digests, "conv_id long, depth long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are ordered by turn (null first), ties by role and then by the digest of
    role and text; repeated rows are turns of their own. Null role or text is
    empty, rows without conv_id are left out, an empty table has no nodes (with
    any conversation there is a root), other columns are ignored. Texts of any length
    and conversations of any number of turns are streamed; the digests of one
    conversation are chained in one task, 32 bytes a turn, and so is the sum along its own chain.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    rows = materialise(prefixes(conversations))
    root = rows.filter("last").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    top_conv = F.lit(root["conv_id"]).cast("long")
    nodes = materialise(
        rows.filter("depth > 0")
        .groupBy("depth", "digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("node"), F.min("words").alias("node_words"))
        .select("digest", "n", "node", ((F.col("n") - 1) * F.col("node_words")).alias("saved"))
    )
    placed = materialise(join_split(rows.filter("depth > 0").select("conv_id", "depth", "digest", "last"), nodes, "digest", "n").drop("digest"))
    own = F.col("node") == F.col("conv_id")

    chains = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.min(F.when(own, F.col("depth"))).alias("top"),
        F.max_by(F.when(~own, F.col("node")), F.when(~own, F.col("depth"))).alias("parent"),
        F.sum(F.when(own, F.col("saved"))).alias("chain_saved"),
    )
    chains = materialise(chains.filter("top is not null").withColumn("parent", F.when(F.col("top") == 1, top_conv).otherwise(F.col("parent"))))
    below = chains.groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("child"))
    tips = below.select("conv_id", F.col("depth").alias("turns"), F.lit(0).cast("long").alias("leaf"))
    chains = materialise(chains.join(tips, ["conv_id", "turns"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(1))))

    zero, none = F.lit(0).cast("long"), F.lit(None)
    columns = ("conv_id", "depth", "parent", "n", "child", "leaf", "saved", "ends")
    types = ("long",) * 7 + ("string",)

    def given(df: DataFrame, **values) -> DataFrame:
        return df.select(*[values.get(c, zero if c in ("n", "child", "leaf", "saved") else none).cast(t).alias(c) for c, t in zip(columns, types, strict=True)])

    at = {"conv_id": F.col("conv_id"), "depth": F.col("depth")}
    along = F.sum("saved").over(Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    chain_rows = placed.filter(own).withColumn("along", along).select("conv_id", "depth", "n", "along")
    chain_rows = join_split(chain_rows, chains, "conv_id", "turns")
    of_chain = given(
        chain_rows,
        **at,
        parent=F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")),
        n=F.col("n"),
        child=(F.col("depth") < F.col("turns")).cast("long"),
        leaf=F.col("leaf"),
        saved=F.col("along"),
    )
    above = join_split(placed.filter(~own).select("conv_id", "depth", "node"), chains.select("conv_id", "turns", "leaf", "chain_saved"), "conv_id", "turns")
    of_ancestors = given(above, conv_id=F.col("node"), depth=F.col("depth"), leaf=F.col("leaf"), saved=F.col("chain_saved"))
    of_children = given(below, **at, child=F.col("child"))
    all_chains = chains.agg(F.sum("leaf").alias("leaf"), F.sum("chain_saved").alias("saved"))
    of_root = given(all_chains, conv_id=top_conv, depth=zero, n=F.lit(root["n"]), leaf=F.coalesce("leaf", F.lit(1)), saved=F.coalesce("saved", zero))
    ends = placed.filter("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ends = ends.unionByName(rows.filter("depth = 0").select(top_conv.alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    of_ends = given(ends_digests(ends), **at, ends=F.col("ends"))

    parts = of_chain.unionByName(of_ancestors).unionByName(of_children).unionByName(of_ends)
    if root["n"]:
        parts = parts.unionByName(of_root)
    return parts.groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent_conv_id"),
        F.sum("n").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH crc AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: if(a % 2 = 1, xor(a >> 1, 3988292384), a >> 1)) AS x FROM range(256) r(i))),
turns AS (
  SELECT conv_id, sha256(concat(length(role), ':', role, text)) AS digest,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(length(role), ':', role, text))) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT c.conv_id, b.i AS pos, b.digest, b.words FROM convs c JOIN turns b ON b.conv_id = c.base AND b.i <= c.h
  UNION ALL
  SELECT c.conv_id, t.i - c.h + coalesce(least(c.h, n), 0), t.digest, t.words
  FROM turns t JOIN convs c USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) b ON b.conv_id = c.base
  WHERE t.i > c.h),
members AS (
  SELECT conv_id, pos AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, words,
    pos = max(pos) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT path[1:-65] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT m.path, sum(n.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (path) JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY 1)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums s USING (path) LEFT JOIN children c USING (path)
LEFT JOIN nodes p ON a.depth > 0 AND p.path = a.path[1:-65]
"""
