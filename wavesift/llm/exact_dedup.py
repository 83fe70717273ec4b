"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries (mergeable, ``k`` counters each) find every digest that
more than one row in ``k + 1`` has. Their exact sizes are then counted, and the
verified winners, at most ``k`` rows, are broadcast: rows of large groups are
resolved on the map side and never shuffled. What is left has only groups of at
most ``n / (k + 1)`` rows and goes through an ordinary shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavesift.llm._common import materialise, rows_of_keys, table, text_or_empty

COUNTERS = 1024

_SUMMARY = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())])


def trim(counts: Counter, k: int) -> Counter:
    """Misra-Gries reduction: subtract the (k+1)-th largest count, keep what is above zero."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: n - cut for d, n in counts.items() if n > cut})


def _summaries(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for d, n in pdf.groupby("digest")["n"].sum().items():
                counts[d] += int(n)
            counts = trim(counts, k)
        yield pd.DataFrame({"digest": list(counts.keys()), "n": list(counts.values())})

    return run


def frequent_digests(digests: DataFrame, k: int) -> list[bytes]:
    """A superset of the digests that more than one row in ``k + 1`` has; at most ``k``.

    Summaries are merged in two levels, so the driver reads about
    ``k * sqrt(partitions)`` counters at most.
    """
    first = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInPandas(_summaries(k), _SUMMARY)
    groups = max(1, math.isqrt(digests.rdd.getNumPartitions()))
    second = first.repartition(groups).mapInPandas(_summaries(k), _SUMMARY)
    counts: Counter = Counter()
    for row in second.toLocalIterator():
        counts[bytes(row["digest"])] += row["n"]
        if len(counts) > 4 * k:
            counts = trim(counts, k)
    return list(trim(counts, k))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document with the document that stays for its text.

    Equal texts are those with equal SHA-256 of their UTF-8 bytes; null counts as
    empty. The row with the largest doc_id stays (a null id is smallest; of
    repeated rows with that id exactly one stays). Empty input gives an empty
    result. Other columns of ``docs`` are ignored.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = materialise(
        docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest")).withColumn(
            "rid", F.monotonically_increasing_id()
        )
    )
    group = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep")]
    n = rows.count()
    spark = docs.sparkSession
    candidates = spark.createDataFrame([(d,) for d in frequent_digests(rows, counters)], "digest binary")
    winners = (
        rows.join(F.broadcast(candidates), "digest")  # at most `counters` rows
        .groupBy("digest")
        .agg(*group)
        .filter(F.col("group_size") > n // (counters + 1))
    )
    # At most `counters` verified rows; made a local table so that the broadcast is of known size.
    winners = spark.createDataFrame(winners.collect(), winners.schema)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter(F.col("group_size").isNotNull())
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each text, that with the largest doc_id; all columns stay, whatever their names.

    Of rows with that id and text that differ elsewhere the one with the least hash
    of all columns stays.
    """
    key = lambda doc_id, sha: F.concat_ws(":", sha, F.coalesce(doc_id.cast("string"), F.lit("null")))
    kept = exact_dedup(docs, counters).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")))
    return rows_of_keys(docs, key(F.col("doc_id"), F.sha2(text_or_empty(), 256)), kept)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
