"""A training-data pipeline over `documents`: five stages, each one operator of wavesift.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wavesift.llm import exact_dedup, jaccard_dedup, packing, quality_classifier, secret_scan
from wavesift.llm._common import delete, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's own documents, does not reject."""
    model = quality_classifier.fit(quality_classifier.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality_classifier.drop_bad(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (word 5-grams, Jaccard 0.8 or more): the one with the smallest doc_id.

    By SimHash, a positional index and tally as in the SimHash operator, over 24
    fingerprints in place of one, as 64 bits say too little at 0.8; exact sets decide.
    """
    return jaccard_dedup.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its ids and its place in a sequence."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written to the shared folder and read again.

    What a stage read is deleted once its own result is written; the last result stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
