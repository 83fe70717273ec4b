"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavesift.llm import (
    bpe,
    exact_dedup,
    licence_scan,
    ngram_join,
    packing,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_dedup,
    url_filter,
    whitening,
)

_QUERIES = {
    f.__name__: f
    for f in (
        secret_scan.op1_secret_scan,
        licence_scan.op2_licence_scan,
        packing.op3_packing,
        quality_classifier.op4_quality,
        simhash_dedup.op5_simhash,
        exact_dedup.op6_exact_dedup,
        bpe.op7_bpe,
        pii.op8_pii,
        quality_rules.op9_quality_rules,
        url_filter.op10_url_filters,
        prefix_trie.op11_prefix_trie,
        ngram_join.op12_ngram_join,
        whitening.op13_whitening,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licence_scan": licence_scan.oracle(),
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op9_quality_rules": quality_rules.OP9_SQL,
        "op10_url_filters": url_filter.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
    }
