"""The pipeline against its operators applied one by one, in plain Python."""


import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wavesift.llm import quality_classifier, secret_scan

SF = "/root/testdata/sf0.001"


def shingles_of(text: str) -> set[bytes]:
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def test_run_equals_brute_force(spark):
    """Near copies by all pairs of 5-word shingle sets, ids by the tokenizers library; scores and secrets by their operators."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality_classifier.fit(quality_classifier.training_rows(docs, labels))
    rows = [r for r, s in zip(rows, quality_classifier._scores([t for _, t in rows], model), strict=True) if s >= 0.3]
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, -1))
    rows = [(d, t) for d, t in rows if last[t] == d]
    sets, group = [shingles_of(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for (d, _), g in zip(rows, group, strict=True):
        first[g] = min(d, first.get(g, d))
    rows = [(d, t) for (d, t), g in zip(rows, group, strict=True) if first[g] == d]
    net = secret_scan.network()
    rows = [(d, secret_scan.redact(t, s)) for (d, t), s in zip(rows, secret_scan.scan_texts([t for _, t in rows], net), strict=True)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}

    out = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"]: p["doc_tokens"] for p in out} == {d: len(ids) for d, ids in want.items()}
    import zlib

    for p in out:
        own = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert bytes(p["ids"]) == np.array(own, "<u4").tobytes() and zlib.crc32(p["ids"]) == p["ids_crc32"]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


