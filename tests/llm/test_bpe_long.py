"""Long texts of every kind through the tree, against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavesift.llm import bpe

R = random.Random(9)
WORDS = ["the", "Of", "reading", "über", "été", "straße", "x1", "***", "A|B", "don't", "中文字", "😀", "a b", "<|endoftext|>", "  ", "\n\n", "\t", "1234"]
N = 1_000_000
LONG = {
    "spaces, then a letter": " " * N + "x",
    "only spaces": " " * N,
    "tabs": "a" + "\t" * N + "b",
    "mixed white space": "".join(R.choice(" \t\n\r  ") for _ in range(N // 4)) + "end",
    "white space by turns": " \n" * (N // 4) + "x",
    "one ideogram": "中" * (N // 10),
    "ideograms": "".join(chr(R.randrange(0x4E00, 0x9000)) for _ in range(N // 20)),
    "one Latin-1 letter": "é" * (N // 4),
    "short pieces without white space": "ab1." * (N // 8),
    "Latin-1 prose": " ".join(R.choice(WORDS[:10]) for _ in range(40_000)),
    "any prose": " ".join(R.choice(WORDS) for _ in range(40_000)),
    "special tokens without white space": "a<|endoftext|>" * 5_000,
    "long units in prose": " ".join(R.choice(WORDS) + "y" * R.choice([0, 0, 0, 9_000]) for _ in range(40)),
}


def test_long_texts_of_every_kind(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rows = list(enumerate(LONG.values()))
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == len(rows)
    for (i, text), name in zip(rows, LONG, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), name
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest(), name


@pytest.mark.parametrize("leaf", [3, 8, 40])
def test_joins_of_small_leaves(leaf):
    path = public_tokenizers.path(bpe.TOKENIZER)
    library, tree = Tokenizer.from_file(path), bpe.tree_encoder(path)
    for n in range(1, 120):
        text = "".join(R.choice(WORDS) + R.choice(["", "", " ", "  ", "\n "]) for _ in range(n % 40 + 1))
        assert np.frombuffer(tree.encode(text, leaf), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
