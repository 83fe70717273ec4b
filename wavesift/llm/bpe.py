"""Byte-level BPE encoding and decoding by tree concatenation.

Texts longer than ``leaf`` characters are halved until no part is longer; the
leaves are encoded in parallel as rows of their own, and neighbours are joined
up the tree. At a join the last and first tokens of both sides are encoded again
in a window that doubles until both sides agree with it exactly.

Two kinds of leaves are told apart in one pass over a text. Parts of units (see
unit_encoder: white space, then other characters) of at most ``leaf`` characters
are halved wherever the middle falls; a window there reaches from the start of a
unit on the left to the start of a unit on the right, where the tokenizer splits
whatever stands around, and it agrees if what it leaves out is encoded as the
sides have it. Longer units are unsplit text: their pre-tokens above that length
are halved, and a window agrees as soon as it starts with the left side's token
and ends with the right side's, as a BPE encoding is right exactly if each pair
of neighbouring tokens is. A window that never agrees grows to both sides whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import WHITE_SPACE, small_batches, table, text_or_empty
from wavesift.llm.unit_encoder import UNIT, byte_letters, unit_encoder

TOKENIZER = "byte_bpe_50k.json"
LEAF = 4096

#: Where a unit starts, whatever stands further off: white space after other characters.
UNIT_START = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_TEXTS = ", ids binary, decoded string"


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def decode(ids: np.ndarray, path: str) -> str:
    """As the library's decode(ids, skip_special_tokens=False); bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=8)
def long_run(leaf: int) -> re.Pattern:
    """What a unit of more than ``leaf`` characters has: white space or other characters of more than half that length.

    Tried where a run starts only, so in linear time.
    """
    n = leaf // 2 + 1
    return re.compile(f"(?<![^{WHITE_SPACE}])[^{WHITE_SPACE}]{{{n},}}|(?<![{WHITE_SPACE}])[{WHITE_SPACE}]{{{n},}}")


def halves(piece: str, leaf: int) -> list[str]:
    """``piece`` halved until no part is longer than ``leaf``."""
    if len(piece) <= leaf:
        return [piece]
    middle = len(piece) // 2
    return halves(piece[:middle], leaf) + halves(piece[middle:], leaf)


def join_sides(left: list[int], right: list[int], letters: Callable[[int], str], encode: Callable[[str], list[int]]) -> list[int]:
    """The encoding of both sides' text in one, from the encodings of the sides."""
    k = 2
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = encode("".join(map(letters, left[len(left) - a :] + right[:b])))
        agrees = (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1])
        if agrees:
            return left[: len(left) - a] + window + right[b:]
        k *= 2


def up_the_tree(leaves: list, join: Callable) -> list[int]:
    """Neighbours joined level by level."""
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [join(*p) if len(p) == 2 else p[0] for p in pairs]
    return leaves[0]


class TreeEncoder:
    """Parts of a text with long units, the ids of a part, and their concatenation."""

    def __init__(self, path: str):
        self.units = unit_encoder(path)
        self.tokenizer = self.units.tokenizer
        self.specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile(f"({'|'.join(map(re.escape, sorted(self.specials, key=len, reverse=True)))})" if self.specials else "((?!))")
        self.bytes = token_bytes(path)

    def packed(self, ids: bytes) -> bytes:
        """Ids in half the bytes where the vocabulary allows, for the way between tasks."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if len(self.bytes) <= 1 << 16 else ids

    def unpacked(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(self.bytes) <= 1 << 16 else ids

    def letters(self, i: int) -> str:
        return self.tokenizer.id_to_token(i)

    def encode_piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def parts(self, text: str, leaf: int) -> Iterator[tuple[str, int, str]]:
        """(kind, group, content) in order; leaves of one group are joined.

        'text' leaves are halves of units of at most ``leaf`` characters, 'pieces'
        the short pre-tokens of a longer unit, 'leaf' the halves of a long one.
        """
        group = at = 0
        for m in UNIT.finditer(text) if long_run(leaf).search(text) else ():
            if m.end() - m.start() <= leaf:
                continue
            if at < m.start():
                yield from (("text", group, x) for x in halves(text[at : m.start()], leaf))
            group, at = group + 1, m.end()
            for own in filter(None, self.special.split(m[0])):
                if own in self.specials:
                    yield "text", group, own
                    group += 1
                    continue
                short: list[str] = []
                size = 0
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(own):
                    if short and size + len(piece) > leaf:
                        yield "pieces", -1, " ".join(short)
                        short, size = [], 0
                    if len(piece) <= leaf:
                        short.append(piece)
                        size += len(piece)
                        continue
                    yield from (("leaf", group, x) for x in halves(piece, leaf))
                    group += 1
                if short:
                    yield "pieces", -1, " ".join(short)
        if at < len(text):
            yield from (("text", group, x) for x in halves(text[at:], leaf))

    def encode_part(self, kind: str, content: str) -> bytes:
        if kind == "text":
            return self.units.encode(content)
        return np.array([i for p in content.split(" ") for i in self.encode_piece(p)], "<u4").tobytes()

    def join_texts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of both sides' text in one, from the encodings of the sides."""
        k = 16
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            before, after = (b"".join(map(self.bytes.__getitem__, x.tolist())).decode("utf-8", "ignore") for x in (left[len(left) - a :], right[:b]))
            start, end = UNIT_START.search(before), None
            for end in UNIT_START.finditer(after):
                pass
            p = 0 if a == len(left) else start and start.end()
            q = len(after) if b == len(right) else end and end.end()
            if p is not None and q is not None:
                tail, head = self._ids(before[p:]), self._ids(after[:q])
                if np.array_equal(left[len(left) - len(tail) :], tail) and np.array_equal(right[: len(head)], head):
                    return np.concatenate([left[: len(left) - len(tail)], self._ids(before[p:] + after[:q]), right[len(head) :]])
            k *= 2

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.units.encode(text), "<u4")

    def concatenate(self, parts: list[tuple[str, int, bytes]]) -> bytes:
        """Ids of the whole text from (kind, group, ids) in order."""
        out: list[bytes] = []
        i = 0
        while i < len(parts):
            kind, group, ids = parts[i]
            j = i + 1
            while kind != "pieces" and j < len(parts) and parts[j][:2] == (kind, group):
                j += 1
            if j > i + 1:
                leaves = [np.frombuffer(p[2], "<u4") for p in parts[i:j]]
                if kind == "text":
                    ids = up_the_tree(leaves, self.join_texts).astype("<u4").tobytes()
                else:
                    join = lambda x, y: join_sides(x, y, self.letters, self.encode_piece)
                    ids = np.array(up_the_tree([x.tolist() for x in leaves], join), "<u4").tobytes()
            out.append(ids)
            i = j
        return b"".join(out)

    def encode(self, text: str, leaf: int) -> bytes:
        """All steps in one process."""
        return self.concatenate([(kind, group, self.encode_part(kind, x)) for kind, group, x in self.parts(text, leaf)])


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def _row(doc_id, raw: bytes, path: str, with_texts: bool) -> tuple:
    text = decode(np.frombuffer(raw, "<u4"), path)
    digests = (doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return digests + ((raw, text) if with_texts else ())


def bpe_round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, leaf: int = LEAF, with_texts: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Null counts as empty: no tokens, and the digest of nothing. Repeated rows
    each give a row, an empty table none; other columns are ignored. Texts of more
    than ``leaf`` characters go through the tree, whatever they are made of.
    ``with_texts`` adds ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.
    """
    schema = DIGESTS + (_TEXTS if with_texts else "")
    names = [f.split()[0] for f in schema.split(", ")]
    own = small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    long = F.length("text") > leaf

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = public_tokenizers.path(tokenizer)
        encoder = unit_encoder(path)
        for pdf in batches:
            rows = [_row(d, encoder.encode(t), path, with_texts) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tree_encoder(public_tokenizers.path(tokenizer))
        rows = (
            (doc_id, row, part, *own)
            for pdf in batches
            for doc_id, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True)
            for part, own in enumerate(encoder.parts(text, leaf))
        )
        while few := list(islice(rows, 1024)):
            yield pd.DataFrame(few, columns=["doc_id", "row", "part", "kind", "group", "content"]).astype({"doc_id": "Int64"})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tree_encoder(public_tokenizers.path(tokenizer))
        for pdf in batches:
            ids = [encoder.packed(encoder.encode_part(k, x)) for k, x in zip(pdf["kind"], pdf["content"], strict=True)]
            yield pdf.drop(columns="content").assign(ids=ids)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in the order of (row, part): one text after the other."""
        path = public_tokenizers.path(tokenizer)
        encoder = tree_encoder(path)
        parts = (x for pdf in batches for x in zip(pdf["row"], pdf["doc_id"], pdf["kind"], pdf["group"], pdf["ids"], strict=True))
        texts = (list(own) for _, own in groupby(parts, key=itemgetter(0)))
        rows = (_row(own[0][1], encoder.concatenate([(k, g, encoder.unpacked(i)) for *_, k, g, i in own]), path, with_texts) for own in texts)
        while few := list(islice(rows, 64)):
            yield pd.DataFrame(few, columns=names).astype({"doc_id": "Int64"})

    # Bytes are few for the work they make: with a number of tasks, adaptive execution does not merge them.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "doc_id long, row long, part int, kind string, `group` int"
    short = own.filter(~long).mapInPandas(whole, schema)
    long_ = (
        own.withColumn("row", F.monotonically_increasing_id()).filter(long)
        .mapInPandas(split, f"{fields}, content string")
        .repartition(tasks, "row", "part")  # leaves of one text go to many tasks
        .mapInPandas(encode, f"{fields}, ids binary")
        .repartition(tasks, "row").sortWithinPartitions("row", "part")
        .mapInPandas(join, schema)  # one text at a time
    )
    return short.unionByName(long_)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
