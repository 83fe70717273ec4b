"""Encoders that give the tokenizers library's ids of whole texts, fast.

A unit is a run of white space and the run of other characters after it. Both
tokenizers here split text before each unit, whatever stands around it, so the
ids of a text are those of its units in a row, and units repeat a great deal.
Texts of Latin-1 characters, whose classes all Unicode versions agree on, take
shorter ways to the same ids: the byte-level vocabulary through tiktoken with
the same merges, the word vocabulary through its pieces.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

from wavesift.llm._common import WHITE_SPACE

UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

#: Strings of up to this many characters are kept, at most twice this many of them.
SHORT = 48
KEPT = 150_000


class Recent(dict):
    """What ``make`` gives for a key. When full, what was not asked for since the last time is forgotten."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = Recent(lambda u: np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))


class ByteEncoder(UnitEncoder):
    """Byte-level vocabularies whose ids are in the order of their merges."""

    def __init__(self, path: str, spec: dict, pattern: str, ranks: dict[bytes, int]):
        super().__init__(path)
        import tiktoken

        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.direct = tiktoken.Encoding("same-merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)

    def encode(self, text: str) -> bytes:
        if is_latin_1(text):
            return self.direct.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return super().encode(text)


#: Fixed value: how the word vocabulary cuts normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"  # of Latin-1 in lower case
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\\t-\\r \\x85\\xa0]+")


class WordEncoder(UnitEncoder):
    """The word vocabulary: lower case, pieces of letters, single numbers and runs of signs."""

    def __init__(self, path: str, letters: dict[int, str]):
        super().__init__(path)
        self.letters, self.model = letters, self.tokenizer.model
        self.pieces = Recent(self._piece, 3 * KEPT // 2)
        self.words = Recent(lambda u: b"".join(map(self.pieces.__getitem__, _PIECE.findall(u))))

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not is_latin_1(text):  # the start of a special token's name
            return super().encode(text)
        return b"".join(map(self.words.__getitem__, text.lower().split(" ")))


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token by id, where ids follow the order of merges: only then do ranks say the same as merges."""
    model, letters = spec["model"], byte_letters()
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("end_of_word_suffix") or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    """The fastest encoder that is exact for the vocabulary; one for each worker process."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and (ranks := merge_ranks(spec)):
        return ByteEncoder(path, spec, public_tokenizers.PATTERN, ranks)
    cut = pre.get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if cut == WORD_PATTERN and kinds == ["NFC", "Replace", "Lowercase"] and all(t["content"].startswith("<|") for t in spec["added_tokens"]):
        return WordEncoder(path, {b: c for c, b in byte_letters().items()})
    return UnitEncoder(path)
