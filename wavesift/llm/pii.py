"""Personal details replaced with keyed surrogates.

Detected entities are mail addresses, phone numbers, network addresses (IPv4, IPv6,
MAC), card numbers, other personal numbers, and names (after a title or a phrase such as
"my name is", or a given name of a short list with a family name). Letters and
decimal digits count whatever their script, also mixed. Words of a name that a
text gives once are found wherever else it has them. A surrogate depends on the
key and the entity alone, and the entities of a format are one to one with their
surrogates: an entity is the same person everywhere in the corpus, and no two
share a surrogate. The key comes from outside; whoever has it can undo surrogates.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import surrogates as S
from wavesift.llm._common import small_batches, table, text_or_empty

#: Setting with the key in hex. Spark leaves settings with this word in their name out of logs and pages.
KEY_SETTING = "spark.wavesift.surrogates.secret"
KINDS = ("email", "phone", "ip", "card", "number", "name")
#: Where entities overlap, the kind that comes first here holds.
PRECEDENCE = ("email", "ip", "number", "card", "phone", "name")

# Letters, digits, underscores and combining marks of every script.
_W = r"[\w\u0300-\u036f]"
EMAIL = re.compile(rf"(?<![\w\u0300-\u036f.%+-]){_W}[\w\u0300-\u036f.%+'’-]*@{_W}(?:[\w\u0300-\u036f-]*{_W})?(?:\.{_W}(?:[\w\u0300-\u036f-]*{_W})?)*\.[^\W\d_]{{2,}}")
_DIGIT_FORMS = (
    ("ip", r"(?<![\w:.-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![\w:-])|(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])"),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)"),
    ("number", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])"),
    ("phone", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w])|(?<![\w.+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w])|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
)
DIGITS = tuple((kind, re.compile(p)) for kind, p in _DIGIT_FORMS)

#: Titles that come before a name, by gender.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Señora", "Sra", "Doña", "госпожа"), "m": ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Don", "господин"), "": ("Dr", "Prof")}


def _letters(fits, end: int) -> str:
    """The letters below ``end`` that fit, as the body of a character class."""
    own = [c for c in range(end) if fits(chr(c))]
    starts = [c for c in own if c - 1 not in set(own)] if len(own) < 5000 else []
    return "".join(f"{chr(a)}-{chr(next(c for c in range(a, end + 1) if c not in set(own)) - 1)}" for a in starts)


#: Capitals and small letters of the scripts below U+0590 (Latin, Greek, Cyrillic, Armenian) and of further Latin.
_UP, _LOW = (_letters(f, 0x590) + more for f, more in ((str.isupper, "\u1e9e"), (str.islower, "\u0300-\u036f")))
_CAP = rf"[{_UP}][{_LOW}'’-]+"
#: A word of a script without capitals: Hebrew to Indic and Thai, kana, Chinese characters, Hangul.
_UNCASED = r"[\u05d0-\u05ea\u0620-\u064a\u0900-\u0e4e\u3041-\u30ff\u3400-\u9fff\uac00-\ud7a3]{2,}"
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\.? ({_CAP})(?: ({_CAP}))?(?: ({_CAP}))?")
#: Phrases that say a name comes next.
CUES = ("my name is", "My name is", "Name:", "name:", "Dear", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут")
CUED = re.compile(rf"(?<!\w)(?:{'|'.join(CUES)}) ({_CAP}(?: {_CAP}){{0,2}}|{_UNCASED})")
NAMED = re.compile(rf"(?<!\w)({'|'.join(sorted(S.GENDER_OF, key=len, reverse=True))}) ({_CAP})")


_WORD = re.compile(rf"(?<!\w){_CAP}|(?<!\w)[{_UP}]{{3,}}(?!\w)|{_UNCASED}")
_DIGIT = re.compile(r"\d|::|[A-Fa-f]:")
#: Words after a phrase or title that are no names.
NO_NAMES = frozenset("sir madam all friends team colleagues customer reader editor friend members students parents the and".split())


def _bare(text: str, start: int, end: int) -> int:
    """The end without a genitive, hyphens and apostrophes."""
    if text[end - 2 : end] in ("'s", "’s"):
        end -= 2
    while end > start and text[end - 1] in "'’-":
        end -= 1
    return end


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps, in order."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in DIGITS:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    for pattern, group in ((TITLED, 2), (CUED, 1), (NAMED, 1)):
        for m in pattern.finditer(text):
            end = _bare(text, m.start(group), m.end())
            if text[m.start(group) : end].split(" ")[0].lower() not in NO_NAMES:
                found.append((m.start(group), end, "name"))
    names = {w.lower() for a, b, k in found if k == "name" for w in text[a:b].split(" ") if len(w) > 2}
    order = {k: i for i, k in enumerate(PRECEDENCE)}
    ranked = [(order[k], a, -b, k) for a, b, k in found]
    if names:  # later and earlier mentions
        for m in _WORD.finditer(text):
            end = _bare(text, *m.span())
            if m[0][: end - m.start()].lower() in names:
                ranked.append((len(order), m.start(), -end, "name"))
    taken: list[tuple[int, int, str]] = []
    for _, group in groupby(sorted(ranked), key=lambda x: x[0]):
        # Spans of one rank come in order, so what is taken is swept once with them.
        new, at, end = [], 0, -1
        for _, a, b, k in group:
            b = -b
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if a >= end and (at == len(taken) or b <= taken[at][0]):
                new.append((a, b, k))
                end = b
        taken = sorted(taken + new)
    return taken


def surrogate(entity: str, kind: str, key: bytes) -> str:
    """What stands for ``entity``: depends on nothing else but the key."""
    if kind == "name":
        return " ".join(S.name_word(w, key) for w in entity.split(" "))
    return S.in_script_of(getattr(S, kind)(S.plain_digits(entity), key), entity)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]], int]:
    """The text with surrogates, the entities that it had, and how many of these share a surrogate.

    The last is the collision check. It counts entities, by their small letters;
    permutations are one to one, so it is 0.
    """
    spans = entities(text)
    out, at, of = [], 0, {}
    for a, b, kind in spans:
        old = text[a:b]
        if (kind, old) not in of:
            of[kind, old] = surrogate(old, kind, key)
        out += [text[at:a], of[kind, old]]
        at = b
    fold = lambda kind, x: x.lower() if kind == "name" else x
    olds, news = {(k, fold(k, x)) for k, x in of}, {fold(k, y) for (k, _), y in of.items()}
    return "".join([*out, text[at:]]), spans, len(olds) - len(news)


RESULT = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, n_collisions long, entities string, text string, text_sha256 string"


def surrogate_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """Every whole text with its personal details replaced under ``key`` (16 bytes or more, kept by the caller).

    Null counts as empty. Repeated rows each give a row, an empty table none;
    other columns are ignored. Entities are given as kind:start:end in the code
    points of the original text, ends exclusive. Of entities that overlap the first
    in PRECEDENCE holds, then the first in the text, then the longest. Texts of any
    length take time in proportion to it.

    Columns: doc_id, n_email, n_phone, n_ip, n_card, n_number, n_name,
    n_collisions, entities, text, text_sha256.
    """
    key = S.check_key(key)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                new, spans, collisions = replace(text, key)
                kinds = [s[2] for s in spans]
                where = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), collisions, where, new, hashlib.sha256(new.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, RESULT)


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; without one a random key, so that surrogates hold for this call only."""
    given = spark.conf.get(KEY_SETTING, "")
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_pii(table(spark, sf_dir, "documents"), session_key(spark))
