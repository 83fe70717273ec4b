"""Keyed surrogates: what a personal detail is replaced with.

A detail is a string of characters, each of a class (digits, small letters,
vowels, ...). The strings of one format are permuted among themselves by one
cycle: a keyed Feistel network over the characters, a step of one, and the
network's inverse. So different details of a format have different surrogates,
no detail is its own (where a format has more than one string), and the same
detail has the same surrogate in every document, whatever stands beside it. The
network works on characters, not on one large number: its time is linear and all
of a detail changes at any length.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_RADIX = {c: a for a in (LOWER, UPPER, DIGITS) for c in a}
#: Letters that take one another's places in names: what is spoken stays speakable, and in its script.
_SPOKEN = {c: a for a in ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ") for c in a}
_HEX = {c: a for a in ("abcdef", "ABCDEF", DIGITS) for c in a}
ROUNDS = 8
#: Shorter keys are refused.
KEY_BYTES = 16

# Our own lists: common given names by (script, gender), and family names by script.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Beatrice Camille Carla Carmen Caroline Charlotte Claire Clara Elena Elisabeth Emily Emma Eva Greta Hannah Helen Ingrid Isabel Jane Julia Karin Katharina Laura Linda Lucia Margaret Maria Marie Martha Mary Monica Nina Olivia Paula Rosa Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andreas Antonio Arthur Benjamin Carlos Charles Daniel David Diego Edward Emil Felix Francisco Frank George Hans Henri Henry Hugo Jack James Jean Johann John Jonas Jorge Juan Karl Louis Lucas Luis Marcel Mark Martin Michael Miguel Oscar Otto Pablo Paul Peter Pierre Richard Robert Samuel Stefan Thomas Victor William".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Екатерина Елена Ирина Людмила Мария Наталья Нина Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Степан Юрий".split(),
}
FAMILY = {
    "latin": "Abbott Alonso Baker Bauer Becker Bernard Blanco Brandt Carter Castro Clarke Cole Costa Davies Dubois Duval Ellis Evans Fischer Fletcher Fontaine Foster Garnier Gomez Graham Haas Harper Hoffmann Hughes Iglesias Jensen Keller Koch Lambert Lang Lopez Marchand Mason Mercier Molina Morgan Navarro Newman Ortega Palmer Parker Perrin Prieto Quinn Ramos Renard Richter Rivera Roche Russell Sanders Schmitt Serrano Spencer Torres Turner Vega Vogel Wagner Walker Weber Winter Wood".split(),
    "cyrillic": "Абрамов Белов Волков Громов Данилов Егоров Жуков Зайцев Исаев Козлов Лебедев Морозов Новиков Орлов Павлов Романов Соколов Титов Фомин Чернов".split(),
}
GENDER_OF = {name: key for key, names in GIVEN.items() for name in names}
#: The list that a name is in, by the name in small letters.
_LIST_OF = {name.lower(): (f"given|{script}|{gender}", names) for (script, gender), names in GIVEN.items() for name in names}
_LIST_OF |= {name.lower(): (f"family|{script}", names) for script, names in FAMILY.items() for name in names}


def check_key(key: bytes) -> bytes:
    if not isinstance(key, bytes) or len(key) < KEY_BYTES:
        raise ValueError(f"surrogates need a secret key of at least {KEY_BYTES} bytes")
    return key


def _network(symbols: np.ndarray, radix: np.ndarray, key: bytes, tweak: str, back: bool) -> np.ndarray:
    """Feistel over two halves of the characters: each round shifts one by a stream that the other keys."""
    cut, size = len(symbols) // 2, len(symbols)
    halves = [slice(0, cut), slice(cut, size)]
    out = symbols.copy()
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = halves[i % 2], halves[1 - i % 2]
        n = out[own].size
        if not n:
            continue
        seed = hashlib.blake2b(b"%d|%d|" % (i, size) + tweak.encode() + b"|" + out[other].astype("<u1").tobytes(), key=hashlib.sha256(key).digest()).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * n), "<u4").astype(np.int64)
        out[own] = (out[own] - stream if back else out[own] + stream) % radix[own]
    return out


def cycle(symbols: np.ndarray, radix: np.ndarray, key: bytes, tweak: str, fits: Callable[[np.ndarray], bool] = lambda _: True) -> np.ndarray:
    """The next one of a keyed cycle through all strings of ``radix`` that ``fits`` holds for; ``symbols`` must be one of them."""
    at = _network(symbols, radix, key, tweak, False)
    while True:
        for k in range(len(at)):  # a step of one, with carry
            at[k] = (at[k] + 1) % radix[k]
            if at[k]:
                break
        out = _network(at, radix, key, tweak, True)
        if fits(out):
            return out


@lru_cache(maxsize=4096)
def letters_like(c: str) -> str:
    """The letters of a character's script and case near it: those of its 128 code points; empty for what is no letter.

    A small letter has ones beside it whose capital is one letter, too, and gives them back.
    """
    kind = unicodedata.category(c)
    if kind not in ("Lu", "Ll", "Lo") or c in _RADIX:
        return ""

    def pairs(x: str) -> bool:
        other = x.lower() if kind == "Lu" else x.upper()
        return kind == "Lo" or len(other) == 1 and other != x and other.swapcase() == x

    first = ord(c) & ~0x7F
    near = [x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in _RADIX and pairs(x)]
    return "".join(near) if c in near else ""


def plain_digits(text: str) -> str:
    """Decimal digits of every script as 0 to 9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def in_script_of(out: str, text: str) -> str:
    """``out`` with its digits in the script of those that ``text`` has in their places."""
    if text.isascii() or len(out) != len(text):
        return out
    return "".join(chr(ord(t) - unicodedata.decimal(t) + int(c)) if t.isdecimal() and c in DIGITS else c for c, t in zip(out, text, strict=True))


def same_format(text: str, key: bytes, tweak: str, fits: Callable[[str], bool] = lambda _: True, classes: dict[str, str] = _RADIX) -> str:
    """Characters change within their class, letters without one among those of their script near them; all else stays.

    The format is part of the tweak.
    """
    sets = [classes.get(c) or letters_like(c) for c in text]
    where = [i for i, s in enumerate(sets) if s]
    if not where:
        return text
    symbols = np.array([sets[i].index(text[i]) for i in where], np.int64)
    radix = np.array([len(sets[i]) for i in where], np.int64)

    def spell(x: np.ndarray) -> str:
        out = list(text)
        for i, v in zip(where, x.tolist(), strict=True):
            out[i] = sets[i][v]
        return "".join(out)

    form = "".join(s[0] if s else c for c, s in zip(text, sets, strict=True))
    return spell(cycle(symbols, radix, key, f"{tweak}|{form}", lambda x: fits(spell(x))))


def luhn_rest(digits: str) -> int:
    """0 where the Luhn check holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def luhn(digits: str) -> bool:
    return luhn_rest(digits) == 0


def email(text: str, key: bytes) -> str:
    """Local part and domain labels change in their format; the top-level domain stays."""
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    head = same_format(".".join(labels[:-1]), key, "domain")
    return f"{same_format(local, key, 'local')}@{head}.{labels[-1]}"


def phone(text: str, key: bytes) -> str:
    """All digits but those of the country code."""
    at = 0
    if text.startswith("+"):
        at = next((i for i, c in enumerate(text) if i and not c.isdigit()), min(3, len(text)))
    return text[:at] + same_format(text[at:], key, "phone|" + text[:at])


def card(text: str, key: bytes) -> str:
    """All digits but the last, which keeps its distance from the check digit: valid numbers give valid ones."""
    last = max(i for i, c in enumerate(text) if c in DIGITS)
    digits = lambda s: "".join(c for c in s if c in DIGITS)
    rest = luhn_rest(digits(text))
    head = same_format(text[:last], key, f"card|{rest}")
    check = (rest - luhn_rest(digits(head) + "0")) % 10
    return head + str(check) + text[last + 1 :]


#: The least number and how many there are of 1, 2 and 3 digits in an address.
_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def ip(text: str, key: bytes) -> str:
    """Another address whose octets have as many digits each; valid ones stay valid. Hexadecimal ones (IPv6, MAC) keep their format."""
    if ":" in text or "-" in text:
        return same_format(text, key, "ip|hex", classes=_HEX)
    octets = text.split(".")
    forms = [_OCTETS.get(len(o)) for o in octets]
    if not all(f and 0 <= int(o) - f[0] < f[1] for o, f in zip(octets, forms, strict=True)):
        return same_format(text, key, "ip|odd", lambda s: not all(str(int(o)) == o and int(o) < 256 for o in s.split(".")))
    symbols, radix = (np.array(x, np.int64) for x in zip(*((int(o) - f[0], f[1]) for o, f in zip(octets, forms, strict=True)), strict=True))
    out = cycle(symbols, radix, key, f"ip|{[len(o) for o in octets]}")
    return ".".join(str(v + f[0]) for v, f in zip(out.tolist(), forms, strict=True))


def iban_rest(text: str) -> int:
    """The remainder of an account number: two letters, two check digits, the rest."""
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def iban(text: str) -> bool:
    """Whether the check digits hold; each number has one pair of them."""
    return "02" <= text[2:4] <= "98" and iban_rest(text) == 1


def number(text: str, key: bytes) -> str:
    """Account numbers keep their country, and valid check digits stay valid; other numbers keep their format."""
    if not text[0].isalpha():
        return same_format(text, key, "number")
    if iban(text):
        rest = same_format(text[4:], key, f"iban|{text[:2]}")
        return f"{text[:2]}{98 - iban_rest(text[:2] + '00' + rest):02d}{rest}"
    return text[:2] + same_format(text[2:], key, f"iban|odd|{text[:2]}", lambda s: not iban(text[:2] + s))


@lru_cache(maxsize=64)
def _next_in_list(tweak: str, key: bytes) -> dict[str, str]:
    """A keyed cycle through the names of a list."""
    names = next(names for t, names in _LIST_OF.values() if t == tweak)
    order = sorted(names, key=lambda n: hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.sha256(key).digest()).digest())
    return {a.lower(): b.lower() for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def name_word(word: str, key: bytes) -> str:
    """The surrogate of one word of a name, wherever it stands.

    A listed name becomes the next of a cycle through its list (given names of its
    script and gender, family names of its script). Any other becomes a word of the
    same pattern of vowels and consonants; a vowel at its end, which often shows the
    gender, stays. Capitals are where they were. Lists and patterns never meet, so
    words are one to one, and small letters decide alone.
    """
    small = word.lower()
    if small in _LIST_OF:
        out = _next_in_list(_LIST_OF[small][0], key)[small]
        capital = out.upper() if len(word) > 1 and word.isupper() else out.capitalize()
        return capital
    if len(small) != len(word):  # letters whose small form is longer have no place in a pattern
        return same_format(word, key, "odd name", classes=_RADIX)
    ending = small[-1] if len(small) > 2 and small[-1] in "aeiouаеиоуыэюя" else ""
    stem = small[: len(small) - len(ending)]
    out = same_format(stem, key, f"name|{ending}", lambda x: x + ending not in _LIST_OF, _SPOKEN) + ending
    return "".join(c.upper() if w.isupper() else c for c, w in zip(out, word, strict=True))
