"""Labelled findings for the secret network: made from rules and a seed.

A finding is (before, candidate, after, label). Secrets are keys of common
formats, in assignments or alone; the rest is what looks like them: card and
phone numbers, addresses, times, paths, versions, file names, identifiers and
long words.
"""

from __future__ import annotations

import random
import string

_LOWER, _UPPER, _DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits
_HEX, _ALNUM, _LETTERS = _DIGIT + "abcdef", string.ascii_letters + _DIGIT, string.ascii_letters

#: Heads of well-known key formats, with the alphabet and length of what follows.
KEY_FORMATS = (
    ("ghp_", _ALNUM, 36),
    ("gho_", _ALNUM, 36),
    ("xoxb-", _ALNUM + "-", 48),
    ("sk-", _ALNUM, 48),
    ("sk_live_", _ALNUM, 24),
    ("AIza", _ALNUM + "_-", 35),
    ("glpat-", _ALNUM + "_-", 20),
    ("npm_", _ALNUM, 36),
    ("AKIA", _UPPER + _DIGIT, 16),
    ("eyJ", _ALNUM + "_-", 60),
    ("", _ALNUM + "+/", 40),
    ("", _ALNUM + "+/", 64),
    ("", _ALNUM, 32),
    ("", _HEX, 40),
    ("", _HEX, 64),
    ("", _HEX.upper(), 40),
    ("glpat-", _LETTERS, 20),
    ("ghp_", _LETTERS, 36),
    ("sk-", _LETTERS, 32),
    ("", _LETTERS, 20),
    ("", _LETTERS, 32),
    ("", _ALNUM, 20),
    ("", _ALNUM + "_-", 24),
    ("", _ALNUM + "_-", 43),
    ("", _HEX, 32),
    ("hf_", _LETTERS, 34),
    ("SG.", _ALNUM + "_-", 40),
    ("whsec_", _ALNUM + "+/", 32),
    ("xapp-1-", _UPPER + _DIGIT + "-", 40),
    ("pypi-", _ALNUM + "_-", 60),
    ("dop_v1_", _HEX, 64),
)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "Authorization: Bearer", "private_key", "access_key", "pwd", "credential")
_SYLLABLES = ("an", "er", "the", "on", "re", "ou", "la", "de", "en", "ti", "sh", "ing", "os", "ge", "ich", "ver", "aux", "ción", "est", "ment", "sch", "pf", "heit", "ung", "ber", "ach", "lich", "tz", "str", "gen", "wyn", "gw", "ll", "dro", "quer", "tum", "aft", "sub", "pre", "tri", "ight", "ough", "land", "berg", "mann", "ovic", "ski", "du", "po", "ha", "mi", "ka", "ro", "bri", "ck", "ff", "mp", "eau", "oi", "que", "cht")


def _of(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _word(rng: random.Random, least: int = 1, most: int = 4) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(least, most)))


def _prose(rng: random.Random) -> str:
    end = rng.choice((" ", " ", ". ", ", ", "\n", " | ", "*** "))
    return " ".join(_word(rng) for _ in range(rng.randint(0, 8))) + end


def _ascii(word: str) -> str:
    return word.encode("ascii", "ignore").decode()


def _password(rng: random.Random) -> str:
    """What people and tools choose: words with numbers and signs, or random characters."""
    if rng.random() < 0.4:
        return "".join(rng.choice((w.capitalize(), w)) for w in (_ascii(_word(rng, 1, 2)) or "er", _ascii(_word(rng, 1, 2)) or "on")) + rng.choice("._-+=/") * rng.randint(0, 1) + _of(rng, _DIGIT, rng.randint(1, 5))
    return _of(rng, _ALNUM + "_-.+", rng.randint(8, 28))


def _secret(rng: random.Random) -> tuple[str, str, str, int]:
    head, alphabet, n = rng.choice(KEY_FORMATS)
    key = head + _of(rng, alphabet, n + rng.randint(0, 4) * (not head))
    before, after = _prose(rng), " " + _prose(rng)
    kind = rng.random()
    if kind < 0.45:
        name, quote = rng.choice(_NAMES), rng.choice(('"', "'", ""))
        if rng.random() < 0.3:
            name = rng.choice((name.upper(), name.capitalize(), "export " + name.upper(), '"' + name + '"', "  " + name))
        return before + name + rng.choice((" = ", "=", ": ", ":", " ")) + quote, _password(rng) if rng.random() < 0.2 else key, quote + after, 1
    if kind < 0.6:
        return before + rng.choice(("postgres", "https", "redis", "mysql", "amqp", "mongodb+srv", "http")) + "://" + (_ascii(_word(rng)) or "er") + rng.choice(("", _of(rng, _DIGIT, 2))) + ":", _password(rng), "@" + (_ascii(_word(rng)) or "er") + rng.choice((".net", ":5432/", ".example.com/x", "")) + after, 1
    return before + rng.choice(("", '"', "'", "(", "`", "Bearer ", "key ", "-H ", "= ")), key, rng.choice(("", '"', "'", ")", ".", "`", ",")) + after, 1


def _harmless(rng: random.Random) -> tuple[str, str, str, int]:
    w = lambda: _ascii(_word(rng, 2, 4)) or "er"
    c = lambda: w().capitalize()
    d = lambda n: _of(rng, _DIGIT, n)
    before, after = _prose(rng), " " + _prose(rng)
    forms = (
        lambda: d(16),
        lambda: d(rng.randint(16, 22)),
        lambda: "-".join(d(4) for _ in range(4)),
        lambda: f"{d(3)}.{d(3)}.{d(2)}.{d(3)}-{d(3)}.{d(2)}.{d(3)}.{d(1)}",
        lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}.{d(2)}.{d(2)}",
        lambda: "/".join(["", "usr", w(), w() + d(1), f"{w()}-{d(1)}.{d(2)}.tar.gz"]),
        lambda: f"{w()}-{w()}-{d(1)}.{d(2)}.{d(1)}-linux-x86_64",
        lambda: f"{w()}_{w()}_{w()}_{d(rng.randint(1, 3))}",
        lambda: w() + w().capitalize() + w().capitalize() + w().capitalize() + d(1),
        lambda: ".".join([w(), w().capitalize(), w(), w()]) + d(1),
        lambda: f"www.{w()}{w()}.example.com/en/{d(3)}.html",
        lambda: f"{w()}/{w()}/{w()}?page={d(1)}",
        lambda: w() + w() + w() + w() + w() + d(1),
        lambda: (w() + w() + w() + w()).upper() + "." + w().upper() + d(1),
        lambda: f"+1{d(10)}-{d(6)}",
        lambda: "=" * rng.randint(16, 40),
        lambda: "-".join(w() for _ in range(4)) + "-" + d(2),
        lambda: f"{d(rng.randint(6, 9))}.{d(rng.randint(8, 12))}",
        lambda: f"{w()}.{w()}.{d(2)}.{w()}@"[:-1],
        lambda: w() + w() + w() + w() + w() + w(),
        lambda: c() + w() + w() + w() + w(),
        lambda: (w() + w() + w() + w() + w()).upper(),
        lambda: f"{c()}-{c()}-{w()}-{w()}-{w()}",
        lambda: f"{w()}{w()}.{c()}{w()}{w()}",
        lambda: f"{w()}/{w()}/{c()}{c()}.java",
        lambda: f"org.{w()}.{w()}.{c()}{c()}",
        lambda: f"{w()}_{w()}_{w()}_{w()}",
        lambda: f"{w().upper()}_{w().upper()}_{w().upper()}",
        lambda: c() + c() + c() + rng.choice(("Exception", "Factory", "Service", "Handler")),
        lambda: f"{w()}.{d(2)}@"[:-1].rjust(16, "e"),
        lambda: f"{w()}=={d(1)}.{d(2)}.{d(1)}+{w()}{w()}",
        lambda: f"20{d(2)}-{d(2)}-{d(2)}/{w()}/{w()}",
        lambda: w() + "." * rng.randint(10, 20) + d(2),
        lambda: f"{w()}={w()}/{w()}/{w()}",
        lambda: f"//{w()}/{w()}/{c()}/{c()}/{w()}.{w()[:4]}",
        lambda: f"{d(4)}/{w()}/{w()}/{w()}",
        lambda: "-".join(c() for _ in range(4)),
        lambda: ".".join(w().upper() for _ in range(4)),
        lambda: f"{c()}{w()}{w()}{w()}",
        lambda: w() + w() + w() + w() + w(),
        lambda: d(16),
    )
    kind = rng.random()
    if kind < 0.12:  # what stands where a secret would
        name = rng.choice(_NAMES)
        value = rng.choice(("changeme", "your-token-here", "REPLACE_WITH_TOKEN", "xxxxxxxxxxxxxxxxxxxx", "string", "undefined", "None", "os.environ", "config.get", "secrets.PASSWORD", "process.env.API_KEY", "example", "required", "************", f"{w()}_{w()}", f"get_{w()}", w() + w(), f"{w()}.{w()}"))
        return before + name + rng.choice((" = ", "=", ": ", ":")) + rng.choice(('"', "")), value, rng.choice(('"', "")) + after, 0
    if kind < 0.2:  # digests that say what they are
        return before + rng.choice(("sha256:", "sha1 ", "commit ", "md5sum ", "Merge ", "rev ", "blob/", "checksum: ", "etag ", "integrity sha512-")), _of(rng, _HEX, rng.choice((24, 32, 40, 64))), after, 0
    if kind < 0.24:  # addresses with a port, no password
        return before + rng.choice(("http", "https")) + "://" + w() + ".net:", d(4) + "/" + w() + "/" + w() + "/" + w(), after, 0
    candidate = rng.choice(forms)()
    while len(candidate) < 16:
        candidate += d(16 - len(candidate)) if candidate[-1].isdigit() else w()
    return before, candidate, rng.choice(("", ",", ".", ")", "@mail.net", ":", "()")) + after, 0


def findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """``n`` labelled findings, half of them secrets."""
    rng = random.Random(seed)
    return [_secret(rng) if i % 2 else _harmless(rng) for i in range(n)]
