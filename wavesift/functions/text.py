"""Small parsers: index strings, headers, scan logs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_codes(s: Column, width: int = 0) -> Column:
    """The bytes of a text as numbers, with zeros up to ``width``; null stays null."""
    own = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.conv(F.hex(F.substring(F.encode(s, "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    own = F.when(F.octet_length(s) > 0, own).when(s.isNotNull(), F.array().cast("array<int>"))
    return F.concat(own, F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.octet_length(s), F.lit(0))))


def codes_text(codes: Column) -> Column:
    """The text of ``text_codes``; zeros are left out."""
    digits = F.transform(F.filter(codes, lambda x: x != 0), lambda x: F.lpad(F.hex(x), 2, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-8")


def str_to_range(s: str) -> list[int]:
    """'a', 'a:b' or 'a:b:c' as a list of indices, the end left out."""
    parts = [int(p) for p in s.split(":")]
    return [parts[0]] if len(parts) == 1 else list(range(*parts))


def str_to_index(s: str) -> tuple[slice | int, ...]:
    """A numpy-style index such as '2:4, :, 1' as a tuple of slices and numbers."""
    out: list[slice | int] = []
    for part in s.strip("[]() ").split(","):
        bits = [int(b) if b.strip() else None for b in part.split(":")]
        out.append(bits[0] if len(bits) == 1 and bits[0] is not None else slice(*bits))
    return tuple(out)


def parse_header(text: str) -> dict[str, str]:
    """'key = value ;' entries of an image header."""
    return {k.strip(): v.strip() for k, v in re.findall(r"([^=;{}\n]+)=([^;]*);", text)}


def parse_spec(text: str) -> dict[int, dict]:
    """Scans of a SPEC log: number -> command, date, motors' columns and rows of numbers."""
    scans: dict[int, dict] = {}
    own: dict | None = None
    for line in text.splitlines():
        if line.startswith("#S "):
            number, command = line[3:].split(maxsplit=1)
            own = scans[int(number)] = {"command": command, "labels": [], "data": []}
        elif own is None:
            continue
        elif line.startswith("#D "):
            own["date"] = line[3:]
        elif line.startswith("#L "):
            own["labels"] = re.split(r"\s{2,}", line[3:].strip())
        elif line and not line.startswith("#"):
            own["data"].append([float(x) for x in line.split()])
    return scans
