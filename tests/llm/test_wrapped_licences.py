"""Licence notices beyond single lines with a licence word."""

import textwrap

import pytest

from wavesift.llm import licence_scan as L

LONG = [(f, t) for f, ts in L.TEMPLATES.items() for t in ts if len(t) > 100]


def licences(spark, texts: list[str]) -> list[str]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.licence_scan(df).collect()}
    assert len(got) == len(texts)
    assert all(r["n_candidates"] == r["n_unknown"] + r["n_unconfirmed"] + r["n_confirmed"] for r in got.values())
    return [got[i]["licences"] for i in range(len(texts))]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices_are_found(spark, mark):
    head, tail = "int main() { return 0; }", "The village lies in a valley.\nMany people go there."
    wrapped = ["\n".join(mark + line for line in textwrap.wrap(t, 72)) for _, t in LONG]
    for glue in ("\n\n", "\n", f"\n{mark}\n"):
        assert licences(spark, [glue.join((head, w, tail)) for w in wrapped]) == [f for f, _ in LONG]


def test_lines_count_once(spark):
    """Lines that confirm by themselves, also repeated ones, give no wrapped notice beside them."""
    line = LONG[0][1]
    df = spark.createDataFrame([(0, f"{line}\n{line}\nNothing else."), (1, "\n".join(textwrap.wrap(line, 72)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_confirmed"], r["licences"]) for r in L.licence_scan(df).collect()}
    assert got == {0: (2, LONG[0][0]), 1: (1, LONG[0][0])}


def test_notices_without_a_raw_stem_are_found(spark):
    texts = {
        "This work is released into the public-domain.": "public-domain", "All  rights  reserved.": "reserved",
        "Available under CC BY-SA 3.0.": "cc-by", "Released under CC BY-NC-ND 4.0.": "cc-by-nc", "He took the bus to work.": "",
    }
    assert licences(spark, [f"Some words before.\n{t}\nAnd after." for t in texts]) == list(texts.values())


def test_the_gate_drops_only_what_cannot_be_confirmed():
    words = set(L.gate_words())
    for _, texts in L.TEMPLATES.items():
        for t in texts:
            own = L.trigrams(L.tokens(t))
            assert 100 * sum(not words & set(g.split(" ")) for g in own) < L.CONFIRM_PERCENT * len(own)
