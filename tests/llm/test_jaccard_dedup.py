"""Near copies of the pipeline by exact 5-word Jaccard similarity, against all pairs in plain Python."""

import random

import numpy as np
import pytest

import corpus_pipeline
from wavesift.llm import exact_dedup, simhash_dedup
from wavesift.llm import jaccard_dedup as J
from wavesift.llm.simhash_dedup import fingerprint

SCHEMA = "doc_id long, text string, lang string"


def shingles_of(text: str) -> set[bytes]:
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def kept_by_all_pairs(rows: list[tuple[int, str]]) -> set[int]:
    sets, group = [shingles_of(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(d, least.get(g, d))
    return set(least.values())


def changed(rng: random.Random, ws: list[str], n: int) -> list[str]:
    """``ws`` with n words in a row replaced: n + 4 of its shingles go, as many come."""
    at = rng.randrange(len(ws) - n)
    return [*ws[:at], *(f"new{rng.random()}" for _ in range(n)), *ws[at + n :]]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), ["", None, " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(60):
        ws = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))]
        out += [" ".join(ws), *(" ".join(changed(rng, ws, rng.randrange(1, len(ws) // 8))) for _ in range(3))]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [3, J.BLOCK])
def test_one_of_each_class_stays(spark, rows, block):
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows] + [(0, rows[0][1], "de")], SCHEMA).repartition(3)
    got = [r["doc_id"] for r in J.drop_near_copies(docs, block=block).collect()]
    assert set(got) == kept_by_all_pairs(rows) and len(got) == len(set(got))  # of the repeated row one stays
    assert J.drop_near_copies(docs.limit(0)).count() == 0


def test_the_stage_links_what_simhash_does_not(spark):
    """A pair of similarity 0.8 and more whose SimHashes differ in more than 3 bits."""
    rng = random.Random(8)
    a = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    b = next(t for t in (" ".join(changed(rng, a.split(), 8)) for _ in range(50)) if (fingerprint(a) ^ fingerprint(t)).bit_count() > 3)
    assert len(shingles_of(a) & shingles_of(b)) >= 0.8 * len(shingles_of(a) | shingles_of(b))
    docs = spark.createDataFrame([(1, a, "en"), (2, b, "en"), (3, "other words only", "en")], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 3}


def test_index_and_tally_miss_hardly_any_pair_at_the_threshold():
    rng, missed, dropped, n = random.Random(4), 0, 0, 0
    while n < 1000:
        ws = [f"w{rng.random()}" for _ in range(90)]
        a, b = J.shingles(" ".join(ws)), J.shingles(" ".join(changed(rng, ws, 5)))
        common = len(set(a.tolist()) & set(b.tolist()))
        if 10 * common >= 8 * (len(a) + len(b) - common):
            n += 1
            x, y = J.positional_bytes(a), J.positional_bytes(b)
            missed += not any(x[k : k + J.WIDTH] == y[k : k + J.WIDTH] for k in range(0, J.POSITIONS, J.WIDTH))
            dropped += sum(p == q for p, q in zip(x, y, strict=True)) < J.LEAST
    assert missed <= 2 and dropped == 0


def test_the_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == kept_by_all_pairs(rows)


REPEATED = [(1, "a"), (5, "a"), (5, "b"), (7, "c"), (7, "c"), (None, "c"), (None, "d"), (None, "d"), (None, "e")]


@pytest.mark.parametrize("drop", [J.drop_near_copies, simhash_dedup.drop_near_copies, exact_dedup.drop_exact_copies])
def test_one_row_of_each_class_whatever_repeats(spark, drop):
    """Ids and rows that repeat, ids that are null, columns whose names the operators use; texts a to e are unlike."""
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcde"}
    clash = ["_key", "__key", "__KEY_", "node", "fp", "root", "text_hash", "__row", "__salt", "n"]
    docs = spark.createDataFrame([(i, text[c], "en", *[str(k)] * len(clash)) for k, (i, c) in enumerate(REPEATED)], SCHEMA + "".join(f", {c} string" for c in clash if c != "__KEY_") + ", other string")
    docs = docs.withColumnRenamed("other", "__KEY_")
    out = drop(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((c, r["doc_id"]) for r in out.collect() for c in "abcde" if text[c] == r["text"])
    largest = drop is exact_dedup.drop_exact_copies
    assert got == [("a", 5 if largest else 1), ("b", 5), ("c", 7), ("d", None), ("e", None)]
    assert sorted(map(repr, drop(docs.repartition(5)).collect())) == sorted(map(repr, out.collect()))  # ties are not left to chance


def test_positional_bytes_are_a_simhash_of_the_shingles():
    """Each bit is the majority of votes of distinct shingles: near copies differ in an angle's share of bits, others in half."""
    rng, own, other = random.Random(6), [], []
    for _ in range(40):
        ws = [f"w{rng.random()}" for _ in range(204)]
        a, b, c = (J.shingles(" ".join(x)) for x in (ws, changed(rng, ws, 18), ws[::-1]))  # a and b: 178 of 200 shingles each
        x, y, z = (np.unpackbits(np.frombuffer(J.positional_bytes(s), np.uint8)) for s in (a, b, c))
        own.append((x != y).mean())
        other.append((x != z).mean())
    assert abs(np.mean(own) - np.arccos(178 / 200) / np.pi) < 0.01 and abs(np.mean(other) - 0.5) < 0.01
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 3, 4, 300, 700)]
    for s in sets:  # votes add up: a bit that two halves agree on, the whole has, too
        x, y, whole = (np.unpackbits(np.frombuffer(J.positional_bytes(p), np.uint8)) for p in (s[: len(s) // 2], s[len(s) // 2 :], s))
        agree = x == y
        assert len(s) == 1 or (whole[agree] == x[agree]).all()


def test_components_of_keys_by_all_pairs():
    rng = np.random.default_rng(7)
    key = np.sort(rng.integers(0, 30, 400))
    base = rng.integers(0, 1 << 64, (8, 3), np.uint64)
    bits = base[rng.integers(0, 8, 400)]
    for _ in range(30):
        bits[np.arange(400), rng.integers(0, 3, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400, np.uint64)
    want = list(range(400))
    for i in range(400):
        for j in range(i):
            if key[i] == key[j] and np.bitwise_count(bits[i] ^ bits[j]).sum() <= J.MOST and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    got = J.components(key, *bits.T)
    assert got.tolist() == want and 30 < len(set(want)) < 400


def test_keys_of_many_texts_are_cut_without_loss(spark, rows):
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(3)
    got = [r["doc_id"] for r in J.drop_near_copies(docs, block=4, key_block=2).collect()]
    assert sorted(got) == sorted(kept_by_all_pairs(rows))


def test_recall_at_the_threshold_through_all_filters():
    """Pairs of exactly 0.8, short texts among them, through index, bits and tally."""
    rng, lost = np.random.default_rng(9), 0
    for k in range(2000):
        a, b, both = [(50, 50, 400), (0, 100, 400), (0, 1, 4), (1, 1, 8), (10, 0, 40)][k % 5]
        u = rng.integers(0, 1 << 64, a + b + both, np.uint64)
        x, y = J.positional_bytes(u[: a + both]), J.positional_bytes(u[a:])
        x_, y_ = (np.frombuffer(f, np.uint64) for f in (x, y))
        met = (J.index_keys(x) == J.index_keys(y)).any() and np.bitwise_count(x_[:3] ^ y_[:3]).sum() <= J.MOST
        lost += not (met and sum(p == q for p, q in zip(x, y, strict=True)) >= J.LEAST)
    assert lost <= 8  # 2 expected
