"""The trie, the n-gram join and whitening against brute-force versions, with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavesift.llm import ngram_join, prefix_trie, whitening

SF = "/root/testdata/sf0.001"
rng = random.Random(11)

# --- trie -----------------------------------------------------------------------------------------

TURNS = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "a b  c", "", None, "x\ty z"])) for c in [*range(45), -3, -25] for t in range(rng.randint(1, 5))]
TURNS += [(7, None, "user", "null turn"), (7, None, "user", "null turn"), (9, 0, "user", "tie"), (9, 0, "assistant", "tie"), (None, 1, "user", "no id"), (50, 0, None, None)]
TURNS += [(60 + i, t, "user", f"copy {t}") for i in range(12) for t in range(6)]  # copies that all end at one node
TURNS += [(200, t, "user", f"turn {t} " + "w " * t) for t in range(700)] + [(201, t, "user", f"turn {t} " + "w " * t) for t in range(350)]
TRIE_SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), x or ""))
    turns = {c: [(o[2], o[4]) for o in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    nodes = {p: min(m) for p, m in members.items()}
    children = Counter(p[:-1] for p in nodes if p)
    saved, leaves = Counter(), Counter()
    for p in nodes:
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in children
    return {
        (nodes[p], len(p)): (nodes[p[:-1]] if p else None, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p in nodes
    }


def trie_of(df):
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefix_trie.prefix_trie(df).collect()}


@pytest.mark.parametrize("chunk", [4096, 3])
def test_trie_is_that_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    small = [r for r in TURNS if r[0] not in (200, 201)]
    df = spark.createDataFrame(small, TRIE_SCHEMA).withColumns({c: F.lit("clash") for c in ("digest", "depth", "base", "n", "node", "last", "words")}).repartition(5)
    assert trie_of(df) == brute_trie(small)


def test_trie_of_long_conversations_takes_as_many_rows_as_prefixes(spark):
    long = [r for r in TURNS if r[0] in (200, 201)]
    df = spark.createDataFrame(long, TRIE_SCHEMA)
    assert prefix_trie.prefixes(df).count() == 1050
    assert trie_of(df) == brute_trie(long)


def test_trie_edges(spark):
    none = spark.createDataFrame([], TRIE_SCHEMA)
    assert trie_of(none) == {}
    lost = [(c, 0, "user", "gone") for c in range(21, 30) if zlib.crc32(str(c).encode()) % 4 >= 1]  # heads are borrowed from nobody
    got = trie_of(spark.createDataFrame(lost, TRIE_SCHEMA))
    assert got == brute_trie(lost) and set(got) == {(min(lost)[0], 0)}


def test_trie_sql(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()  # noqa: F841  read by DuckDB
    rows = duckdb.sql(prefix_trie.OP11_SQL).fetchall()
    got = [tuple(r) for r in prefix_trie.op11_prefix_trie(spark, SF).collect()]
    assert sorted(rows, key=str) == sorted(got, key=str) and len(got) > 50


# --- n-gram join ----------------------------------------------------------------------------------

VOCABULARY = [f"w{i}" for i in range(4000)] + ["Über", "ÉTÉ", "Don't", "中文"]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def changed(base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
    return out


PASSAGE = words(60)
DOCS = [None, "", " \t\n", "one", "ONE", "one two", "One two", "a b c d", "A B  C\nd", "a b c d e", "a b c d e f", "x " * 400, "x " * 401, "É a b c d", "é a b c d"]
for _ in range(12):
    base = words(rng.randint(20, 300))
    DOCS += [" ".join(changed(base, k)) for k in (0, 0, 1, 1, 2, 3, 5, 8)]
    DOCS += [" ".join(base[k:]) for k in (1, 3, 10)] + [" ".join(base + words(k)) for k in (2, len(base) // 5, len(base) // 4)]
DOCS += [" ".join(words(rng.randint(40, 200)) + PASSAGE + words(20)) for _ in range(60)]
group = words(120)
DOCS += [" ".join(changed(group, 2)) for _ in range(150)]  # some link to no leader at once
huge = words(20_000)
DOCS += [" ".join(huge), " ".join(changed(huge, 30)), " ".join(huge[:18_000])]
JOIN_ROWS = [(i, t) for i, t in enumerate(DOCS)] + [(3, "one two three"), (3, "one"), (None, "a b c d"), (None, "nobody else has this"), (None, None)]


def brute_join(rows, percent=80):
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(ws))
        sets.append(frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def joined(df):
    return sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=str)


@pytest.mark.parametrize("rounds", [0, 2])
def test_join_is_that_of_brute_force(spark, monkeypatch, rounds):
    # small bounds: frequent shingles, several buckets, lists in blocks and followers in groups
    for name, value in (("LEAST_LONG", 20), ("BUCKET", 500), ("BLOCK", 7), ("FOLLOWERS", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join.ngram_links, "__defaults__", (5, 80, rounds))
    monkeypatch.setattr(ngram_join.frequent_shingles, "__defaults__", (1 << 17, 20))
    monkeypatch.setattr(ngram_join.candidates, "__defaults__", (7, 80))
    df = spark.createDataFrame(JOIN_ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "n", "row", "token", "root")}).repartition(3)
    expected = brute_join(JOIN_ROWS)
    assert joined(df) == expected
    assert sum(d is not None and d != c for d, _, c in expected) > 200


def test_join_of_nothing(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")) == []
    assert joined(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")) == [(1, 0, 1), (2, 0, 2)]


def test_sets_do_not_depend_on_pieces_and_memory(monkeypatch):
    texts = [t for t in DOCS if t]
    whole = [ngram_join.shingle_set(t, ngram_join.Words()).tolist() for t in texts]
    monkeypatch.setattr(ngram_join, "VOCABULARY", 5)
    monkeypatch.setattr(ngram_join, "PIECE", 16)
    assert [ngram_join.shingle_set(t, ngram_join.Words()).tolist() for t in texts] == whole


def test_parity_never_parts_similar_sets():
    r = np.random.default_rng(2)
    for n in (1, 5, 30, 200, 3000):
        for lost in range(0, n // 5 + 2, max(1, n // 50)):
            pool = np.unique(r.integers(0, 1 << 63, n + lost).astype(np.uint64))
            a, b = pool[: len(pool) - lost], pool[lost:]
            common = len(np.intersect1d(a, b))
            apart = int(np.bitwise_count((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint64)).sum())
            assert apart <= len(a) + len(b) - 2 * common
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert apart <= ngram_join.most_apart(len(a), len(b))


def test_similar_sets_share_the_least_number_of_short_lists():
    frequent = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    for n in (1, 3, 5, 6, 20, 97, 300):
        for seed in range(20):
            r = np.random.default_rng([n, seed])
            pool = np.unique(np.concatenate([r.integers(0, 1 << 63, 2 * n).astype(np.uint64), frequent[: n // 3]]))
            a = np.sort(r.choice(pool, n, replace=False))
            rest = np.setdiff1d(pool, a)
            for lost in range(n // 5 + 1):
                b = np.sort(np.concatenate([a[lost:], rest[: r.integers(0, 2)]]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    both = np.intersect1d(ngram_join.short_lists(a, frequent), ngram_join.short_lists(b, frequent))
                    assert len(both) >= max(ngram_join.least_merged(len(a)), ngram_join.least_merged(len(b)), 1) or len(both) >= min(ngram_join.merged(len(a)), ngram_join.merged(len(b)))
                    assert len(both) >= ngram_join.least_merged(len(a)) and len(both) >= ngram_join.least_merged(len(b))


# --- whitening ------------------------------------------------------------------------------------


def brute_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, np.float64))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("fan", [8, 2])
def test_whitening_is_that_of_a_covariance(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", 1)
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(400, 12)) @ r.normal(size=(12, 12)) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(300)]  # one vector has nearly half of all rows
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, []), (2005, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "n", "component", "r")}).repartition(13)
    got = whitening.whiten(df).toPandas()
    n, deviation, y, explained = brute_whitening([v for _, v in rows])
    assert sorted(got["vec_id"].unique()) == [i for i, _ in rows] and len(got) == 4 * len(rows) and (got["n"] == n).all()
    for c in range(4):
        own = got[got["component"] == c + 1].set_index("vec_id").loc[[i for i, _ in rows]]
        assert own["deviation"].tolist() == deviation
        sign = np.sign(own["whitened"].iloc[0] * y[0, c])
        assert np.abs(sign * own["whitened"] - y[:, c]).max() < 1e-9
        assert np.abs(own["explained"] - explained[c]).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_edges(spark):
    def of(rows):
        return [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id", "component").collect()]

    assert of([]) == [] and of([(1, None), (2, []), (3, [None])]) == []
    assert of([(1, [1.0, 2.0]), (None, [1.0, 2.0])]) == [(i, c, 1, 0, None, None, None) for i in (None, 1) for c in (1, 2)]
    line = of([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, [1.0, 0.0, 1.0])])  # one direction varies
    assert [(v, c, n, d) for v, c, n, d, *_ in line] == [(v, c, 2, 256**2) for v in (1, 2, 3) for c in (1, 2, 3)]
    assert [r[4] for r in line if r[1] == 1] == [-1.0, 1.0, 1.0] and all(r[4] is None and r[5] == 0 for r in line if r[1] > 1)
    assert of([(1, [-0.001]), (2, [-0.0]), (3, [0.0])])[0][2:4] == (2, 1)  # -1, 0 and 0


def test_whitening_of_huge_entries_stays_exact():
    x = np.array([[2**40, -(2**40)], [3, 5]])
    assert whitening.squared(3, x, [7, 9]) == [None, (9 - 7) ** 2 + (15 - 9) ** 2]
    assert whitening.squared(3, x[1:] * 2**20, [7, 9]) == [(9 * 2**20 - 7) ** 2 + (15 * 2**20 - 9) ** 2]
    assert whitening.whole(np.array([1e300, -1e300, 1.999, -0.001])).tolist() == [2**63 - 1, -(2**63), 511, -1]
