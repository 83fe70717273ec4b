"""Licence scan: a trained paragraph classifier, confirmed by templates, in DataFrame code only.

Paragraphs that hold a licence word are scored by a multinomial logistic
regression over word n-grams. Its weights are whole numbers (thousandths), so
that sums are exact on any engine, and few: they come from the template list
and are joined in by broadcast. A family is predicted where its log-odds
against the unknown class pass a calibrated margin, and confirmed where the
paragraph holds most word trigrams of one of the family's templates. Paragraphs
are single lines; notices that are wrapped over several lines are looked for
beside them, in what blank lines bound.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.llm._common import materialise, table, text_or_empty
from wavesift.llm.licence_texts import NONE, TEMPLATES

UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Every template has one of these stems. Lines that hold one are candidates; others are only where a template confirms them.
STEMS = ("licens", "licenc", "copyright", "warrant", "redistribut", "public domain", "rights reserved", "permission is hereby")
#: A template is confirmed by this share of its trigrams, in percent.
CONFIRM_PERCENT = 70
#: What parts the blocks in which wrapped notices are looked for: lines without letters a-z and digits, comment marks included.
BLANK_LINES = r"\n[^A-Za-z0-9]*\n"
#: The margin lets through at most this share of unseen paragraphs of the unknown class.
FALSE_SHARE = 0.002

WORD_STEMS = "|".join(STEMS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DROP = r"[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split()


def grams(ws: list[str]) -> set[str]:
    """Distinct words and word pairs."""
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}


def trigrams(ws: list[str]) -> set[str]:
    """Distinct word triples; the whole of a shorter text."""
    return {" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}


@dataclass(frozen=True)
class Model:
    weights: tuple[tuple[str, tuple[int, ...]], ...]  # gram -> thousandths for each of FAMILIES
    bias: tuple[int, ...]
    margin: int


def _examples(rng: random.Random, copies: int) -> list[tuple[list[str], int]]:
    """Templates and other paragraphs, whole and with words lost, changed or put around them."""
    filler = " ".join(NONE).split()
    rows = []
    for k, family in enumerate(FAMILIES):
        for text in TEMPLATES.get(family, NONE):
            for i in range(copies):
                ws = tokens(text)
                if i:
                    ws = [w for w in ws if rng.random() > 0.08] or ws
                    ws = [w if rng.random() > 0.03 else tokens(rng.choice(filler) + " x")[0] for w in ws]
                    before, after = ([w for x in rng.sample(filler, rng.randint(0, 12)) for w in tokens(x)] for _ in range(2))
                    ws = before + ws + after
                rows.append((ws, k))
    for _ in range(20 * copies):  # a licence word or two in prose
        ws = [w for x in rng.sample(filler, rng.randint(5, 40)) for w in tokens(x)]
        for stem in rng.sample(["license", "licensed", "copyright", "warranty", "redistribute", "licence", "permission"], rng.randint(1, 2)):
            ws.insert(rng.randint(0, len(ws)), stem)
        rows.append((ws, len(FAMILIES) - 1))
    return rows


@lru_cache(maxsize=1)
def fit(copies: int = 12, seed: int = 11) -> Model:
    """Gradient descent with momentum on the softmax loss; weights of grams of the templates only."""
    rng = random.Random(seed)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(at)))
        for r, (ws, _) in enumerate(rows):
            x[r, [at[g] for g in grams(ws) if g in at]] = 1
        return x, np.array([k for _, k in rows])

    x, y = matrix(_examples(rng, copies))
    unseen, known = matrix(_examples(rng, 6))
    n, classes = len(y), len(FAMILIES)
    w, b, vw, vb = np.zeros((len(at), classes)), np.zeros(classes), 0.0, 0.0
    target = np.eye(classes)[y]
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / n
        vw, vb = 0.9 * vw - 1.0 * (x.T @ g + 2e-4 * w), 0.9 * vb - 1.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    whole, shift = np.round(1000 * w).astype(int), np.round(1000 * b).astype(int)
    z = unseen @ whole + shift
    odds = z[:, :-1].max(axis=1) - z[:, -1]
    none = np.sort(odds[known == classes - 1])
    margin = max(1, int(none[min(len(none) - 1, int((1 - FALSE_SHARE) * len(none)))]) + 1)
    weights = tuple((g, tuple(whole[i].tolist())) for g, i in at.items() if whole[i].any())
    return Model(weights, tuple(shift.tolist()), margin)


def template_trigrams() -> list[tuple[int, str, int, str]]:
    """(template, family, number of trigrams, trigram)."""
    out, n = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            own = trigrams(tokens(text))
            out += [(n, family, len(own), t) for t in sorted(own)]
            n += 1
    return out


def gate_words() -> list[str]:
    """Words without which nothing is confirmed: of each template, the trigrams that hold none are too few.

    Chosen greedily, words of ordinary paragraphs and short ones only where no other is left.
    """
    common = {w for text in NONE for w in tokens(text)}
    free = [{tuple(g.split(" ")) for g in trigrams(tokens(t))} for ts in TEMPLATES.values() for t in ts]
    few = [len(own) * CONFIRM_PERCENT for own in free]
    out: list[str] = []
    while True:
        free_open = [own for own, n in zip(free, few, strict=True) if len(own) * 100 >= n]
        if not free_open:
            return sorted(out)
        gain = Counter(w for own in free_open for g in own for w in set(g))
        out.append(max(gain, key=lambda w: (w not in common, len(w) > 3, gain[w], w)))
        free = [{g for g in own if out[-1] not in g} for own in free]


#: On words as normal_words gives them: runs of letters a-z and digits, whatever stands between.
GATE = rf"(?<![a-z0-9])(?:{'|'.join(gate_words())})(?![a-z0-9])"


def normal_words(paragraph: Column) -> Column:
    """Words of letters a-z and digits, A-Z lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.translate(paragraph, _UPPER, _UPPER.lower()), _DROP, " "), " "), lambda w: w != "")


def joined(ws: Column, n: int) -> Column:
    """Every ``n`` words in a row as one string, from copies of the array that are shifted against each other."""
    out = ws
    for k in range(1, n):
        out = F.zip_with(out, F.slice(ws, F.lit(k + 1), F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def _has(stems: str, text: Column) -> Column:
    return F.rlike(F.translate(text, _UPPER, _UPPER.lower()), F.lit(stems))


def _scored(paragraphs: DataFrame, key: list[str], model: Model) -> DataFrame:
    """(*key, odds, family) of rows with words ``ws``."""
    # At most one row for each gram: bounded by licence_texts.
    weights = paragraphs.sparkSession.createDataFrame([(g, [*map(int, ws)]) for g, ws in model.weights], "gram string, w array<bigint>")
    one_two = F.array_distinct(F.concat("ws", joined(F.col("ws"), 2)))
    sums = [F.sum(F.coalesce(F.col("w")[k], F.lit(0))).alias(f"s{k}") for k in range(len(FAMILIES))]
    scored = (
        paragraphs.select(*key, F.explode(one_two).alias("gram"))
        .join(F.broadcast(weights), "gram", "left")
        .groupBy(*key).agg(*sums)
    )
    z = [F.col(f"s{k}") + F.lit(model.bias[k]) for k in range(len(FAMILIES))]
    best = F.greatest(*z[:-1])
    family = F.coalesce(*[F.when(c == best, F.lit(name)) for c, name in zip(z[:-1], FAMILIES, strict=False)])
    scored = scored.select(*key, family.alias("best"), (best - z[-1]).alias("odds"))
    return scored.withColumn("family", F.when(F.col("odds") >= model.margin, F.col("best")).otherwise(UNKNOWN)).drop("best")


def candidate_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, stem, gate, text): rows as they are written once, with the texts that have a licence word or pass the gate.

    All else reads these rows, so texts are read once and the numbers of rows never change.
    """
    text = F.col("text")
    own = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    flagged = own.select("row", "doc_id", _has(WORD_STEMS, text).alias("stem"), _has(GATE, text).alias("gate"), "text")
    return materialise(flagged.withColumn("text", F.when(F.col("stem") | F.col("gate"), text)))


def wrapped_notices(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Of rows of candidate_texts the families that a block between blank lines, or a line without a licence word, confirms.

    Trigrams run over line ends here. A notice is a stretch of at most twice the
    words of a template that holds CONFIRM_PERCENT of its trigrams; the best stretch
    for each block and template is scored. Lines with a licence word that hold as much
    by themselves are left to licence_paragraphs. The gate drops only what no template
    can confirm (see gate_words).

    Columns: doc_id, row, paragraph (number of the block), family, odds, confirmed (true).
    """
    model = model or fit()
    templates = rows.sparkSession.createDataFrame(template_trigrams(), "template int, known string, of int, gram string")
    lines = F.transform(F.split("block", "\n"), lambda line: F.struct(normal_words(line).alias("ws"), _has(WORD_STEMS, line).alias("stem")))
    of_words = F.transform("lines", lambda x, i: F.transform(x["ws"], lambda w: F.struct(i.alias("line"), x["stem"].alias("stem"))))
    blocks = (
        rows.filter("gate")
        .select("doc_id", "row", F.posexplode(F.split("text", BLANK_LINES)).alias("paragraph", "block"))
        .filter(_has(GATE, F.col("block")))
        .select("doc_id", "row", "paragraph", lines.alias("lines"))
        .select("doc_id", "row", "paragraph", F.flatten("lines.ws").alias("ws"), F.flatten(of_words).alias("at"))
    )
    key = ["row", "paragraph", "template"]
    # Each trigram goes out with the lines of its ends, never with the words of its block.
    three = F.zip_with(joined(F.col("ws"), 3), F.zip_with("at", F.slice("at", F.lit(3), F.size("at")), lambda x, y: F.struct(x["line"].alias("line"), (x["line"] == y["line"]).alias("inside"), x["stem"].alias("stem"))), lambda g, x: F.struct(g.alias("gram"), x.alias("at")))
    hits = (
        blocks.select("row", "paragraph", F.posexplode(three).alias("pos", "t"))
        .select("row", "paragraph", "pos", "t.gram", "t.at.line", F.coalesce("t.at.inside", F.lit(False)).alias("inside"), "t.at.stem")
        .join(F.broadcast(templates), "gram")
    )
    of_line = F.size(F.collect_set(F.when(F.col("inside"), F.col("gram"))).over(Window.partitionBy(*key, "line")))
    by_line = F.col("stem") & (of_line * 100 >= F.col("of") * CONFIRM_PERCENT)
    ahead = Window.partitionBy(*key).orderBy(F.col("pos") / (2 * (F.col("of") + 2))).rangeBetween(0, 1)
    best = (
        hits.withColumn("by_line", by_line)
        .withColumn("by_line", F.max("by_line").over(Window.partitionBy("row", "paragraph", "known", "line"))).filter(~F.col("by_line"))
        .select(*key, "known", "of", "pos", F.size(F.collect_set("gram").over(ahead)).alias("n"), F.max("pos").over(ahead).alias("last"))
        .filter(F.col("n") * 100 >= F.col("of") * CONFIRM_PERCENT)
        .groupBy(*key, "known").agg(F.max(F.struct("n", (F.col("pos") - F.col("last")).alias("short"), (-F.col("pos")).alias("first"))).alias("b"))
    )
    first, length = -F.col("b.first"), 3 - F.col("b.short")
    stretches = blocks.join(best, ["row", "paragraph"]).select("doc_id", *key, "known", F.slice("ws", first + 1, length).alias("ws"))
    scored = _scored(stretches, ["doc_id", *key, "known"], model).filter(F.col("family") == F.col("known"))
    return scored.groupBy("doc_id", "row", "paragraph", "family").agg(F.max("odds").alias("odds")).withColumn("confirmed", F.lit(True))


def licence_paragraphs(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Candidate lines of rows of candidate_texts, scored and compared.

    Columns: doc_id, row, paragraph (its number), family, odds (thousandths of
    log-odds against unknown), confirmed.
    """
    model = model or fit()
    spark = rows.sparkSession
    # At most one row for each trigram of a template: bounded by licence_texts.
    templates = spark.createDataFrame(template_trigrams(), "template int, family string, of int, gram string")

    paragraphs = (
        rows.filter("stem")
        .select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
        .filter(_has(WORD_STEMS, F.col("line")))
        .select("doc_id", "row", "paragraph", normal_words(F.col("line")).alias("ws"))
    )
    key = ["doc_id", "row", "paragraph"]
    scored = _scored(paragraphs, key, model)

    three = F.array_distinct(F.when(F.size("ws") < 3, F.array(F.array_join("ws", " "))).otherwise(joined(F.col("ws"), 3)))
    alike = (
        paragraphs.select(*key, F.explode(three).alias("gram"))
        .join(F.broadcast(templates), "gram")
        .groupBy(*key, "template", "family", "of").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") * 100 >= F.col("of") * CONFIRM_PERCENT)
        .select("row", "paragraph", "family").distinct().withColumn("confirmed", F.lit(True))
    )
    return scored.join(alike, ["row", "paragraph", "family"], "left").select(
        "doc_id", "row", "paragraph", "family", "odds", F.coalesce("confirmed", F.lit(False)).alias("confirmed")
    )


def licence_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The licence families of every document.

    ``licences`` holds the confirmed families in order, comma-joined and empty
    without any; n_candidates counts lines with a licence word in STEMS, n_unknown those of
    the unknown class, n_unconfirmed those whose family no template confirms. What
    wrapped_notices finds beyond these lines counts in n_candidates and n_confirmed. Null texts count as empty. Repeated rows each give a row, an empty
    table none; other columns are ignored. Families of equal odds come in the order of
    FAMILIES. Very long texts are read whole; their lines and blocks go to many tasks.

    Columns: doc_id, n_candidates, n_unknown, n_unconfirmed, n_confirmed, licences.
    """
    rows = candidate_texts(docs)
    found = licence_paragraphs(rows, model).unionByName(wrapped_notices(rows, model))
    is_known = F.col("family") != UNKNOWN
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    per_row = found.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        count(~is_known).alias("n_unknown"),
        count(is_known & ~F.col("confirmed")).alias("n_unconfirmed"),
        count(is_known & F.col("confirmed")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_known & F.col("confirmed"), F.col("family")))), ",").alias("licences"),
    )
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_candidates", "n_unknown", "n_unconfirmed", "n_confirmed")]
    return rows.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", *counts, F.coalesce("licences", F.lit("")).alias("licences"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of the same scan, with the fitted weights as a table."""
    model = fit()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({q(g)}, {', '.join(map(str, ws))})" for g, ws in model.weights)
    names = ", ".join(f"w{k}" for k in range(len(FAMILIES)))
    templates = ", ".join(f"({n}, {q(f)}, {of}, {q(t)})" for n, f, of, t in template_trigrams())
    sums = ", ".join(f"coalesce(sum(w{k}), 0)::BIGINT + ({model.bias[k]}) AS z{k}" for k in range(len(FAMILIES)))
    last = len(FAMILIES) - 1
    best = "greatest(" + ", ".join(f"z{k}" for k in range(last)) + ")"
    family = "CASE " + " ".join(f"WHEN z{k} = {best} THEN {q(FAMILIES[k])}" for k in range(last)) + " END"
    low = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
    stem = "regexp_matches(" + low + f", {q('|'.join(STEMS))})"
    return f"""
WITH weights(gram, {names}) AS (VALUES {weights}),
templates(template, family, size, gram) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS par FROM d),
p AS (SELECT rid, par, list_filter(string_split(regexp_replace({low.format("line")}, '{_DROP}', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM p0 WHERE {stem.format("line")}),
i AS (SELECT rid, par, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g12 AS (SELECT DISTINCT rid, par, ws[i] AS gram FROM i UNION SELECT DISTINCT rid, par, ws[i] || ' ' || ws[i + 1] FROM i WHERE i < len(ws)),
z AS (SELECT rid, par, {sums} FROM g12 LEFT JOIN weights USING (gram) GROUP BY rid, par),
s AS (SELECT rid, par, CASE WHEN {best} - z{last} >= {model.margin} THEN {family} ELSE '{UNKNOWN}' END AS family FROM z),
g3 AS (SELECT DISTINCT rid, par, array_to_string(ws[i:i + 2], ' ') AS gram FROM i WHERE i + 2 <= len(ws) OR (i = 1 AND len(ws) < 3)),
c AS (SELECT DISTINCT rid, par, family FROM (SELECT rid, par, template, family, size, count(*) AS n FROM g3 JOIN templates USING (gram) GROUP BY ALL) WHERE n * 100 >= size * {CONFIRM_PERCENT}),
f AS (SELECT s.*, c.family IS NOT NULL AS confirmed FROM s LEFT JOIN c ON c.rid = s.rid AND c.par = s.par AND c.family = s.family)
SELECT doc_id, count(f.rid) AS n_candidates, count(*) FILTER (f.family = '{UNKNOWN}') AS n_unknown,
    count(*) FILTER (f.family <> '{UNKNOWN}' AND NOT confirmed) AS n_unconfirmed, count(*) FILTER (f.family <> '{UNKNOWN}' AND confirmed) AS n_confirmed,
    coalesce(string_agg(DISTINCT f.family, ',' ORDER BY f.family) FILTER (f.family <> '{UNKNOWN}' AND confirmed), '') AS licences
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id
"""
