"""Quality rules with cross-document line frequency, in DataFrame code only.

Base rules look at one text. The method hashes every normalised line, counts
the distinct documents of a host that hold it, removes lines above the limits and
rejects documents of which too little is left. Texts are read once: counts and
line hashes of each row are written to the shared folder, all else is made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import join_counted, materialise, table, text_or_empty

SYMBOLS = "#*$%&|<>"
#: A power of two: windows are hashed by doubling.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line is removed if more than this many distinct documents of the host have it, and more than this share of them.
LINE_DOCS = 3
LINE_PERCENT = 10
#: A document is rejected if less than this share of its words is left.
LEFT_PERCENT = 70

_SPACES, _VISIBLE, _UNEVEN = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[\x09-\x0D]|\x20\x20"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is not inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: the union of [start, start + WINDOW) of such windows."""

    def starts(a: Column) -> Column:
        """a: (hash, start) in order; equal hashes are neighbours."""
        n = F.size(a)
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        before = F.concat(none, F.slice(a, F.lit(1), n - 1))
        after = F.concat(F.slice(a, F.lit(2), n - 1), none)
        first = F.zip_with(a, before, lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == p["h"], F.lit(False)).alias("again")))
        both = F.zip_with(first, after, lambda x, q: F.when(x["again"] | F.coalesce(x["h"] == q["h"], F.lit(False)), x["i"]))
        return F.sort_array(F.filter(both, lambda i: i.isNotNull()))

    def union(s: Column) -> Column:
        after = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.lit(None).cast("int")))
        gaps = F.zip_with(s, after, lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g.cast("long"))

    indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(indexed, starts), union)


def repeat_words(ws: Column) -> Column:
    """Words in WINDOW-word windows that the text has twice or more, the first included."""

    def doubled(h: Column, width: int) -> Column:
        """Hashes of twice the width: each with the one ``width`` places on. The last ones are of cut windows."""
        return F.zip_with(h, F.slice(h, F.lit(width + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def of(h1: Column) -> Column:
        h8 = _let(_let(doubled(h1, 1), lambda h2: doubled(h2, 2)), lambda h4: doubled(h4, 4))
        windows = F.slice(h8, F.lit(1), F.size(h1) - (WINDOW - 1))
        return _let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(_covered(v)))

    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(F.transform(ws, lambda w: F.xxhash64(w)), of))


def text_features(text: Column, ws: Column) -> dict[str, Column]:
    """The base counts of one text and its words, each a Column."""
    visible = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(_VISIBLE)))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": _let(visible, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long"),
        "n_repeat_words": repeat_words(ws),
    }


def normal_line(line: Column) -> Column:
    """Space runs as one space, none at the ends; ``line`` is in lower case already."""
    return F.trim(F.when(F.rlike(line, F.lit(_UNEVEN)), F.regexp_replace(line, _SPACES, " ")).otherwise(line))


def line_counts(text: Column) -> Column:
    """(hash, words) of every normalised line that has a word."""
    own = F.filter(F.transform(F.split(F.lower(text), "\n"), normal_line), lambda x: x != "")
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(own, lambda x: F.struct(F.xxhash64(x).alias("line"), n_words(x).cast("int").alias("n")))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    line_docs: int = LINE_DOCS,
    line_percent: int = LINE_PERCENT,
    left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """Base counts and verdicts of every document.

    Null texts have no words and so fail; a null host counts as the host ''.
    Documents are counted by id, rows without one as one document; so rows that
    repeat count once, and copies under other ids each count. Ties do not arise:
    limits are strict. Very long texts are one row of line hashes each. Every row
    gives a row, an empty table none; other columns are ignored.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_removed_words.
    """
    own = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_or_empty().alias("text"))
    # Words are a column of their own: several counts use them, so the optimiser does not compute them again for each.
    rows = materialise(
        own.withColumn("ws", words(F.col("text"))).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "host", line_counts(F.col("text")).alias("lines"),
            *[c.alias(n) for n, c in text_features(F.col("text"), F.col("ws")).items()],
        )
    )
    count = F.count(F.lit(1))
    in_host = rows.select("host", "doc_id").distinct().groupBy("host").agg(count.alias("host_docs"))
    in_line = (
        rows.select("doc_id", "host", F.explode(F.array_distinct("lines.line")).alias("line"))
        .distinct().groupBy("host", "line").agg(count.alias("docs")).filter(F.col("docs") > line_docs)
    )
    frequent = materialise(in_line.join(in_host, "host").filter(F.col("docs") * 100 > F.col("host_docs") * line_percent).select("host", "line"))
    lines = rows.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.line", "x.n")
    removed = join_counted(lines, frequent, ["host", "line"], "rid").groupBy("rid").agg(F.sum("n").alias("n_removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        rows.drop("lines").join(removed, "rid", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (100 * left >= left_percent * F.col("n_words"))).alias("kept"),
            "n_removed_words",
        )
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_WS = _SPACES

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
ln0 AS (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM ln0 WHERE regexp_replace(raw, '{_WS}', '', 'g') <> '' GROUP BY rid),
ln AS (SELECT rid, doc_id, host, trim(regexp_replace(lower(raw), '{_WS}', ' ', 'g'), ' ') AS line FROM ln0),
hd AS (SELECT host, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS host_docs FROM d GROUP BY host),
fr AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS docs FROM ln WHERE line <> '' GROUP BY host, line)
    JOIN hd USING (host) WHERE docs > {LINE_DOCS} AND docs * 100 > host_docs * {LINE_PERCENT}),
rm AS (SELECT rid, sum(len(string_split(line, ' ')))::BIGINT AS n FROM ln JOIN fr USING (host, line) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rm.n, 0)::BIGINT AS n_removed_words
    FROM w LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN rm USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (n_words - n_removed_words) >= {LEFT_PERCENT} * n_words AS kept FROM f
"""
