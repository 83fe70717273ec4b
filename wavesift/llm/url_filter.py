"""URL filter: allow/block rules, else an empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A beta-binomial prior is carried
down the tree suffix -> registered domain -> host: each level's rate is the
parent's rate shrunk towards by a prior strength that the level's own spread
gives (Kleinman's moment estimator). A host is blocked where the lower bound of
its rate of bad pages, a quantile of the beta posterior, is above ``limit``. All
of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm._common import join_counted, materialise, table

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Labels that make a suffix of two labels with a country code of two letters after them (co.uk, com.br, go.jp).
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "id", "info", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")

LIMIT = 0.5
#: A host is blocked if its rate is above the limit with this posterior probability.
LEVEL = 0.95
#: Even number of steps on either side of the limit in the integral of the posterior.
STEPS = 400

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end; A-Z lower-cased. Empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #. Empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def with_domain(hosts: DataFrame) -> DataFrame:
    """Adds registered domain and suffix of ``host``, without user and port.

    A suffix is the last label, or the last two where a country code of two letters
    follows one of SECOND_LABELS. Names that are no longer than their suffix are
    their own domain; so are addresses, whose suffix is empty.
    """
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(name, "[.]")
    n = F.size(parts)
    address = F.rlike(name, F.lit(r"^[0-9.]+$|^\["))
    two = (n >= 2) & (F.length(F.element_at(parts, -1)) == 2) & F.coalesce(F.get(parts, n - 2).isin(*SECOND_LABELS), F.lit(False))
    of = lambda k: F.concat_ws(".", F.slice(parts, F.greatest(n - k, F.lit(0)) + 1, k))
    domain = F.when(address, name).when(two, of(3)).otherwise(of(2))
    suffix = F.when(address, "").when(two, of(2)).otherwise(of(1))
    return hosts.withColumn("domain", domain).withColumn("suffix", suffix)


def beta_below(a: Column, b: Column, x: float, steps: int = STEPS) -> Column:
    """The share of the beta distribution (a, b) below ``x``.

    Simpson's rule over the log-odds t, where the density is smooth and falls as
    e^(at) and e^(-bt), on either side of ``x``; relative to its largest value.
    """
    t0, at = F.log(a / b), math.log(x / (1 - x))
    log_share = lambda t: -(F.greatest(-t, F.lit(0.0)) + F.log(F.lit(1.0) + F.exp(-F.abs(t))))
    log_density = lambda t: a * log_share(t) + b * log_share(-t)
    spread = F.lit(8.0) * F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b)

    def side(sign: int, tail: Column) -> Column:
        h = (F.greatest(F.lit(float(sign)) * (t0 - F.lit(at)), F.lit(0.0)) + spread + F.lit(20.0) / tail) / F.lit(float(steps))
        weight = lambda j: F.when((j == 0) | (j == steps), 1.0).when(j % 2 == 1, 4.0).otherwise(2.0)
        value = lambda j: weight(j) * F.exp(log_density(F.lit(at) + F.lit(float(sign)) * j.cast("double") * h) - log_density(t0))
        return h * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, j: acc + value(j))

    low, high = side(-1, a), side(1, b)
    return low / (low + high)


def prior_strength(level: DataFrame) -> float:
    """Kleinman's estimate of a + b of the beta prior, from counts (n, k) of one level.

    One aggregate row reaches the driver. Kept within [1, 1000]; 10 where the
    level has too little data to tell.
    """
    r = level.filter("n > 0").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("s"),
    ).first()
    m, n, k, n2, s = r["m"], r["n"] or 0, r["k"] or 0, r["n2"] or 0, r["s"] or 0.0
    if m < 2 or k == 0 or k == n:
        return 10.0
    p = k / n
    spread, room = s - n * p * p - p * (1 - p) * (m - 1), p * (1 - p) * (n - n2 / n - (m - 1))
    if room <= 0 or spread <= 0:
        return 1000.0 if room > 0 else 10.0
    rho = min(spread / room, 1.0)
    return round(min(max(1 / rho - 1, 1.0), 1000.0), 6)


def host_reputation(outcomes: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """host, host_labelled, host_bad, rate, p_below, method_verdict from rows (host, bad).

    ``bad`` is 1, 0 or null (not labelled). Hosts without labels get their parent's
    prior. ``p_below`` is the posterior probability of a rate below ``limit``; null
    where Markov's inequality alone says that the rate is not above it.
    """
    # Each level is written once; levels, strengths and rates are all made from these.
    hosts = materialise(with_domain(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = domains.agg(*sums).first()
    base = (total["k"] or 0) / total["n"] if total["n"] else 0.0
    m_host, m_domain, m_suffix = prior_strength(hosts), prior_strength(domains), prior_strength(suffixes)

    def shrunk(strength: float, parent: Column) -> Column:
        return (F.col("k") + F.lit(strength) * parent) / (F.col("n") + F.lit(strength))

    suffix_rate = materialise(suffixes.select("suffix", shrunk(m_suffix, F.lit(base)).alias("suffix_rate")))
    domain_rate = materialise(join_counted(domains, suffix_rate, ["suffix"], "domain").select("domain", shrunk(m_domain, F.col("suffix_rate")).alias("domain_rate")))
    least = 1e-9  # so that a host without any bad page around has a posterior
    a = F.greatest(F.col("k") + F.lit(m_host) * F.col("domain_rate"), F.lit(least))
    b = F.greatest(F.col("n") - F.col("k") + F.lit(m_host) * (F.lit(1.0) - F.col("domain_rate")), F.lit(least))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    below = F.when(rate >= level * limit, beta_below(F.col("a"), F.col("b"), limit))
    return (
        join_counted(hosts, domain_rate, ["domain"], "host")
        .select("host", F.col("n").alias("host_labelled"), F.col("k").alias("host_bad"), a.alias("a"), b.alias("b"))
        .select("host", "host_labelled", "host_bad", rate.alias("rate"), below.alias("p_below"))
        .withColumn("method_verdict", F.when(F.col("p_below") < 1 - level, "block").otherwise("allow"))
    )


def filter_urls(pages: DataFrame, bad: DataFrame, rules=RULES, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url).

    ``bad`` (page_id, bad 0/1) holds the labelled outcomes; pages without one
    carry no evidence. Null urls and those without :// have an empty host and
    path, fit no rule and are judged by the reputation of the empty host. Very long
    urls are read whole. Of rules that fit, the longest wins; rules of one length
    that fit one url are the same rule. One row per input row, repeated ones too; an
    empty table gives no rows; other columns are ignored.

    Columns: page_id, host, path, rule, verdict, host_labelled, host_bad.
    """
    url = F.col("url")
    own = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    outcomes = own.select("page_id", "host").join(bad.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    reputation = materialise(host_reputation(outcomes, limit, level))
    return join_counted(own, reputation, ["host"], "path").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method_verdict")).alias("verdict"), "host_labelled", "host_bad"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages whose url ends in the number of a labelled document.

    A page is bad if its document has quality 0 or is toxic.
    """
    number = F.regexp_extract(url_path(F.col("url")), r"/(\d{1,18})(?:[/.]|$)", 1)
    own = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    return own.join(known, "doc_id").select("page_id", "bad")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _sql() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{v}'" for v, h, p in order) + " END"
    two = ", ".join(f"'{s}'" for s in SECOND_LABELS)
    at = math.log(LIMIT / (1 - LIMIT))
    log_share = "-(greatest(-({t}), 0.0) + ln(1.0 + exp(-abs({t}))))"
    log_density = lambda t: f"(a * ({log_share.format(t=t)}) + b * ({log_share.format(t=f'-({t})')}))"
    step = lambda sign, tail: f"((greatest({sign}.0 * (t0 - {at!r}), 0.0) + 8.0 * sqrt(1.0 / a + 1.0 / b) + 20.0 / {tail}) / {STEPS}.0)"

    def strength(level: str) -> str:
        return f"""(SELECT CASE WHEN m < 2 OR k = 0 OR k = n THEN 10.0 WHEN room <= 0 THEN 10.0 WHEN spread <= 0 THEN 1000.0
            ELSE round(least(greatest(1 / least(spread / room, 1.0) - 1, 1.0), 1000.0), 6) END
            FROM (SELECT *, s - n * p * p - p * (1 - p) * (m - 1) AS spread, p * (1 - p) * (n - n2 / n - (m - 1)) AS room
              FROM (SELECT count(*) AS m, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k, sum(n * n)::DOUBLE AS n2, sum(k * k / n::DOUBLE) AS s,
                sum(k) / sum(n)::DOUBLE AS p FROM {level} WHERE n > 0)))"""

    return f"""
WITH own AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcome AS (SELECT page_id, max(bad) AS bad FROM own JOIN known
    ON known.doc_id = try_cast(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:[/.]|$)', 1), '') AS BIGINT) GROUP BY page_id),
host0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM own LEFT JOIN outcome USING (page_id) GROUP BY host),
host1 AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9.]+$|^\\[') AS address FROM host0),
host2 AS (SELECT *, len(parts) >= 2 AND length(parts[-1]) = 2 AND parts[-2] IN ({two}) AS two FROM host1),
hosts AS (SELECT host, n, k, CASE WHEN address THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
    CASE WHEN address THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM host2),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
strengths AS (SELECT {strength("hosts")} AS mh, {strength("domains")} AS md, {strength("suffixes")} AS ms,
    (SELECT coalesce(sum(k) / nullif(sum(n), 0)::DOUBLE, 0.0) FROM hosts) AS base),
sr AS (SELECT suffix, (k + ms * base) / (n + ms) AS suffix_rate FROM suffixes, strengths),
dr AS (SELECT domain, (k + md * suffix_rate) / (n + md) AS domain_rate FROM domains JOIN sr USING (suffix), strengths),
ab AS (SELECT host, n, k, greatest(k + mh * domain_rate, 1e-9) AS a, greatest(n - k + mh * (1 - domain_rate), 1e-9) AS b FROM hosts JOIN dr USING (domain), strengths),
st AS (SELECT *, {step(-1, "a")} AS h_low, {step(1, "b")} AS h_high FROM (SELECT *, ln(a / b) AS t0 FROM ab)),
pt AS (SELECT host, j, CASE WHEN j IN (0, {STEPS}) THEN 1.0 WHEN j % 2 = 1 THEN 4.0 ELSE 2.0 END::DOUBLE AS w, a, b, t0, h_low, h_high, {at!r} - j * h_low AS tl, {at!r} + j * h_high AS th
    FROM st, range(0, {STEPS + 1}) AS r(j) WHERE a / (a + b) >= {LEVEL * LIMIT!r}),
below AS (SELECT host, low / (low + high) AS p FROM (SELECT host, any_value(h_low) * sum(w * exp({log_density("tl")} - {log_density("t0")})) AS low,
    any_value(h_high) * sum(w * exp({log_density("th")} - {log_density("t0")})) AS high FROM pt GROUP BY host)),
rep AS (SELECT host, n, k, CASE WHEN p < {1 - LEVEL!r} THEN 'block' ELSE 'allow' END AS method FROM ab LEFT JOIN below USING (host))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, method) AS verdict, n AS host_labelled, k AS host_bad FROM own JOIN rep USING (host)
"""


OP10_SQL = _sql()
