"""Reductions, stencils, corrections, links and patterns on the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import complexcol as cc
from wavesift.functions import units
from wavesift.operators import link, partition, reduce, scan, scatter, select, setops, stencil
from wavesift.plans.demo_tables import PIXELS_SQL, VECTOR_SQL, WAVES_SQL, pixels, read, rounded, vector, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# ---- statistics -------------------------------------------------------------

@query(f"""
SELECT count(*) AS frames, round(max(t), 4) AS max_power, round(sum(t), 4) AS tot_power, round(sum(t) / count(*) / 7, 4) AS mean_power, round(max(t) / 7, 4) AS pbound
FROM (SELECT frame, sum(CASE WHEN mask THEN intensity ELSE 0 END) AS t FROM {PIXELS_SQL} GROUP BY frame)""")
def frame_stats(spark, sf_dir):
    value = F.when(F.col("mask"), F.col("intensity")).otherwise(0.0)
    return rounded(reduce.exposure_stats(pixels(spark, sf_dir), "frame", value, 7), 4, "max_power", "tot_power", "mean_power", "pbound")


@query(f"""
SELECT bin, round(sum(CASE WHEN mask THEN intensity ELSE 0 END) / greatest(sum(mask::INT), 1), 4) AS mean,
  max(intensity) FILTER (mask) AS max, min(intensity) FILTER (mask) AS min, least(min(intensity) FILTER (mask), 0.0) AS min_clamped0
FROM {PIXELS_SQL} GROUP BY bin""")
def pixel_stats(spark, sf_dir):
    return rounded(reduce.pixel_stats(pixels(spark, sf_dir), ["bin"], F.col("intensity"), F.col("mask")), 4, "mean")


@query(f"SELECT vec_id, round(sum(re * re + im * im), 5) AS norm2, round(sqrt(sum(re * re + im * im)), 5) AS norm FROM {WAVES_SQL} GROUP BY vec_id")
def abs2_norm2(spark, sf_dir):
    return rounded(waves(spark, sf_dir).groupBy("vec_id").agg(reduce.norm2("re", "im").alias("norm2"), reduce.norm("re", "im").alias("norm")), 5, "norm2", "norm")


@query(f"""
WITH w AS (SELECT * FROM {WAVES_SQL}), m AS (SELECT label, k, avg(re) AS mre, avg(im) AS mim FROM w GROUP BY label, k)
SELECT vec_id, round(sum(mre * re + mim * im), 5) + 0.0 AS dot_re, round(sum(mre * im - mim * re), 5) + 0.0 AS dot_im FROM w JOIN m USING (label, k) GROUP BY vec_id""")
def cdot_label_means(spark, sf_dir):
    w = waves(spark, sf_dir)
    m = w.groupBy("label", "k").agg(F.avg("re").alias("mre"), F.avg("im").alias("mim"))
    re, im = reduce.cdot(F.col("mre"), F.col("mim"), F.col("re"), F.col("im"))
    return rounded(w.join(m, ["label", "k"]).groupBy("vec_id").agg(re.alias("dot_re"), im.alias("dot_im")), 5, "dot_re", "dot_im")


@query(f"""
WITH m AS (SELECT label, k, avg(v) AS v FROM {VECTOR_SQL} GROUP BY label, k)
SELECT a.label AS i, b.label AS j, round(sum(a.v * b.v), 5) + 0.0 AS dot FROM m a JOIN m b USING (k) WHERE a.label <= b.label GROUP BY 1, 2""")
def gram_matrix(spark, sf_dir):
    modes = vector(spark, sf_dir).groupBy("label", "k").agg(F.avg("v").alias("v"))
    return rounded(reduce.gram(modes, "label", "k", "v"), 5, "dot")


@query(f"SELECT frame, round(CASE WHEN sum(intensity) <> 0 THEN sum(intensity * bin) / sum(intensity) END, 6) AS x FROM {PIXELS_SQL} GROUP BY frame")
def mass_center(spark, sf_dir):
    return rounded(reduce.mass_center(pixels(spark, sf_dir), ["frame"], F.col("intensity"), {"x": F.col("bin")}), 6, "x")


@query(f"SELECT round(avg(x), 6) AS x FROM (SELECT CASE WHEN sum(intensity) <> 0 THEN sum(intensity * bin) / sum(intensity) END AS x FROM (SELECT frame, bin, intensity * mask::INT AS intensity FROM {PIXELS_SQL}) GROUP BY frame)")
def auto_center(spark, sf_dir):
    return rounded(reduce.auto_center(pixels(spark, sf_dir), "frame", F.col("intensity") * F.col("mask").cast("int"), {"x": F.col("bin")}), 6, "x")


_RADII = (500.0, 1000.0, 2000.0, 4000.0, 8000.0)


@query("SELECT radius, round(sum(CASE WHEN abs(s_acctbal - mu) < radius THEN abs(s_acctbal) ELSE 0 END), 2) AS mass FROM supplier, (SELECT avg(s_acctbal) AS mu FROM supplier), (VALUES " + ", ".join(f"({r}::DOUBLE)" for r in _RADII) + ") v(radius) GROUP BY radius")
def radial_distribution(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    s = s.withColumn("mu", s.agg(F.avg("s_acctbal")).scalar())
    return rounded(reduce.radial_distribution(s, F.abs("s_acctbal"), F.abs(F.col("s_acctbal") - F.col("mu")), _RADII), 2, "mass")


@query(f"SELECT vec_id, floor(k / 4)::BIGINT AS k, round(avg(v), 6) + 0.0 AS v FROM {VECTOR_SQL} GROUP BY 1, 2")
def rebin_mean(spark, sf_dir):
    return rounded(reduce.rebin_mean(vector(spark, sf_dir), ["vec_id"], {"k": 4}, "v"), 6, "v")


@query("""
WITH b AS (SELECT floor(event_id / 4)::BIGINT AS event_id, avg((value > 0)::INT::DOUBLE) AS m FROM events GROUP BY 1)
SELECT event_id, m = (SELECT max(m) FROM b) AS valid FROM b""")
def mask_rebin(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("value") > 0).alias("valid"))
    return reduce.rebin_mask(e, [], {"event_id": 4}, "valid")


@query("SELECT l_orderkey, round(arg_max(CASE WHEN ok THEN l_extendedprice / e END, CASE WHEN ok THEN e END), 4) AS hdr FROM (SELECT l_orderkey, sum(l_extendedprice) AS l_extendedprice, l_linenumber AS e, sum(l_extendedprice) < 60000 AS ok FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey")
def hdr_highest(spark, sf_dir):
    images = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("p"))
    return rounded(reduce.hdr_highest(images, ["l_orderkey"], F.col("p"), F.col("l_linenumber"), F.col("p") < 60000), 4, "hdr")


@query("SELECT l_orderkey, round(avg(CASE WHEN l_extendedprice < 50000 THEN l_extendedprice / l_linenumber END) + 1e-7, 4) AS hdr FROM lineitem GROUP BY l_orderkey")
def hdr_average(spark, sf_dir):
    h = reduce.hdr_average(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_extendedprice") < 50000)
    return rounded(h.withColumn("hdr", F.col("hdr") + 1e-7), 4, "hdr")  # prices end in cents: no ties


# ---- stencils ---------------------------------------------------------------

def _difference(kind: str, sql: str) -> None:
    @query(f"SELECT event_id, round(coalesce({sql}, 0), 6) + 0.0 AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", name=kind)
    def run(spark, sf_dir):
        d = getattr(stencil, kind)(F.col("value"), ["user_id"], ["ts", "event_id"])
        return rounded(read(spark, sf_dir, "events").select("event_id", d.alias("d")), 6, "d")


_difference("delxf", "lead(value) OVER w - value")
_difference("delxb", "value - lag(value) OVER w")
_difference("delxc", "CASE WHEN lead(value) OVER w IS NOT NULL AND lag(value) OVER w IS NOT NULL THEN (lead(value) OVER w - lag(value) OVER w) / 2 ELSE coalesce(lead(value) OVER w - value, value - lag(value) OVER w) END")


@query(f"""
WITH d AS (SELECT vec_id, coalesce(lead(re) OVER w - re, 0) AS fr, coalesce(re - lag(re) OVER w, 0) AS br, coalesce(lead(im) OVER w - im, 0) AS fi, coalesce(im - lag(im) OVER w, 0) AS bi
  FROM {WAVES_SQL} WINDOW w AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, round(0.5 * sum(fr * fr + br * br + fi * fi + bi * bi), 5) AS cost, round(sum(abs(br - fr)), 5) AS g FROM d GROUP BY vec_id""")
def regul_del2(spark, sf_dir):
    r = stencil.regul_del2(waves(spark, sf_dir), ["vec_id"], ["k"], "re", "im", 0.5)
    return rounded(r.groupBy("vec_id").agg(F.sum("cost").alias("cost"), F.sum(F.abs("g_re")).alias("g")), 5, "cost", "g")


@query(f"""
WITH p AS (SELECT vec_id, k // 8 AS r, k % 8 AS c, v FROM {VECTOR_SQL}),
m AS (SELECT a.vec_id, a.r, a.c, any_value(a.v) AS v, median(b.v) AS med FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.vec_id, a.r, a.c),
s AS (SELECT vec_id, stddev_pop(v - med) AS sd FROM m GROUP BY vec_id)
SELECT vec_id, r, c, round(med, 6) + 0.0 AS median, abs(v - med) > 2 * sd AS hot, round(CASE WHEN abs(v - med) > 2 * sd THEN med ELSE v END, 6) + 0.0 AS fixed FROM m JOIN s USING (vec_id)""")
def hot_pixels(spark, sf_dir):
    p = vector(spark, sf_dir).select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("r"), (F.col("k") % 8).alias("c"), "v")
    return rounded(stencil.remove_hot_pixels(p, ["vec_id"], "r", "c", "v", 2.0), 6, "median", "fixed").drop("v")


@query(f"""
WITH p AS (SELECT vec_id, k, re, im, atan2(lead(im) OVER w * re - lead(re) OVER w * im, lead(re) OVER w * re + lead(im) OVER w * im) AS g, sqrt(re * re + im * im) AS m FROM {WAVES_SQL} WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
a AS (SELECT vec_id, sum(g * m) / sum(m) FILTER (g IS NOT NULL) AS a FROM p GROUP BY vec_id)
SELECT vec_id, k::INT AS k, round(re * cos(a * k) + im * sin(a * k), 5) + 0.0 AS out_re, round(im * cos(a * k) - re * sin(a * k), 5) + 0.0 AS out_im FROM p JOIN a USING (vec_id)""")
def phase_ramp(spark, sf_dir):
    w = waves(spark, sf_dir).withColumn("r", F.lit(0))
    return rounded(stencil.remove_phase_ramp(w, ["vec_id"], "r", "k", "re", "im"), 5, "out_re", "out_im").select("vec_id", "k", "out_re", "out_im")


# ---- selection and corrections ----------------------------------------------

@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def table_select_range(spark, sf_dir):
    return select.select_range(read(spark, sf_dir, "part"), "p_size", 10, 20).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def table_select_match(spark, sf_dir):
    return select.select_match(read(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0 AND c_nationkey % 2 = 0")
def table_select_func(spark, sf_dir):
    return select.select_func(read(spark, sf_dir, "customer"), (F.col("c_acctbal") < 0) & (F.col("c_nationkey") % 2 == 0)).select("c_custkey", "c_nationkey")


@query("SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 0.0, s_nationkey FROM supplier WHERE s_acctbal < 0")
def table_modify_add(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return select.modify_add(s, F.col("s_acctbal") < 0, s_acctbal=0.0)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_regionkey = 1")
def table_insert_records(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    own = n.select("n_nationkey", "n_name")
    return select.insert_records(own, n.filter("n_regionkey = 1").select("n_nationkey", F.upper("n_name").alias("n_name")), "n_nationkey")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def frame_filter(spark, sf_dir):
    return select.frame_filter(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, round(sum(CASE WHEN l_extendedprice < l_discount * 1e5 THEN 0 ELSE l_extendedprice - l_discount * 1e5 END / (1 + l_tax)), 4) AS corrected FROM lineitem GROUP BY 1, 2")
def dark_flat(spark, sf_dir):
    c = select.dark_flat(F.col("l_extendedprice"), F.col("l_discount") * 1e5, 1 + F.col("l_tax"))
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(c).alias("corrected")), 4, "corrected")


@query("""
SELECT o_orderkey, round(CASE WHEN abs(o_totalprice - mu) < 1.5 * sd THEN o_totalprice / o_totalprice * mu ELSE o_totalprice END, 3) AS normalised, abs(o_totalprice - mu) < 1.5 * sd AS in_gate
FROM orders, (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders)""")
def norm_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(select.norm_gate(o, "o_totalprice", "o_totalprice", 1.5), 3, "normalised").drop("o_totalprice")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND value BETWEEN 10 AND 60")
def scan_subset(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(select.scan_subset(F.col("event_id"), 3, {"v": (F.col("value"), 10, 60)})).select("event_id")


def _orientations() -> str:
    parts = []
    for o in range(8):
        r, c, h, w = "r", "c", 51, 50
        if o & 4:
            r, c, h, w = c, r, w, h
        if o & 2:
            r = f"{h - 1} - {r}"
        if o & 1:
            c = f"{w - 1} - {c}"
        parts.append(f"SELECT {o} AS orientation, p_partkey, ({r})::BIGINT AS r, ({c})::BIGINT AS c FROM p")
    return "WITH p AS (SELECT p_partkey, p_size::BIGINT AS r, p_partkey % 50 AS c FROM part) " + " UNION ALL ".join(parts)


@query(_orientations())
def switch_orientation(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("r"), (F.col("p_partkey") % 50).alias("c"))
    views = []
    for o in range(8):
        r, c = select.switch_orientation(F.col("r"), F.col("c"), 51, 50, o)
        views.append(F.struct(F.lit(o).alias("orientation"), r.cast("long").alias("r"), c.cast("long").alias("c")))
    return p.select("p_partkey", F.explode(F.array(*views)).alias("x")).select("x.orientation", "p_partkey", "x.r", "x.c")


@query(f"""
SELECT vec_id, g.k::INT AS k, round(coalesce(v, 0), 6) + 0.0 AS v FROM (SELECT vec_id FROM embeddings), (SELECT unnest(range(72)) AS k) g LEFT JOIN (SELECT vec_id AS i, k + 4 AS j, v FROM {VECTOR_SQL}) ON i = vec_id AND j = g.k""")
def crop_pad(spark, sf_dir):
    return rounded(select.crop_pad(vector(spark, sf_dir), ["vec_id"], "k", "v", 64, 72), 6, "v")


@query("SELECT x, ((x + 3) % 7 + 7) % 7 - 3 AS confined FROM (SELECT unnest(range(-20, 21)) AS x)")
def grids_confine(spark, sf_dir):
    return spark.range(-20, 21).select(F.col("id").alias("x"), select.confine(F.col("id"), 7).alias("confined"))


@query(f"""
SELECT vec_id, k::INT AS k, round(CASE WHEN m > 1.2 THEN 1.2 * cos(atan2(im, re)) WHEN m < 0.3 THEN 0.3 * cos(atan2(im, re)) ELSE re END, 5) + 0.0 AS re,
  round(CASE WHEN m > 1.2 THEN 1.2 * sin(atan2(im, re)) WHEN m < 0.3 THEN 0.3 * sin(atan2(im, re)) ELSE im END, 5) + 0.0 AS im FROM (SELECT *, sqrt(re * re + im * im) AS m FROM {WAVES_SQL})""")
def clip_magnitude(spark, sf_dir):
    z = cc.clip_modulus(cc.cplx("re", "im"), 0.3, 1.2)
    return rounded(waves(spark, sf_dir).select("vec_id", "k", z.alias("z")).select("vec_id", "k", "z.re", "z.im"), 5, "re", "im")


@query(f"SELECT vec_id, k::INT AS k, round(0.5 * atan2(im, re) / pi() + 0.5, 5) AS h, round((least(greatest(sqrt(re * re + im * im), 0.0), 2.0) - 0.0) / 2.0, 5) AS v FROM {WAVES_SQL}")
def complex2hsv(spark, sf_dir):
    h = cc.hsv(cc.cplx("re", "im"), 0.0, 2.0)
    return rounded(waves(spark, sf_dir).select("vec_id", "k", h.alias("x")).select("vec_id", "k", "x.h", "x.v"), 5, "h", "v")


@query("SELECT s_suppkey, round(1 / (e * 1000) * 4.1356e-7 * 2.9998 * 1e10, 6) AS angstrom, round(12.398 / sqrt(e * (1022 + e)), 6) AS electron FROM (SELECT s_suppkey, 1 + abs(s_acctbal) / 1000 AS e FROM supplier)")
def wavelengths(spark, sf_dir):
    e = 1 + F.abs("s_acctbal") / 1000
    out = read(spark, sf_dir, "supplier").select("s_suppkey", (units.kev_to_m(e) * 1e10).alias("angstrom"), (F.lit(12.398) / F.sqrt(e * (2 * 511.0 + e))).alias("electron"))
    return rounded(out, 6, "angstrom", "electron")


# ---- links ------------------------------------------------------------------

@query("SELECT p_partkey, d AS dcoord, d - floor(p_size / 2)::BIGINT AS lo, d + floor((p_size + 1) / 2)::BIGINT AS hi, round(p - d, 6) + 0.0 AS sp FROM (SELECT *, round_even(p + 1e-5, 0)::BIGINT AS d FROM (SELECT p_partkey, p_size, p_retailprice / 7.5 AS p FROM part))")
def update_views(spark, sf_dir):
    v = link.update_views(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", 7.5, F.col("p_size"))
    return rounded(v, 6, "sp").select("p_partkey", "dcoord", "lo", "hi", "sp")


@query("SELECT g AS pixel, count(*) AS coverage FROM part, (SELECT unnest(range(-2, 60)) AS g) WHERE g >= p_size - 2 AND g < p_size + 2 GROUP BY g")
def view_coverage(spark, sf_dir):
    views = read(spark, sf_dir, "part").select((F.col("p_size") - 2).cast("long").alias("lo"), (F.col("p_size") + 2).cast("long").alias("hi"))
    return link.view_coverage(views, [], {"pixel": ("lo", "hi")})


@query("SELECT p_brand, min(p_size - 2) AS lo, max(p_size + 2) AS hi, count(DISTINCT p_type) AS n_layers FROM part WHERE p_size > 25 GROUP BY p_brand")
def reformat_bounds(spark, sf_dir):
    v = read(spark, sf_dir, "part").withColumn("lo", F.col("p_size") - 2).withColumn("hi", F.col("p_size") + 2)
    return link.reformat_bounds(v, ["p_brand"], "lo", "hi", "p_type", F.col("p_size") > 25).select("p_brand", "lo", "hi", F.size("layers").cast("long").alias("n_layers"))


@query("SELECT o_orderkey, c_custkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def pod_link(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return link.link_pods(o, c, read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "c_custkey", "n_nationkey").select("o_orderkey", "c_custkey", "n_name", "o_totalprice")


@query("SELECT n_nationkey, pm, om, n_nationkey::BIGINT * 10000 + pm * 100 + om AS exit_index FROM nation, (VALUES (0), (1)) a(pm), (VALUES (0), (1)) b(om)")
def mode_cross(spark, sf_dir):
    return link.mode_pods(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 2, 2)


@query("SELECT n_nationkey, mode, n_nationkey * 3 + mode AS layer FROM nation, (VALUES (0), (1), (2)) m(mode)")
def opr_pods(spark, sf_dir):
    return link.opr_pods(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 3)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def key_scatter(spark, sf_dir):
    r = read(spark, sf_dir, "region").filter("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return link.key_scatter(read(spark, sf_dir, "nation"), r, "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT key, count(*) AS n, round(min(s_acctbal), 2) AS first FROM (SELECT round_even(s_acctbal / 250, 0)::BIGINT AS key, s_acctbal FROM supplier) GROUP BY key")
def tolerance_groups(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(link.tolerance_key(F.col("s_acctbal"), 250.0).alias("key"), "s_acctbal")
    return rounded(s.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("first")), 2, "first")


# ---- partitions, chunks -----------------------------------------------------

@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k < (7 - n % 7) * (n // 7) THEN k // (n // 7) ELSE 7 - n % 7 + (k - (7 - n % 7) * (n // 7)) // (n // 7 + 1) END::INT AS rank FROM n""")
def load_assign(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return partition.assign_ranks(o, ["o_orderkey"], 7, o.count())


@query("SELECT event_type, event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS idx FROM events")
def chunk_offsets(spark, sf_dir):
    return partition.numbered(read(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type", "event_id"], "idx")


@query("SELECT chunk, count(*) AS frames, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS chunk FROM events) GROUP BY chunk")
def stream_chunks(spark, sf_dir):
    c = partition.chunked(read(spark, sf_dir, "events").select("event_id"), ["event_id"], 300)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""
SELECT tile, count(*) AS n FROM (SELECT (floor(x * 4) + 4 * floor(y * 4))::BIGINT AS tile FROM (SELECT (c_acctbal - (la - 0.01 * (ha - la))) / ((ha - la) * 1.02) AS x, (c_custkey - (lk - 0.01 * (hk - lk))) / ((hk - lk) * 1.02) AS y
FROM customer, (SELECT min(c_acctbal) AS la, max(c_acctbal) AS ha, min(c_custkey) AS lk, max(c_custkey) AS hk FROM customer))) GROUP BY tile""")
def redistribute_tile(spark, sf_dir):
    c = partition.normalised(read(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"])
    return c.groupBy(partition.tile(F.col("n_c_acctbal"), F.col("n_c_custkey"), 16).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = 4")
def bragg_complete(spark, sf_dir):
    from wavesift.streaming.rocking import complete_positions

    return complete_positions(read(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "n", F.array_join(F.transform("angles", lambda a: a.cast("string")), ",").alias("turns"))


# ---- container arithmetic ---------------------------------------------------

_SIDES = "(SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1) a JOIN (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) b USING (k)"


def _arithmetic(op: str, sign: str) -> None:
    @query(f"SELECT k, round(a.v {sign} b.v, 4) + 0.0 AS v FROM {_SIDES}", name=f"container_{op}")
    def run(spark, sf_dir):
        a = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v"))
        b = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
        if op == "imul":
            a, b = a.withColumn("v", F.col("v") / 1000), b.withColumn("v", F.col("v") / 1000)
        return rounded(setops.combine(a, b, ["k"], "v", op), 4, "v")


_arithmetic("iadd", "+")
_arithmetic("isub", "-")
_arithmetic("imul", "/ 1000 * 1e-3 *")
_arithmetic("itruediv", "/")

# ---- scan patterns ----------------------------------------------------------


@query("SELECT i * 5 + j AS idx, (i * 2.0)::DOUBLE AS y, (j * 1.0)::DOUBLE AS x FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(5)) AS j)")
def raster_scan(spark, sf_dir):
    return rounded(scan.raster_scan(spark, 1.0, 2.0, 5, 6), 6, "y", "x")


@query("""
SELECT 0::BIGINT AS idx, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x UNION ALL
SELECT (5 * k * (k - 1) // 2 + t + 1)::BIGINT, round(1.5 * k * sin(t * 2 * pi() / (5 * k)), 6) + 0.0, round(1.5 * k * cos(t * 2 * pi() / (5 * k)), 6) + 0.0 FROM (SELECT k, unnest(range(5 * k)) AS t FROM (SELECT unnest(range(1, 7)) AS k))""")
def round_scan(spark, sf_dir):
    return rounded(scan.round_scan(spark, 1.5, 5, 5), 6, "y", "x")


_SPIRAL = "(SELECT k AS idx, 1.5 / (2 * pi()) * t * sin(t) AS y, 1.5 / (2 * pi()) * t * cos(t) AS x FROM (SELECT k, sqrt(4 * pi()) * sqrt(k) AS t FROM (SELECT unnest(range(10000)) AS k)) WHERE 1.5 / (2 * pi()) * t <= 20)"


@query(f"SELECT idx, round(y, 6) + 0.0 AS y, round(x, 6) + 0.0 AS x FROM {_SPIRAL}")
def spiral_scan(spark, sf_dir):
    return rounded(scan.spiral_scan(spark, 1.5, 20.0, 10_000), 6, "y", "x")


@query(f"SELECT idx, round(y + 0.25, 6) + 0.0 AS y, round(x, 6) + 0.0 AS x FROM {_SPIRAL} WHERE y + 0.25 BETWEEN -8 AND 8 AND x BETWEEN -8 AND 8 ORDER BY idx LIMIT 100")
def roi_filter(spark, sf_dir):
    return rounded(scan.from_pars(scan.spiral_scan(spark, 1.5, 20.0, 10_000), (0.25, 0.0), (16.0, 16.0), 100), 6, "y", "x")


# ---- scatter and updates ----------------------------------------------------

_PATCH = "(SELECT l_linenumber + o AS pixel, l_extendedprice / 1000 AS t, l_quantity AS w FROM lineitem, (VALUES (-1), (0), (1)) v(o))"


def _patches(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 1000).alias("t"), F.col("l_quantity").alias("w"))
    return scatter.spread(p, "l_linenumber", 1, "pixel")


@query(f"SELECT pixel, round(sum(t * w), 2) AS num, round(sum(w), 2) AS den, round(sum(t * w) / (sum(w) + 1e-10), 5) AS trans FROM {_PATCH} GROUP BY pixel")
def stxm_scatter(spark, sf_dir):
    s = scatter.stxm(_patches(spark, sf_dir), ["pixel"], F.col("t"), F.col("w"))
    return rounded(rounded(s, 2, "num", "den"), 5, "trans")


@query(f"SELECT pixel, round((100.0 * pixel + sum(t * w)) / (100.0 + sum(w)), 5) AS o FROM {_PATCH} GROUP BY pixel")
def object_update(spark, sf_dir):
    s = scatter.scatter_add(_patches(spark, sf_dir), ["pixel"], num=F.col("t") * F.col("w"), den=F.col("w"))
    return rounded(s.select("pixel", scatter.object_update(F.col("pixel"), F.col("num"), F.col("den"), 100.0).alias("o")), 5, "o")


@query(f"SELECT pixel, round(CASE WHEN abs(den) < 1e-8 THEN num ELSE num / den END, 5) AS o FROM (SELECT pixel, sum(t * w) AS num, CASE WHEN pixel = 0 THEN 0 ELSE sum(w) END AS den FROM {_PATCH} GROUP BY pixel)")
def wasp_average(spark, sf_dir):
    s = scatter.scatter_add(_patches(spark, sf_dir), ["pixel"], num=F.col("t") * F.col("w"), den=F.when(F.col("pixel") == 0, 0.0).otherwise(F.col("w")))
    return rounded(s.select("pixel", scatter.wasp_average(F.col("num"), F.col("den")).alias("o")), 5, "o")
