"""Further operators on the driver tables, each with its SQL: tables, views, containers, colours, grids, streams."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions import complexcol as cc
from wavesift.functions import text
from wavesift.operators import partition, scan, scatter, select, setops
from wavesift.plans.demo_tables import VECTOR_SQL, WAVES_SQL, read, rounded, vector, waves
from wavesift.plans.session import shared_folder
from wavesift.streaming.live import count_chunks
from wavesift.streaming.rocking import complete_positions_stream, drain, rocksdb_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# ---- tables, views, containers ----------------------------------------------


@query("SELECT r_regionkey, r_name, 'x' AS tag, 1.5::DOUBLE AS weight FROM region")
def table_new_fields(spark, sf_dir):
    return select.new_fields(read(spark, sf_dir, "region"), tag="x", weight=1.5)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def table_add_records(spark, sf_dir):
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return select.add_records(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), r)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 5, 7)")
def table_pull_records(spark, sf_dir):
    return select.pull_records(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [3, 5, 7])


_IMAGE = f"(SELECT vec_id, k // 8 AS r, k % 8 AS c, v FROM {VECTOR_SQL})"


def _image(spark, sf_dir):
    return vector(spark, sf_dir).select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("r"), (F.col("k") % 8).alias("c"), "v")


@query(f"SELECT vec_id, r - 2 AS r, c - 1 AS c, round(v, 6) + 0.0 AS v FROM {_IMAGE} WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 3")
def view_read(spark, sf_dir):
    return rounded(select.read_view(_image(spark, sf_dir), (2, 6), (1, 4)), 6, "v")


@query(f"SELECT a.vec_id, a.r, a.c, round(coalesce(b.v, a.v), 6) + 0.0 AS v FROM {_IMAGE} a LEFT JOIN {_IMAGE} b ON a.vec_id = b.vec_id AND b.r < 3 AND b.c < 3 AND a.r = b.r + 6 AND a.c = b.c + 4")
def view_write(spark, sf_dir):
    image = _image(spark, sf_dir)
    patch = select.read_view(image, (0, 3), (0, 3))
    return rounded(select.write_view(image, patch, (6, 4), ["vec_id"], "v"), 6, "v")


@query(f"SELECT vec_id, r, 7 - c AS c, round(v, 6) + 0.0 AS v FROM {_IMAGE}")
def mirrored(spark, sf_dir):
    return rounded(_image(spark, sf_dir).withColumn("c", select.mirror(F.col("c"), 8)), 6, "v")


@query(f"SELECT vec_id, (2 * r + i)::INT AS r, (2 * c + j)::INT AS c, round(v / 4, 6) + 0.0 AS v FROM {_IMAGE}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
def upsample(spark, sf_dir):
    return rounded(select.upsample(_image(spark, sf_dir), ["vec_id"], ["r", "c"], "v", 2), 6, "v")


@query("SELECT s_suppkey, 2.5::DOUBLE AS s_acctbal FROM supplier")
def container_fill(spark, sf_dir):
    return setops.fill(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 2.5)


@query("SELECT s_suppkey, round(s_acctbal * 3.0, 4) + 0.0 AS s_acctbal FROM supplier")
def container_scalar(spark, sf_dir):
    return rounded(setops.combine(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), 3.0, [], "s_acctbal", "imul"), 4, "s_acctbal")


@query("SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def gather_parts(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return setops.gather([c, s]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT to_plane, k, round(sum(v), 5) + 0.0 AS v FROM (SELECT vec_id % 2 AS to_plane, k, v FROM {VECTOR_SQL}) GROUP BY to_plane, k")
def sum_to_buffer(spark, sf_dir):
    planes = vector(spark, sf_dir).withColumn("to_plane", F.col("vec_id") % 2)
    return rounded(scatter.scatter_add(planes, ["to_plane", "k"], v=F.col("v")), 5, "v")


@query(f"SELECT label, round(max(p), 5) AS top FROM (SELECT label, k, sum(re * re + im * im) AS p FROM {WAVES_SQL} GROUP BY label, k) GROUP BY label")
def max_abs2(spark, sf_dir):
    z = cc.cplx("re", "im")
    power = waves(spark, sf_dir).groupBy("label", "k").agg(F.sum(cc.abs2(z)).alias("p"))
    return rounded(power.groupBy("label").agg(F.max("p").alias("top")), 5, "top")


@query(f"""
WITH h AS (SELECT vec_id, k, 0.5 * atan2(im, re) / pi() + 0.5 AS h, least(sqrt(re * re + im * im), 2.0) / 2.0 AS v FROM {WAVES_SQL}),
s AS (SELECT *, floor(h * 6) AS i, h * 6 - floor(h * 6) AS f FROM h)
SELECT vec_id, k::INT AS k, floor(CASE i::INT % 6 WHEN 0 THEN v WHEN 1 THEN v * (1 - f) WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN v * (1 - (1 - f)) ELSE v END * 255 + 1e-9)::INT AS r FROM s""")
def complex_to_red(spark, sf_dir):
    h = cc.hsv(cc.cplx("re", "im"), 0.0, 2.0)
    w = waves(spark, sf_dir).select("vec_id", "k", h.alias("h"))
    f = F.col("h.h") * 6.0 - F.floor(F.col("h.h") * 6.0)
    v, i = F.col("h.v"), F.pmod(F.floor(F.col("h.h") * 6.0), F.lit(6))
    red = F.when((i == 0) | (i == 5), v).when(i == 1, v * (1 - f)).when(i == 4, v * (1 - (1 - f))).otherwise(0.0)
    return w.select("vec_id", "k", F.floor(red * 255 + 1e-9).cast("int").alias("r"))


@query(f"""
WITH c AS (SELECT vec_id, k, abs(re) AS r, abs(im) AS g, abs(re - im) / 2 AS b FROM {WAVES_SQL}), t AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c),
d AS (SELECT *, CASE WHEN top = low THEN 0 WHEN r = top THEN (g - b) / (top - low + 1e-6) WHEN g = top THEN 2 + (b - r) / (top - low + 1e-6) ELSE 4 + (r - g) / (top - low + 1e-6) END / 6 AS h FROM t)
SELECT vec_id, k::INT AS k, round(h - floor(h), 5) AS h, round(CASE WHEN top <= 1e-6 THEN 0 ELSE (top - low) / (top + 1e-6) END, 5) AS s, round(top, 5) AS v FROM d""")
def rgb_to_hsv(spark, sf_dir):
    c = F.struct(F.abs("re").alias("r"), F.abs("im").alias("g"), (F.abs(F.col("re") - F.col("im")) / 2).alias("b"))
    return rounded(waves(spark, sf_dir).select("vec_id", "k", cc.rgb_to_hsv(c).alias("x")).select("vec_id", "k", "x.h", "x.s", "x.v"), 5, "h", "s", "v")


@query("SELECT c_custkey, array_to_string([ascii(x) FOR x IN string_split(c_name, '')], ',') || repeat(',0', greatest(24 - length(c_name), 0)::BIGINT) AS codes, c_name AS back FROM customer")
def text_codes(spark, sf_dir):
    """Names as numbers and back."""
    c = read(spark, sf_dir, "customer").select("c_custkey", text.text_codes(F.col("c_name"), 24).alias("x"))
    return c.select("c_custkey", F.array_join("x", ",").alias("codes"), text.codes_text(F.col("x")).alias("back"))


# ---- grids, positions, regions ----------------------------------------------


@query("SELECT r, c, round(exp(-(r * r + c * c) / 18.0) / (18.0 * pi()), 8) AS g FROM (SELECT unnest(range(-8, 8)) AS r), (SELECT unnest(range(-8, 8)) AS c)")
def gaussian_grid(spark, sf_dir):
    g = spark.range(-8, 8).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(-8).cast("long"), F.lit(7).cast("long"))).alias("c"))
    return rounded(g.select("r", "c", (F.exp(-(F.col("r") * F.col("r") + F.col("c") * F.col("c")) / 18.0) / (18.0 * math.pi)).alias("g")), 8, "g")


@query("SELECT id AS idx, ((id % 7) // 2 * 2.0)::DOUBLE AS y, ((id % 7) % 2)::DOUBLE AS x FROM (SELECT unnest(range(20)) AS id)")
def augmented_positions(spark, sf_dir):
    own = scan.raster_scan(spark, 1.0, 2.0, 2, 4).filter("idx < 7")
    return scan.augment(own, 20, 7)


@query("""
WITH n AS (SELECT c_custkey, (c_acctbal - (la - 0.01 * (ha - la))) / ((ha - la) * 1.02) AS x, (c_custkey - (lk - 0.01 * (hk - lk))) / ((hk - lk) * 1.02) AS y FROM customer, (SELECT min(c_acctbal) AS la, max(c_acctbal) AS ha, min(c_custkey) AS lk, max(c_custkey) AS hk FROM customer))
SELECT c_custkey, least(floor((atan2(y - 0.5, x - 0.5) / (2 * pi()) + 0.5) * 6), 5)::BIGINT AS angle, least(floor(y * 6), 5)::BIGINT AS row, least(floor(x * 6), 5)::BIGINT AS col FROM n""")
def redistribute_regions(spark, sf_dir):
    c = partition.normalised(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])
    x, y = F.col("n_c_acctbal"), F.col("n_c_custkey")
    return c.select("c_custkey", *[partition.region(x, y, 6, h).alias(n) for n, h in (("angle", "angle"), ("row", "row"), ("col", "column"))])


# ---- streams ----------------------------------------------------------------



def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream; the pattern matches a file and a folder of that name alike."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query("""SELECT conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (turn BETWEEN 0 AND 3), '') AS turns, if(count(*) FILTER (turn BETWEEN 0 AND 3) = 4, 'complete', 'given_up') AS status
FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id""")
def stream_rocking(spark, sf_dir):
    """Stateful: a conversation is given out once its first four turns have come, and given up after the mark that ends the scan."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    row = "conv_id long, turn long, time timestamp"
    spark.createDataFrame([], row).write.parquet(f"{folder}/marks")
    frames = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.timestamp_seconds(1 + F.greatest("turn", F.lit(0))).alias("time"))
    marks = spark.readStream.schema(row).parquet(f"{folder}/marks")
    with rocksdb_state(spark):
        done = complete_positions_stream(frames.unionByName(marks), "conv_id", "turn", [0, 1, 2, 3], "time")
        q = done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start()
        try:
            q.processAllAvailable()
            spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.timestamp_seconds(F.lit(86400)).alias("time")).write.mode("append").parquet(f"{folder}/marks")
            drain(q)
        finally:
            q.stop()
    out = spark.read.schema("conv_id long, angles array<double>, status string").parquet(f"{folder}/out")
    return out.select("conv_id", F.array_join(F.transform("angles", lambda a: a.cast("long").cast("string")), ",").alias("turns"), "status")


@query("SELECT event_id // 500 AS chunk, count(*) AS frames FROM events GROUP BY 1")
def stream_chunk_counts(spark, sf_dir):
    """Counts of frames by chunk, kept up to date by every batch."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    counts = count_chunks(_stream(spark, sf_dir, "events").withColumnRenamed("event_id", "frame_idx"), 500)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("chunk").agg(F.max_by("frames", "epoch").alias("frames"))
