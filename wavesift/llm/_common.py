"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Read through Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """Null texts count as empty in every operator."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bytes that Python workers get at a time: their memory then depends neither on row counts nor on text lengths.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are limited to BATCH_BYTES (lower limits stay)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, "67108864b").rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder is used on one machine (master ``local``);
    a cluster must name one.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wavesift-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one, whatever file system that is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As materialise, but a Parquet table: its size is known from its files.

    A checkpoint keeps the estimated size of its plan, in which joins multiply;
    after a chain of them the planner reckons with numbers of a million digits.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a side up to which it is broadcast; they are counted first. Rows are keys and numbers, of 100 bytes or so.
BROADCAST_ROWS = 50_000
#: Tasks that the rows of one key are dealt to in a join that is not broadcast.
SALTS = 16


def join_counted(rows: DataFrame, few: DataFrame, keys: list[str], salt: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to ``few``, which has one row for each key and is written already.

    Its rows are counted: up to ``most`` it is broadcast. Beyond, the rows of a key
    are dealt by ``salt`` to SALTS tasks, each with a copy of the key's row.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), keys, how)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")


#: Rows of a key from which join_split treats it as large, at least.
LARGE = 100


def join_split(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``per_key`` (written already), which has one row for each key and the key's number of rows in ``count``.

    No more than BROADCAST_ROWS keys can have more than that share of all rows each:
    these are broadcast, and only the rows of smaller keys are shuffled.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    large = per_key.filter(F.col(count) > max(LARGE, total // BROADCAST_ROWS))
    names = [c for c in per_key.columns if c != key]
    marked = rows.join(F.broadcast(large.withColumn("__large", F.lit(True))), key, "left")
    rest = marked.filter(F.col("__large").isNull()).select(*rows.columns).join(per_key, key)
    return marked.filter(F.col("__large").isNotNull()).select(*rows.columns, *names).unionByName(rest.select(*rows.columns, *names))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """Rows of one id and text have one key."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash.cast("string"))


def rows_of_keys(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each key in ``kept`` (its only column): of several the one whose hash is least.

    All columns stay as they are. Rows meet their keys and one another in one shuffle.
    """
    name = free_name(docs, "__key")
    kept = kept.toDF(name)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    own = docs.withColumn(name, key).join(kept, name, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return own.groupBy(name).agg(F.min_by(row, F.xxhash64(*hashed)).alias("__row")).select("__row.*")


#: Fixed value: what the tokenizers' \s matches (Unicode White_Space), as a character class body.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"

#: The words of the contracts are runs of anything but these bytes.
ASCII_SPACE = " \t\n\x0b\x0c\r"
