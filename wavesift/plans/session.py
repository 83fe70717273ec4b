"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **settings) -> SparkSession:
    """A session with the settings that results are checked under."""
    builder = SparkSession.builder.appName("wavesift")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of the batches that Python workers of engines get: what a worker holds does not grow with its frames.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch; a row is never cut."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([bkmgtp]?)b?", spark.conf.get(key, "64m").lower())
    if not size or int(size[1]) << 10 * "bkmgtp".index(size[2] or "b") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder on one machine, an error on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wavesift-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
