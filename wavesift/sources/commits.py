"""Commits of a run in the shared folder: what a later session needs to go on.

Waves and state are written first, then a mark of the commit; a commit without a
mark counts as not made, and the next one of that number overwrites it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "name string, dtype string, shape array<int>, data binary"


@dataclass
class Commits:
    """Numbered commits under ``path``. Arrays and numbers are of the size of probe and object; waves are a table."""

    spark: SparkSession
    path: str

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def last(self) -> int:
        """The number of the last commit, -1 without any."""
        if not self._exists("marks"):
            return -1
        return self.spark.read.schema("number int").parquet(f"{self.path}/marks").agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]

    def write(self, number: int, arrays: dict[str, np.ndarray], numbers: dict, waves: DataFrame | None = None) -> None:
        if waves is not None:
            waves.write.mode("overwrite").parquet(f"{self.path}/waves/commit={number}")
        rows = [(k, a.dtype.str, list(a.shape), np.ascontiguousarray(a).tobytes()) for k, a in arrays.items()]
        rows.append(("numbers", "json", [], json.dumps(numbers).encode()))
        self.spark.createDataFrame(rows, ARRAYS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/commit={number}")
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/commit={number}")

    def read(self, number: int) -> tuple[dict[str, np.ndarray], dict]:
        """(arrays, numbers) of a commit."""
        arrays, numbers = {}, {}
        for r in self.spark.read.schema(ARRAYS).parquet(f"{self.path}/state/commit={number}").collect():
            if r["dtype"] == "json":
                numbers = json.loads(bytes(r["data"]))
            else:
                arrays[r["name"]] = np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]).copy()
        return arrays, numbers

    def waves(self, number: int) -> DataFrame | None:
        """The waves that one commit wrote."""
        name = f"waves/commit={number}"
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else None

    def all_waves(self, last: int) -> DataFrame:
        """The waves of all commits up to ``last``."""
        return self.spark.read.option("basePath", f"{self.path}/waves").parquet(f"{self.path}/waves").filter(F.col("commit") <= last).drop("commit")

    def forget(self, number: int) -> None:
        """Deletes waves and state of a commit that a later one has replaced."""
        self._delete(f"waves/commit={number}")
        self._delete(f"state/commit={number}")


def commit_each(engine, path: str) -> None:
    """``engine`` commits after every iteration; waves and state of the commit before go once the new one is marked."""
    commits = Commits(engine.frames.sparkSession, path)

    def after(e) -> None:
        commits.write(e.iteration, *e.snapshot())
        if commits._exists(f"marks/commit={e.iteration - 1}"):
            commits.forget(e.iteration - 1)

    engine.after = after


def resume(engine, path: str):
    """``engine``, made anew from frames and parameters, as it was at the last commit; without one it stays as it is."""
    commits = Commits(engine.frames.sparkSession, path)
    number = commits.last()
    if number >= 0:
        engine.restore(*commits.read(number), commits.waves(number))
    return engine
