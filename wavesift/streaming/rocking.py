"""Rocking curves: a position is complete once all its angles have arrived; positions that wait too long are given up."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMPLETE, GIVEN_UP = "complete", "given_up"


def complete_positions(frames: DataFrame, position: str, angle: str, n_angles: int) -> DataFrame:
    """Batch form: positions with ``n_angles`` distinct angles, the angles in order."""
    own = frames.groupBy(position).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(angle).alias("_d"), F.sort_array(F.collect_list(angle)).alias("angles"))
    return own.filter(F.col("_d") == n_angles).drop("_d")


class Curves(StatefulProcessor):
    """State of a position: the expected angles seen so far, whether it was given out, and its timer.

    A position has ``patience`` from its latest frame on. A complete one keeps its
    state until then, so that repeated frames do not open it anew.
    """

    def __init__(self, position: str, angle: str, angles: list[float], patience_ms: int):
        self.position, self.angle, self.angles, self.patience = position, angle, frozenset(angles), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("curve", "angles array<double>, due long, done boolean")

    def row(self, key: tuple, seen: set, status: str) -> pd.DataFrame:
        return pd.DataFrame({self.position: [key[0]], "angles": [sorted(seen)], "status": [status]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        if pd.isna(key[0]):
            return  # marks only move the watermark
        angles, due, done = self.state.get() if self.state.exists() else ([], 0, False)
        seen, latest = set(angles), due
        for pdf in rows:
            seen |= self.angles & set(pdf[self.angle].tolist())
            latest = max(latest, int(pdf["due"].max()))
        if latest > due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest)
        complete = not done and len(seen) == len(self.angles)
        self.state.update((sorted(seen), latest, done or complete))
        if complete:
            yield self.row(key, seen, COMPLETE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        angles, _, done = self.state.get()
        self.state.clear()
        if not done:
            yield self.row(key, set(angles), GIVEN_UP)

    def close(self) -> None:
        pass


def complete_positions_stream(frames: DataFrame, position: str, angle: str, angles: list[float], event_time: str, delay: str = "1 minute", patience_seconds: int = 600) -> DataFrame:
    """Stream form: (position, angles, status), complete in the batch in which the last of ``angles`` arrives.

    ``event_time`` is a timestamp after 1970. A position that has not completed ``patience_seconds``
    after its latest frame, by the watermark, comes out as given up with what it
    has, and its state goes. Frames older than the watermark (``delay`` behind the
    latest event) are late and dropped; other angles are ignored; rows without a
    position only move the watermark, so one with a later time can end a scan.
    State is kept by RocksDB (``rocksdb_state``).
    """
    kind = frames.schema[position].dataType.simpleString()
    due = (F.unix_millis(F.col(event_time)) + F.lit(1000 * patience_seconds)).alias("due")
    own = frames.select(position, F.col(angle).cast("double").alias(angle), event_time, due).withWatermark(event_time, delay)
    return own.groupBy(position).transformWithStateInPandas(
        statefulProcessor=Curves(position, angle, [float(a) for a in angles], 1000 * patience_seconds),
        outputStructType=f"{position} {kind}, angles array<double>, status string",
        outputMode="Append",
        timeMode="EventTime",
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that timers and map state need; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def kept_rows(query: StreamingQuery) -> int:
    """Rows that the state of a query's last batch holds."""
    progress = query.lastProgress
    return sum(o["numRowsTotal"] for o in progress["stateOperators"]) if progress else 0


def drain(query: StreamingQuery, seconds: float = 300) -> None:
    """Waits until all that is there was taken and no state is left: timers fire in the batch after the one that moves the watermark."""
    until = time.monotonic() + seconds
    query.processAllAvailable()
    while kept_rows(query):
        if time.monotonic() > until:
            raise TimeoutError(f"{kept_rows(query)} rows of state are left after {seconds} s")
        time.sleep(0.1)
        query.processAllAvailable()
