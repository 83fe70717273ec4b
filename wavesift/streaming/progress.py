"""What a running stream or engine has done so far, as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Collects (query, batch, rows) of every micro-batch; spark.streams.addListener(Progress())."""

    def __init__(self):
        self.rows: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing to note."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        self.rows.append((str(p["id"]), int(p["batchId"]), int(p.get("numInputRows", 0))))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing to note."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """Nothing to note."""

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch long, rows long")


def autosave(path: str, every: int = 10):
    """For Engine.after: writes the state every ``every`` iterations."""
    from wavesift.sources.files import write_result

    def after(engine) -> None:
        if engine.iteration % every == 0:
            write_result(engine.frames.sparkSession, path, engine.state, engine.iter_info())

    return after
