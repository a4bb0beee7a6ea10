"""Runs of several stages whose results are kept, and what listens to a run."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def run_stages(spark: SparkSession, first: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str, *, inputs: str = "", again: bool = False) -> DataFrame:
    """Applies stages one after the other; each is written as Parquet under `folder` and, with the same `inputs`, stages and order, read and not computed when the run is made again."""
    df, key = first, inputs
    for name, stage in stages:
        key = hashlib.sha256(f"{key}/{name}".encode()).hexdigest()
        path = f"{folder.rstrip('/')}/{name}-{key[:16]}"
        done = None
        if not again:
            try:
                done = spark.read.parquet(path)  # written as a whole by the committer, or not there
            except AnalysisException:
                done = None
        if done is None:
            stage(df).write.mode("overwrite").parquet(path)
            done = spark.read.parquet(path)
        df = done
    return df


class Progress(StreamingQueryListener):
    """Keeps the last figures of each streaming query: rows, rows a second, batch."""

    def __init__(self, tell: Callable[[dict], None] | None = None) -> None:
        self.last: dict[str, dict] = {}
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"name": event.name, "state": "started"}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {"name": p.name, "state": "running", "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond}
        self.last[str(p.id)] = found
        if self.tell:
            self.tell(found)

    def onQueryIdle(self, event) -> None:
        self.last.setdefault(str(event.id), {})["state"] = "idle"

    def onQueryTerminated(self, event) -> None:
        self.last.setdefault(str(event.id), {})["state"] = "failed" if event.exception else "done"
