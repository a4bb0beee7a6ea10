"""Event statistics as streams: admission, rate limits, daily rollups, one-time tokens, job states."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ALLOWED = ["click", "view", "purchase", "signup", "error"]


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def admitted(events: DataFrame, allowed: list[str] = ALLOWED) -> DataFrame:
    """Events of known kinds only."""
    return events.where(F.col("event_type").isin(*allowed))


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of each user in tumbling minutes; a minute is closed when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("minute"), "user_id", "n")


def over_limit(events: DataFrame, limit: int = 45) -> DataFrame:
    return per_minute(events).where(F.col("n") > limit)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The daily rollup by kind; visitors are counted approximately, as exact sets of them can't be kept in state."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("visitors"))
        .select(F.col("window.start").cast("date").alias("day"), "event_type", "events", "total", "visitors")
    )


def rolling(events: DataFrame, span: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", span, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once: a token that comes again within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


# The states of a job and where each event takes it.
STATES = {("new", "signup"): "queued", ("queued", "click"): "submitted", ("submitted", "view"): "running", ("running", "purchase"): "done", ("running", "error"): "failed"}


#: A job without an event for so long leaves the state.
JOB_TTL_MS = 48 * 3_600_000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now, steps = state.get if state.exists else ("new", 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for kind in rows.get("event_type", []):
        if (to := STATES.get((now, kind))) is not None:
            now, steps = to, steps + 1
    state.update((now, steps))
    last = int(rows["ts"].max().timestamp() * 1000) if len(rows) else 0
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + JOB_TTL_MS)
    yield pd.DataFrame({"user_id": [key[0]], "state": [now], "steps": [steps]})


def job_states(events: DataFrame, late: str = "48 hours") -> DataFrame:
    """Each user's job through its states, event by event; a job that is silent for JOB_TTL_MS is forgotten."""
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(_advance, "user_id long, state string, steps int", "state string, steps int", "update", GroupStateTimeout.EventTimeTimeout)


def upsert(path: str, keys: list[str]):
    """A foreachBatch sink that keeps the last row for each key in a Parquet table, written anew beside the old one and then read by its version."""

    def write(batch: DataFrame, version: int) -> None:
        spark: Any = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{version - 1}") if version else None
        rest = old.join(batch.select(*keys), keys, "left_anti").select(batch.columns) if old is not None else None
        (batch if rest is None else batch.unionByName(rest)).write.mode("overwrite").parquet(f"{path}/v{version}")

    return write


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its rows from memory; for tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
