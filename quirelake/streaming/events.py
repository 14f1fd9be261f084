"""The event log as a stream: the same state machine, live; and event-time extensions (windows, sessions, late data).

Timestamps without zone are read as UTC, as watermarks need instants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators.jobs import ALLOWED


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def live_state_machine(events: DataFrame) -> DataFrame:
    """From (job_id, id, status): each event with its verdict. Events of one batch are taken in the order of their ids; an
    illegal one leaves the state as it was; those that are not newer than the last seen are repeats."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values("id")
        out = []
        for i, new in zip(rows["id"], rows["status"], strict=True):
            if i <= last:
                verdict = "repeat"
            elif status is None or new in ALLOWED.get(status, []):
                verdict, status = "start" if status is None else "allowed", new
            else:
                verdict = "same" if new == status else "error"
            last = max(last, i)
            out.append((key[0], int(i), new, verdict))
        state.update((status, int(last)))
        yield pd.DataFrame(out, columns=["job_id", "id", "status", "verdict"])

    return events.select("job_id", "id", "status").groupBy("job_id").applyInPandasWithState(step, "job_id long, id long, status string, verdict string", "status string, last long", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_sink(path: str, key: str, order: str):
    """foreachBatch: each batch leaves its last row of each key under its own number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
