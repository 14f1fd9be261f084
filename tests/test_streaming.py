"""The event log as a stream gives what the batch gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirelake.operators import jobs
from quirelake.streaming import events

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark):
    return events.event_stream(spark, f"{SF}/events.parquet*", SCHEMA)


def test_state_machine(spark):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'running' END")
    got = run(events.live_state_machine(stream(spark).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), status.alias("status"))), "machine")
    rows = [r.asDict() for r in got.orderBy("job_id", "id").collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    state = {}
    for r in rows:
        old = state.get(r["job_id"])
        want = "start" if old is None else "allowed" if r["status"] in jobs.ALLOWED.get(old, []) else "same" if r["status"] == old else "error"
        assert r["verdict"] == want
        if want in ("start", "allowed"):
            state[r["job_id"]] = r["status"]


def test_batch_and_stream_agree_on_illegal_moves(spark, tmp_path):
    rng = random.Random(21)
    rows = [(j, i, rng.choice(("queued", "running", "completed", "partial", "failed", "cancelled"))) for j in range(60) for i in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "job_id long, id long, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    live = run(events.live_state_machine(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))), "moves")
    assert {tuple(r) for r in live.select("job_id", "id", "verdict").collect()} == {tuple(r) for r in jobs.job_state_machine(df).select("job_id", "id", "verdict").collect()}


def test_windows(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["hour"], r["event_type"]): r["n"] for r in events.hourly_counts(batch).collect()}
    got = {(r["hour"], r["event_type"]): r["n"] for r in run(events.hourly_counts(stream(spark)), "hours", "complete").collect()}
    assert got == want
    assert run(events.deduplicated(stream(spark)), "once").count() == batch.count()


def test_sessions_and_upserts(spark, tmp_path):
    rows = spark.sql("SELECT 1L user_id, timestamp'2024-01-01 10:00:00' ts, 1 event_id UNION ALL SELECT 1L, timestamp'2024-01-01 10:20:00', 2 UNION ALL SELECT 1L, timestamp'2024-01-01 12:00:00', 3")
    assert sorted(r["n"] for r in events.sessions(rows).collect()) == [1, 2]
    write = events.upsert_sink(str(tmp_path / "jobs"), "user_id", "event_id")
    for _ in range(2):  # a repeated batch overwrites itself
        write(rows, 0)
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "jobs")).collect()] == [3]
