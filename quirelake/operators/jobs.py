"""Jobs: state machine, progress, replay, retention, over a log of events in order of their id per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states and the moves between them.
TERMINAL = ["completed", "partial", "failed", "cancelled"]
ALLOWED = {"queued": ["running", "cancelled", "failed"], "running": TERMINAL}


def transition_verdict(before: Column, after: Column) -> Column:
    """start, same, allowed or error."""
    legal = F.lit(False)
    for state, nexts in ALLOWED.items():
        legal = legal | ((before == state) & after.isin(*nexts))
    return F.when(before.isNull(), "start").when(before == after, "same").when(legal, "allowed").otherwise("error")


def job_state_machine(events: DataFrame) -> DataFrame:
    """Each event with the state before it and its verdict; an illegal move leaves the state as it was.

    A job's states are at most queued, running and a terminal one, in this order. So the state before an event
    follows from where the job began, where it first left the queue, and where it ended: three
    aggregates, which are combined before any exchange, instead of a walk along each job."""
    at = F.struct("id", "status")
    bounds = events.groupBy("job_id").agg(
        F.min(at).alias("first"), F.min(F.when(F.col("status").isin(*ALLOWED["queued"]), at)).alias("left"), F.min(F.when(F.col("status") == "running", at)).alias("ran")
    )
    # from where the job runs, if it does
    run = F.when(F.col("first.status") == "running", F.col("first.id")).when((F.col("first.status") == "queued") & (F.col("left.status") == "running"), F.col("left.id"))
    # where it ends without having run: at its first event, or straight from the queue
    early = F.when(F.col("first.status").isin(*TERMINAL), F.col("first")).when((F.col("first.status") == "queued") & (F.col("left.status") != "running"), F.col("left"))
    bounds = bounds.select("job_id", "first", run.alias("run_id"), early.alias("early"))
    late = events.join(bounds.where("run_id is not null").select("job_id", "run_id"), "job_id").where(F.col("status").isin(*TERMINAL) & (F.col("id") > F.col("run_id")))
    ends = late.groupBy("job_id").agg(F.min(at).alias("late"))
    bounds = bounds.join(ends, "job_id", "left").select("job_id", "first", "run_id", F.coalesce("early", "late").alias("end"))
    before = (
        F.when(F.col("id") == F.col("first.id"), None)
        .when(F.col("id") > F.col("end.id"), F.col("end.status"))
        .when(F.col("id") > F.col("run_id"), "running")
        .otherwise(F.col("first.status"))
    )
    rows = events.join(bounds, "job_id").withColumn("before", before)
    return rows.withColumn("verdict", transition_verdict(F.col("before"), F.col("status"))).drop("first", "run_id", "end")


def transition_side_effects(events: DataFrame) -> DataFrame:
    """Over the moves that count: started_at of the first running one, completed_at of the last terminal one, last status."""
    moves = job_state_machine(events).where("verdict <> 'error'")
    return moves.groupBy("job_id").agg(
        F.min_by("at", F.when(F.col("status") == "running", F.col("id"))).alias("started_at"),
        F.max_by("at", F.when(F.col("status").isin(*TERMINAL), F.col("id"))).alias("completed_at"),
        F.max_by("status", "id").alias("status"),
    )


def progress_merge(events: DataFrame) -> DataFrame:
    """Live progress: a running maximum that each document.started sets anew; postprocess.* lifts it to the total."""
    w = Window.partitionBy("job_id").orderBy("id")
    rows = events.withColumn("run", F.sum(F.when(F.col("state") == "document.started", 1).otherwise(0)).over(w))
    counts = F.col("state").isin("document.started", "page.processed", "page.completed", "page.warning", "page.failed", "unit.processed", "frame.processed")
    value = F.when(F.col("state").startswith("postprocess."), F.col("total")).when(counts, F.col("current"))
    # before the first start, progress begins at zero
    live = F.max(value).over(Window.partitionBy("job_id", "run").orderBy("id"))
    live = F.when(F.col("run") == 0, F.greatest(F.coalesce(live, F.lit(0)), F.lit(0))).otherwise(live)
    return rows.withColumn("live", live.cast("long")).drop("run")


def event_rename(state: Column) -> tuple[Column, Column]:
    """Public event name and phase."""
    name = F.when(state.isin("page.completed", "page.warning", "page.failed"), state).otherwise("job.progress")
    return name, F.when(state == "page.processed", "page_pipeline").otherwise(state)


def event_page(state: Column, current: Column, selected: Column) -> Column:
    """The page that an event about a finished page means: the selected one at its place."""
    ended = state.isin("page.completed", "page.warning", "page.failed")
    return F.when(ended & (current >= 1) & (current <= F.size(selected)), F.get(selected, (current - 1).cast("int")))


def event_ids(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ids per job; heartbeats take one but are not stored."""
    return events.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("event") != "heartbeat")


def replay_after(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events after the last seen id, up to and with the first terminal one."""
    end = events.where(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min("id").alias("end_id"))
    rows = events.join(seen, "job_id").where(F.col("id") > F.col("last_id")).join(end, "job_id", "left")
    return rows.where(F.col("end_id").isNull() | (F.col("id") <= F.col("end_id"))).drop("last_id", "end_id")


def restart_recovery(jobs: DataFrame) -> DataFrame:
    open_ = F.col("status").isin("queued", "running")
    return jobs.withColumn("error_code", F.when(open_, "server_restarted").otherwise(F.col("error_code"))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def admission(marks: DataFrame, cap: int = 8) -> DataFrame:
    """Audit of a queue: marks of +1 and -1 in order; full where the sum would pass the cap."""
    depth = F.sum("mark").over(Window.partitionBy("queue").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("depth", depth).withColumn("full", F.col("depth") > cap)


def event_history(events: DataFrame, keep: int = 500) -> DataFrame:
    """The last events of each job."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("id")))).where(F.col("place") <= keep).drop("place")


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Upsert by key: the last row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def retry_lineage(jobs: DataFrame) -> DataFrame:
    """Each retry with its parent's attempt; consistent if it is one more."""
    parent = jobs.select(F.col("job_id").alias("parent_job_id"), F.col("attempt").alias("parent_attempt"))
    return jobs.join(parent, "parent_job_id").withColumn("consistent", F.col("attempt") == F.col("parent_attempt") + 1)
