"""The job queue as a stream: state by job, timers for jobs that wait.

Events of a job come in batches and are applied in the order of (at, seq); batches must
follow each other in time. State is a row a job. A job that must wait, by a due time or after
a failure, gets a timer, and when the watermark passes it a notice says that it is due. The
checkpoint holds state, timers and the place in the stream, so a run goes on where the
last one ended. What a task holds at once are the events of one job in one batch.

Events: `enqueue` (a completed or running job stays as it is, others are reset), `claim` (refused
unless the job is pending, due and has attempts left), `complete`, `fail` (pending again after
a delay while attempts are left), `requeue` and `reset` (with attempts from 0). An event of a
job that was never enqueued is left out, one without a kind or of an unknown kind changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JOB = "status string, attempts int, max_attempts int, priority int, available_at long, claimed_at long, completed_at long, error string, version long"
FIELDS = [f.split()[0] for f in JOB.split(", ")]
OUT = f"id string, {JOB}, notice boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def step(job: dict | None, e: dict, delay: int) -> dict | None:
    """The job after one event; times in milliseconds."""
    kind, at = e["kind"], e["at"]
    if job is None and kind != "enqueue":
        return None
    new = dict(job) if job else {"attempts": 0, "claimed_at": None, "completed_at": None, "version": 0}
    if kind == "enqueue":
        if job and job["status"] in ("completed", "running"):
            return job
        due = e["due"] if e["due"] is not None else at
        new |= {"status": "pending", "priority": e["priority"] or 0, "max_attempts": 3 if e["max_attempts"] is None else e["max_attempts"], "available_at": due, "error": None}
    elif kind == "claim":
        if job["status"] != "pending" or job["available_at"] > at or job["attempts"] >= job["max_attempts"]:
            return job
        new |= {"status": "running", "attempts": job["attempts"] + 1, "claimed_at": at, "error": None}
    elif kind == "complete":
        new |= {"status": "completed", "completed_at": at, "error": None}
    elif kind == "fail" and job["attempts"] >= job["max_attempts"]:
        new |= {"status": "failed", "completed_at": at, "error": e["error"]}
    elif kind == "fail":
        new |= {"status": "pending", "claimed_at": None, "available_at": at + max(0, delay), "error": e["error"]}
    elif kind in ("requeue", "reset"):
        new |= {"status": "pending", "available_at": at, "claimed_at": None, "completed_at": None, "error": None, "attempts": 0 if kind == "reset" else job["attempts"]}
    else:
        return job
    return new | {"version": new["version"] + 1}


def _row(key, job: dict, notice: bool) -> Row:
    return Row(id=key[0], **{f: job[f] for f in FIELDS}, notice=notice)


class Jobs(StatefulProcessor):
    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB)

    def _job(self) -> dict | None:
        return dict(zip(FIELDS, self.state.get(), strict=True)) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = job = self._job()
        # an event without a time or a number comes after those with one
        for e in sorted(rows, key=lambda e: [(e[c] is None, e[c] or 0) for c in ("at_ms", "seq")]):
            job = step(job, {"kind": e["kind"], "at": e["at_ms"], "due": e["due_ms"], "priority": e["priority"], "max_attempts": e["max_attempts"], "error": e["error"]}, self.delay)
        if job is None or job == before:
            return
        self.state.update(tuple(job[f] for f in FIELDS))
        if before and before["status"] == "pending":  # others have no timer that may still notify
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if job["status"] == "pending" and job["available_at"] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(job["available_at"])
        yield _row(key, job, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self._job()
        if job and job["status"] == "pending" and job["available_at"] <= expiredTimerInfo.getExpiryTimeInMs():
            yield _row(key, job, True)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, delay: float = 30.0) -> DataFrame:
    """A stream of events(id, kind, at, seq, due, priority, max_attempts, error) -> a stream of jobs as they change, and of notices that jobs are due."""
    e = events.withWatermark("at", "0 seconds").withColumn("at_ms", F.unix_millis("at")).withColumn("due_ms", F.unix_millis("due"))
    return e.groupBy("id").transformWithState(Jobs(round(delay * 1000)), OUT, "Update", "EventTime")


def run_jobs(events: DataFrame, sink: str, checkpoint: str, delay: float = 30.0) -> None:
    """All events that are there, into a table of changes; a batch that is run again replaces what it wrote."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state by key with timers needs it

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    try:
        job_stream(events, delay).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def jobs(spark: SparkSession, sink: str) -> DataFrame:
    """The jobs as they stand, from the table of changes."""
    last = Window.partitionBy("id").orderBy(F.col("version").desc())
    return spark.read.schema(f"{OUT}, batch long").parquet(sink).where("NOT notice").withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "batch", "notice")
