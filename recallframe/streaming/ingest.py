"""Structured Streaming: evidence ingest with exactly-once appends, and the job queue as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallframe.operators.lifecycle import SCOPE

KEY = [*SCOPE, "id"]


def dedup_stream(evidence: DataFrame, event_time: str | None = None, watermark: str = "7 days") -> DataFrame:
    """First delivery of each id. Without an event time state grows with the ids; with one, repeats later than the watermark pass."""
    if event_time is None:
        return evidence.dropDuplicates(KEY)
    return evidence.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(KEY)


def append_stream(evidence: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends deduplicated evidence to Parquet; a batch that is run again writes over its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return dedup_stream(evidence).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: What happens to a job: event in {enqueue, claim, retry, finish}, with a time and an owner.
JOB_STATE = "state string, attempts int, lease_version long, owner string, lease_until_us long"
JOB_OUT = "job_id string, state string, attempts int, lease_version long, owner string, lease_until_us long"


def _step(job: tuple, event: str, owner: str | None, at: int, lease_us: int, max_attempts: int) -> tuple:
    state, attempts, lease, holder, until = job
    expired = state == "leased" and until <= at
    if event == "enqueue" and state is None:
        return ("pending", 0, 0, None, None)
    if event == "claim" and (state in ("pending", "retry") or expired):
        if attempts >= max_attempts:
            return ("dead", attempts, lease, None, None)
        return ("leased", attempts + 1, lease + 1, owner, at + lease_us)
    if event in ("retry", "finish") and state == "leased" and holder == owner and not expired:
        return ("retry" if event == "retry" else "succeeded", attempts, lease, None, None)
    return job


def job_stream(events: DataFrame, lease_us: int = 30_000_000, max_attempts: int = 5) -> DataFrame:
    """The job machine over a stream of (job_id, event, owner, at_us): each micro-batch gives the new state of the jobs it touched."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = state.get if state.exists else (None, 0, 0, None, None)
        for row in pd.concat(list(frames)).sort_values("at_us", kind="stable").itertuples():
            job = _step(job, row.event, row.owner, row.at_us, lease_us, max_attempts)
        if job[0] is not None:
            state.update(job)
            yield pd.DataFrame([(key[0], *job)], columns=["job_id", "state", "attempts", "lease_version", "owner", "lease_until_us"])

    return events.groupBy("job_id").applyInPandasWithState(work, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.NoTimeout)


def replay_jobs(events: DataFrame, lease_us: int = 30_000_000, max_attempts: int = 5) -> DataFrame:
    """The same over a finished log, in one batch; a job's events are one group."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        job: tuple = (None, 0, 0, None, None)
        for row in pdf.sort_values("at_us", kind="stable").itertuples():
            job = _step(job, row.event, row.owner, row.at_us, lease_us, max_attempts)
        rows = [(pdf["job_id"].iloc[0], *job)] if job[0] is not None else []
        return pd.DataFrame(rows, columns=["job_id", "state", "attempts", "lease_version", "owner", "lease_until_us"])

    return events.groupBy("job_id").applyInPandas(work, JOB_OUT)
