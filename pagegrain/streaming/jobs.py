"""Extension: outcomes of jobs that are polled, from a stream of what the polls said."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.normalize import job_state

ATTEMPTS, SECONDS = 12, 78  # fixed values: polls of a job, and the sum of the waits between them
OUTCOME = "job string, outcome string, attempts int, at timestamp"
STATE = "attempts int, first long, outcome string"


def outcomes(events: DataFrame, late: str = "10 seconds", attempts: int = ATTEMPTS, seconds: int = SECONDS) -> DataFrame:
    """One row for each job of a stream of polls (job, ts, status): success or failure at the first status that says so, timeout after so many polls or seconds without one.

    at is the time of the poll that decided, or when the time ran out. What comes after a job's outcome is ignored, until the watermark has passed the time that
    the job had; then its state goes. Polls without a job or time are left out. Polls of a batch count in order of their times; a poll that comes
    late, but within the watermark, counts when it comes. State goes by job, so that each job's polls meet in one task and nothing else does.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(outcome: str, n: int, ms: int) -> pd.DataFrame:
            return pd.DataFrame({"job": [key[0]], "outcome": [outcome], "attempts": pd.Series([n], dtype="int32"), "at": [pd.Timestamp(ms, unit="ms")]})

        if state.hasTimedOut:
            n, first, outcome = state.get
            state.remove()
            if not outcome:
                yield row("timeout", n, first + seconds * 1000)
            return
        polls = pd.concat(list(batches)).sort_values(["ms", "state"], kind="stable")
        n, first, outcome = state.get if state.exists else (0, int(polls["ms"].iloc[0]), "")
        for ms, said in zip(polls["ms"].tolist(), polls["state"].tolist(), strict=True):
            if outcome:
                break
            if ms - first > seconds * 1000:
                outcome, at = "timeout", first + seconds * 1000
            else:
                n, at = n + 1, ms
                outcome = said if said != "running" else "timeout" if n >= attempts else ""
            if outcome:
                yield row(outcome, n, at)
        state.update((n, first, outcome))
        state.setTimeoutTimestamp(max(first + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    polls = events.where("job is not null and ts is not null").select(F.col("job").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("ts"), job_state(F.col("status")).alias("state"))
    polls = polls.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return polls.groupBy("job").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
