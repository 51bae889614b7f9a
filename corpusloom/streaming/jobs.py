"""A queue's jobs as a stream: retries, dead letters, and stale jobs by event-time timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Executors need not have this package: its code travels with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = {"start": 0, "heartbeat": 1, "complete": 2, "fail": 3}
OUT = "job_id string, at timestamp, action string, attempt int"


def decisions(events: DataFrame, late: str = "1 minute", stale_s: int = 300, max_retries: int = 2) -> DataFrame:
    """(job_id, at, action, attempt) of streamed job events (job_id, at, kind), kind being one
    of start, heartbeat, complete, fail (others and null ids or times are left out).

    ``requeue``: a job has failed, or nothing was heard of it for more than stale_s
    seconds after a start or heartbeat; ``dead``: the same beyond max_retries;
    ``completed``.  at is the time of the event, or that at which the job became stale;
    attempt counts from 1.  Staleness is a timer of the job's state: it fires when the
    watermark (``late`` behind the latest event of any job) has passed it, without a new
    event of the job, and as well when the job's next event comes too late.  State is
    a row per job that has not completed or died; events of a job that is not running
    change nothing but a start, so a job that is started anew after that counts from 1.
    Events are applied in order of time in a batch, at one time in the order of the
    kinds above; one older than the last applied is left out."""
    known = events.filter(events["kind"].isin(*KINDS) & events["job_id"].isNotNull() & events["at"].isNotNull())
    rows = known.select(known["job_id"].cast("string").alias("job_id"), known["at"].cast("timestamp").alias("at"), "kind").withWatermark("at", late)
    rows = rows.selectExpr("job_id", "at", "kind", "unix_millis(at) AS ms")
    age = stale_s * 1000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running, seen, last, failed = state.get if state.exists else (False, -1, -1, 0)
        found = []

        def over(ms: int, action: str) -> None:
            nonlocal running, failed
            attempt = failed + 1
            if action == "fail":
                failed += 1
                action = "requeue" if failed <= max_retries else "dead"
            if action != "requeue":
                failed = 0
            running = False
            found.append((key[0], ms, action, attempt))

        def expire(now: int) -> None:
            """What the timer would have done before now."""
            if running and now > last + age:
                over(last + age, "fail")

        if state.hasTimedOut:
            expire(max(state.getCurrentWatermarkMs(), last + age + 1))
        else:
            events_ = sorted(((int(ms), KINDS[k]) for p in parts for ms, k in zip(p["ms"], p["kind"])))
            for ms, kind in events_:
                if ms < seen:
                    continue
                expire(ms)
                seen = ms
                if kind == KINDS["start"]:
                    running, last = True, ms
                elif running and kind == KINDS["heartbeat"]:
                    last = ms
                elif running:
                    over(ms, "completed" if kind == KINDS["complete"] else "fail")
        if running or failed:
            state.update((running, seen, last, failed))
            if running:
                state.setTimeoutTimestamp(max(last + age, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({"job_id": [f[0] for f in found], "at": pd.to_datetime([f[1] for f in found], unit="ms", utc=True),
                                "action": [f[2] for f in found], "attempt": pd.Series([f[3] for f in found], dtype="int32")})

    return rows.groupBy("job_id").applyInPandasWithState(run, OUT, "running boolean, seen long, last long, failed int", "append", GroupStateTimeout.EventTimeTimeout)
