"""The life of jobs as one stateful stream: claims with leases, monotone progress, retries, and cursors over a job's scopes.

Events (job, at, event, worker, progress, scope, state) are ENQUEUE, CLAIM, HEARTBEAT, DONE, FAIL and SCOPE.  A claim by a worker
holds for LEASE seconds from its last sign of life; only the owner moves a running job.  A lease that ends gives the job back,
or fails it when it is out of attempts: a timer sees to that when no event of the job comes.  The cursor of a job is ADVANCED
while it has scopes and all of them are PROCESSED, and OPEN again as soon as one is not.

``step`` and ``expired`` are the rules for one job, shared by the stream and by the batch operator ``lives``; the stream keeps a
job's state by value and its scopes by map, forgets finished jobs after ``ttl``, and is made to run with the RocksDB state store.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds of a lease, attempts, and the progress of an ended job.
LEASE, ATTEMPTS, ENDED = 900, 3, 100
#: A time before all others: no lease.
NEVER = dt.datetime(1970, 1, 1)

EVENTS = "job long, at timestamp, event string, worker string, progress int, scope string, state string"
LIFE = "job long, status string, attempts int, progress int, owner string, lease timestamp, scopes int, processed int, cursor string"


class Job(NamedTuple):
    status: str = "NEW"
    attempts: int = 0
    progress: int = 0
    owner: str = ""
    lease: dt.datetime = NEVER


def expired(job: Job, now: dt.datetime) -> Job:
    """A running job whose lease ended before ``now`` is free again, or failed when out of attempts."""
    if job.status != "RUNNING" or job.lease >= now:
        return job
    if job.attempts >= ATTEMPTS:
        return job._replace(status="FAILED", progress=ENDED, owner="", lease=NEVER)
    return job._replace(status="PENDING", owner="", lease=NEVER)


def step(job: Job, event: str, worker: str, progress: int, at: dt.datetime) -> Job:
    """A job after an event at a time."""
    job = expired(job, at)
    lease = at + dt.timedelta(seconds=LEASE)
    if event == "ENQUEUE":
        return job._replace(status="PENDING") if job.status == "NEW" else job
    if event == "CLAIM":
        free = job.status in ("PENDING", "RETRYABLE") and job.attempts < ATTEMPTS
        return job._replace(status="RUNNING", attempts=job.attempts + 1, owner=worker, lease=lease) if free else job
    if job.status != "RUNNING" or job.owner != worker:
        return job
    if event == "HEARTBEAT":
        return job._replace(progress=max(job.progress, min(ENDED, progress)), lease=lease)
    if event == "DONE":
        return job._replace(status="DONE", progress=ENDED, owner="", lease=NEVER)
    if event == "FAIL":
        return job._replace(status="FAILED" if job.attempts >= ATTEMPTS else "RETRYABLE", owner="", lease=NEVER)
    return job


def cursor(states: list[str]) -> tuple[int, int, str]:
    """(scopes, processed ones, cursor)."""
    done = sum(s.upper() == "PROCESSED" for s in states)
    return len(states), done, "ADVANCED" if states and done == len(states) else "OPEN"


def told(key: int, job: Job, states: list[str]) -> dict[str, Any]:
    scopes, processed, now = cursor(states)
    lease = None if job.lease == NEVER else job.lease
    return {"job": key, "status": job.status, "attempts": job.attempts, "progress": job.progress, "owner": job.owner, "lease": lease, "scopes": scopes, "processed": processed, "cursor": now}


def frame(rows: list[dict[str, Any]]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["lease"] = pd.to_datetime(out["lease"])
    return out


def in_order(events: pd.DataFrame) -> Iterator[tuple]:
    """(at, event, worker, progress, scope, state) by time, then event."""
    events = events.sort_values(["at", "event", "worker", "scope", "state"], kind="stable", na_position="first")
    for r in events.itertuples(index=False):
        text = lambda x: "" if x is None or x != x else str(x)
        yield r.at.to_pydatetime(), text(r.event), text(r.worker), 0 if r.progress != r.progress or r.progress is None else int(r.progress), text(r.scope), text(r.state)


class Life(StatefulProcessor):
    def __init__(self, ttl: int | None = None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.ttl and self.ttl * 1000
        self.job = handle.getValueState("job", "status string, attempts int, progress int, owner string, lease timestamp", ttl)
        self.scopes = handle.getMapState("scopes", "scope string", "state string", ttl)

    def _known(self) -> Job:
        return Job(*self.job.get()) if self.job.exists() else Job()

    def _put(self, job: Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.job.update(tuple(job))
        if job.status == "RUNNING":
            # Just after the lease has ended.
            self.handle.registerTimer(_millis(job.lease) + 1)

    def _told(self, key: int, job: Job) -> pd.DataFrame:
        return frame([told(key, job, [s for (s,) in self.scopes.values()])])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = self._known()
        for at, event, worker, progress, scope, state in in_order(pd.concat(list(rows))):
            if event == "SCOPE":
                self.scopes.updateValue((scope,), (state,))
                job = expired(job, at)
            else:
                job = step(job, event, worker, progress, at)
        self._put(job)
        yield self._told(key[0], job)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).replace(tzinfo=None)
        job = expired(self._known(), at)
        self._put(job)
        yield self._told(key[0], job)

    def close(self) -> None:
        pass


def _millis(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def live(events: DataFrame, late: str = "1 hour", time_mode: str = "EventTime", ttl: int | None = None) -> DataFrame:
    """LIFE of each job after a trigger that had an event of it or ended its lease.  Times count by the events (``EventTime``: a lease
    ends when the watermark, ``late`` behind the latest event, has passed it) or by the clock (``ProcessingTime``)."""
    if time_mode == "EventTime":
        events = events.withWatermark("at", late)
    return events.groupBy("job").transformWithStateInPandas(Life(ttl), LIFE, "Update", time_mode)


def lives(events: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """LIFE of each job (not null) by all of its events (EVENTS), leases ended by ``now``."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job, scopes = None, Job(), {}
        end = lambda: told(key, expired(job, now) if now else job, [*scopes.values()])
        for rows in frames:
            out = []
            for k, part in rows.groupby("job", sort=True):
                if k != key:
                    out += [] if key is None else [end()]
                    key, job, scopes = k, Job(), {}
                for at, event, worker, progress, scope, state in in_order(part):
                    if event == "SCOPE":
                        scopes[scope] = state
                        job = expired(job, at)
                    else:
                        job = step(job, event, worker, progress, at)
            if out:
                yield frame(out)
        if key is not None:
            yield frame([end()])

    # A job's events come in order and are folded as they come; only the job at hand is held.
    rows = events.where("job IS NOT NULL").repartition("job").sortWithinPartitions("job", "at", "event", "worker", "scope", "state")
    return rows.mapInPandas(fold, LIFE)
