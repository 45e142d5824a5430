"""A queue of jobs with leases, fences and a crash budget, as keyed state of a stream.

Messages (queue, id, ts, op, job, worker, attempt, priority, lease_ms) are taken in the order of (ts, id) within a batch:

* enqueue: `job` waits with its priority; one that waits or runs already is refused, one that has ended waits anew.
* claim: the waiting job of highest priority, the earliest and then the least among equals, or `job` if the message names one, goes to the worker
  until ts + lease_ms. Its attempt rises by one and is the fence: what comes later from another worker or attempt is refused.
* renew, complete, fail: of `job` under `attempt`, or of what the worker claimed last if the message names no job.

A lease that has run out before a message's ts, or before the watermark, takes one from the crash budget: the job waits again, or has failed with
the last one. An event-time timer does that where no message comes. State holds the jobs that wait or run, and each worker's last claim; jobs
that have ended leave it. A queue's messages go through one task in order, which is what a queue means; give one that is too hot for that several
lanes as keys (`lane`), each with its own workers. Null ops and queues without messages do nothing. Messages behind the watermark are dropped.

Every message and every lease that ran out leaves a row in the log, and `board` reads the jobs' standing off it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "queue long, id long, ts timestamp, op string, job long, worker long, attempt int, priority double, lease_ms long"
LOG = "queue long, n long, id long, at long, op string, worker long, job long, accepted boolean, status string, attempt int, crashes int, until long"
JOB = "priority double, at long, status string, attempt int, worker long, until long, crashes int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Job:
    """A job that waits (queued) or runs; times in microseconds."""

    __slots__ = ("at", "attempt", "crashes", "priority", "status", "until", "worker")

    def __init__(self, priority, at, status="queued", attempt=0, worker=None, until=None, crashes=0):
        self.priority, self.at, self.status, self.attempt, self.worker, self.until, self.crashes = priority, at, status, attempt, worker, until, crashes

    def turn(self) -> tuple:
        return (math.inf if math.isnan(self.priority) else -self.priority), self.at

    def row(self) -> tuple:
        return self.priority, self.at, self.status, self.attempt, self.worker, self.until, self.crashes


class Leases(StatefulProcessor):
    """Decides on the messages of a queue and lets leases run out."""

    def __init__(self, max_crashes: int):
        self.max_crashes = max_crashes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("jobs", "job long", JOB)
        self.claims = handle.getMapState("claims", "worker long", "job long, attempt int")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        self.read()
        for m in got.itertuples():
            now = int(m.ts.value // 1000)
            self.expire(now)
            self.decide(m, now)
        yield self.write(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.read()
        self.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield self.write(key)

    def read(self) -> None:
        self.jobs = {k[0]: Job(*v) for k, v in self.stored.iterator()}
        self.n = self.count.get()[0] if self.count.exists() else 0
        self.log, self.touched, self.had, self.held = [], set(), set(self.jobs), {}
        # Who is next, and whose lease ends next. What a job's standing no longer says is passed over when it comes up.
        self.waiting = [(*j.turn(), k) for k, j in self.jobs.items() if j.status == "queued"]
        self.running = [(j.until, k) for k, j in self.jobs.items() if j.status == "running"]
        heapify(self.waiting)
        heapify(self.running)

    def write(self, key) -> pd.DataFrame:
        for job in self.touched:
            if job in self.jobs:
                self.stored.updateValue((job,), self.jobs[job].row())
            elif job in self.had:
                self.stored.removeKey((job,))
        for worker, claim in self.held.items():
            self.claims.updateValue((worker,), claim)
        self.count.update((self.n,))
        due = min((j.until // 1000 + 1 for j in self.jobs.values() if j.status == "running"), default=None)
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)
        columns = [c.split()[0] for c in LOG.split(", ")]
        out = pd.DataFrame([(key[0], *r) for r in self.log], columns=columns)
        return out.astype({"queue": "int64", "n": "int64", "id": "Int64", "at": "int64", "worker": "Int64", "job": "Int64", "accepted": "bool", "attempt": "Int32", "crashes": "Int32", "until": "Int64"})

    def note(self, at: int, op: str, worker, job, accepted: bool, end: str | None = None, ident=None) -> None:
        """A row of the log; an end takes the job out of the queue."""
        j = self.jobs.get(job)
        self.log.append((self.n, ident, at, op, worker, job, accepted, end or (j and j.status), j and j.attempt, j and j.crashes, j and j.until))
        self.n += 1
        if accepted:
            self.touched.add(job)
            if end:
                del self.jobs[job]

    def expire(self, now: int) -> None:
        while self.running and self.running[0][0] < now:
            until, k = heappop(self.running)
            job = self.jobs.get(k)
            if job is None or (job.status, job.until) != ("running", until):
                continue
            job.status, job.worker, job.until, job.crashes = "queued", None, None, job.crashes + 1
            failed = job.crashes >= self.max_crashes
            if not failed:
                heappush(self.waiting, (*job.turn(), k))
            self.note(until, "expire", None, k, True, "failed" if failed else None)

    def first(self) -> int | None:
        """The waiting job whose turn it is; it is taken off the queue."""
        while self.waiting:
            *turn, k = heappop(self.waiting)
            job = self.jobs.get(k)
            if job is not None and job.status == "queued" and job.turn() == tuple(turn):
                return k
        return None

    def decide(self, m, now: int) -> None:
        known = lambda x: None if pd.isna(x) else int(x)
        worker, job, attempt = known(m.worker), known(m.job), known(m.attempt)
        if m.op == "enqueue":
            new = job not in self.jobs
            if new:
                self.jobs[job] = Job(float(m.priority), now)
                heappush(self.waiting, (*self.jobs[job].turn(), job))
            self.note(now, m.op, worker, job, new, ident=m.id)
        elif m.op == "claim":
            named = self.jobs.get(job)
            best = self.first() if job is None else job if named is not None and named.status == "queued" else None
            if best is not None:
                j = self.jobs[best]
                j.status, j.attempt, j.worker, j.until = "running", j.attempt + 1, worker, now + int(m.lease_ms) * 1000
                self.held[worker] = best, j.attempt
                heappush(self.running, (j.until, best))
            self.note(now, m.op, worker, best, best is not None, ident=m.id)
        elif m.op in ("renew", "complete", "fail"):
            if job is None and worker not in self.held and self.claims.containsKey((worker,)):
                self.held[worker] = self.claims.getValue((worker,))
            if job is None and worker in self.held:
                job, attempt = self.held[worker]
            j = self.jobs.get(job)
            own = j is not None and (j.status, j.attempt, j.worker) == ("running", attempt, worker)
            if own and m.op == "renew":
                j.until = now + int(m.lease_ms) * 1000
                heappush(self.running, (j.until, job))
            self.note(now, m.op, worker, job, own, {"complete": "completed", "fail": "failed"}.get(m.op) if own else None, ident=m.id)


def lane(queue: Column, job: Column, lanes: int) -> Column:
    """A key that splits a queue into lanes by its jobs; workers of a lane take its jobs only."""
    return F.xxhash64(queue, F.pmod(F.xxhash64(job), F.lit(lanes)))


def decisions(messages: DataFrame, late: str, max_crashes: int) -> DataFrame:
    """The log of a stream of messages."""
    keyed = messages.withWatermark("ts", late).groupBy("queue")
    return keyed.transformWithStateInPandas(Leases(max_crashes), LOG, "append", "eventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started here keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_available(messages: DataFrame, log: str, checkpoint: str, late: str = "0 seconds", max_crashes: int = 3) -> None:
    """Appends the decisions on all messages there are to the table `log`, going on where the checkpoint ended."""
    with keyed_state(messages.sparkSession):
        out = decisions(messages, late, max_crashes).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
        query = out.trigger(availableNow=True).start()
    query.awaitTermination()


def board(log: DataFrame, now: int, max_crashes: int = 3) -> DataFrame:
    """(queue, job, status, attempt, crashes, accepted, refused) of each job at the time `now`, in microseconds: leases older than that have run out."""
    by = ["queue", "job"]
    last = log.where("accepted").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n")))).where("r = 1")
    out = F.coalesce((F.col("status") == "running") & (F.col("until") < now), F.lit(False))
    crashes = F.col("crashes") + out.cast("int")
    status = F.when(out, F.when(crashes >= max_crashes, "failed").otherwise("queued")).otherwise(F.col("status"))
    messages = log.where("op <> 'expire' AND job IS NOT NULL").groupBy(*by).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    return last.select(*by, status.alias("status"), "attempt", crashes.alias("crashes")).join(messages, by)
