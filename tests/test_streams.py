"""The lease stream against a plain loop: pieces, restarts, timers, fences and the crash budget."""

import random
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from tessera.streaming import leases

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIELDS = ("queue", "id", "ts", "op", "job", "worker", "attempt", "priority", "lease_ms")


def log_of_messages(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows, at = [], {q: 0 for q in range(4)}
    for k in range(n):
        q = rng.choice((0, 0, 0, 1, 2, 3))
        at[q] = max(at.values()) + rng.choice((1, 1, 60, 3000))
        op = rng.choice(("enqueue", "enqueue", "claim", "claim", "renew", "complete", "fail", "other"))
        job = rng.randint(0, 12) if op == "enqueue" or rng.random() < 0.3 else None
        rows.append((q, k, ZERO + timedelta(seconds=at[q]), op, job, rng.randint(0, 2), rng.randint(1, 3) if job is not None else None, float(rng.randint(0, 3)), rng.choice((100, 2_000_000))))
    return rows


def plain_board(rows: list[tuple], now: int, budget: int) -> dict:
    """(queue, job) -> status, attempt, crashes, accepted, refused, one message after the other."""
    jobs, held, count = {}, {}, {}

    def recover(q, t):
        for (p, _), j in jobs.items():
            if p == q and j["s"] == "running" and j["until"] < t:
                j["c"] += 1
                j["s"] = "failed" if j["c"] >= budget else "queued"

    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        m = dict(zip(FIELDS, row, strict=True))
        q, t = m["queue"], int((m["ts"] - ZERO).total_seconds() * 1_000_000)
        recover(q, t)
        job, ok = m["job"], False
        if m["op"] == "enqueue":
            old = jobs.get((q, job))
            ok = old is None or old["s"] in ("completed", "failed")
            if ok:
                jobs[q, job] = {"s": "queued", "p": m["priority"], "at": t, "n": 0, "c": 0}
        elif m["op"] == "claim":
            free = sorted((-j["p"], j["at"], k) for (p, k), j in jobs.items() if p == q and j["s"] == "queued" and job in (None, k))
            job, ok = (free[0][2], True) if free else (None, False)
            if ok:
                j = jobs[q, job]
                j.update(s="running", n=j["n"] + 1, w=m["worker"], until=t + m["lease_ms"] * 1000)
                held[q, m["worker"]] = job, j["n"]
        elif m["op"] in ("renew", "complete", "fail"):
            attempt = m["attempt"]
            if job is None:
                job, attempt = held.get((q, m["worker"]), (None, None))
            j = jobs.get((q, job))
            ok = j is not None and j["s"] == "running" and j["n"] == attempt and j["w"] == m["worker"]
            if ok:
                j.update({"until": t + m["lease_ms"] * 1000} if m["op"] == "renew" else {"s": "completed" if m["op"] == "complete" else "failed"})
        else:
            continue
        if job is not None:
            a, b = count.get((q, job), (0, 0))
            count[q, job] = (a + ok, b + (not ok))
    for q in {r[0] for r in rows}:
        recover(q, now)
    return {k: (j["s"], j["n"], j["c"], *count[k]) for k, j in jobs.items()}


@pytest.mark.parametrize(("pieces", "files"), [(1, 1), (5, 2)])
def test_stream_in_pieces_ends_as_the_plain_loop(spark, tmp_path, pieces, files):
    rows = log_of_messages(300, 5)
    rows.sort(key=lambda r: r[2])
    size = len(rows) // pieces
    for k in range(pieces):
        mine = rows[k * size : (k + 1) * size if k < pieces - 1 else None]
        spark.createDataFrame(mine, leases.MESSAGE).repartition(files).write.mode("append").parquet(str(tmp_path / "in"))
        # A new query each time, begun from the checkpoint of the last one.
        stream = spark.readStream.schema(leases.MESSAGE).parquet(str(tmp_path / "in"))
        leases.run_available(stream, str(tmp_path / "log"), str(tmp_path / "state"), max_crashes=2)
    log = spark.read.schema(leases.LOG).parquet(str(tmp_path / "log"))
    now = int((max(r[2] for r in rows) - ZERO).total_seconds() * 1_000_000)
    base = int(ZERO.timestamp() * 1_000_000)
    got = {(r["queue"], r["job"]): tuple(r)[2:] for r in leases.board(log, base + now, max_crashes=2).collect()}
    want = plain_board(rows, now, 2)
    assert got == want
    assert {w[0] for w in want.values()} >= {"queued", "completed", "failed"} and any(w[4] for w in want.values()) and any(w[2] == 2 for w in want.values())
    if pieces > 1:
        # Leases that ran out while no message came were taken back by timers.
        assert log.where("op = 'expire'").count() > 0
    leases.run_available(spark.readStream.schema(leases.MESSAGE).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state"), max_crashes=2)
    assert spark.read.parquet(str(tmp_path / "log")).where("op <> 'expire'").count() == log.where("op <> 'expire'").count()


class Stub(dict):
    """A state handle, its map states and its value in memory."""

    getMapState = getValueState = lambda self, *_: Stub()
    listTimers = lambda self: []
    registerTimer = lambda self, at: None
    iterator = lambda self: iter(self.items())
    containsKey, updateValue, removeKey, getValue = dict.__contains__, dict.__setitem__, dict.__delitem__, dict.__getitem__
    exists = lambda self: bool(len(self))
    update = lambda self, v: self.updateValue("v", v)


def test_a_long_queue_costs_no_more_a_message():
    n, queue = 20_000, leases.Leases(2)
    queue.init(Stub())
    row = lambda k, op, job: (1, k, pd.Timestamp(ZERO) + pd.Timedelta(k, "s"), op, job, k, None, float(k % 7), 10**9)
    rows = [row(k, "enqueue", k) for k in range(n)] + [row(n + k, "claim", None) for k in range(n)]
    began = time.monotonic()
    (log,) = queue.handleInputRows((1,), iter([pd.DataFrame(rows, columns=FIELDS)]), None)
    assert time.monotonic() - began < 15
    assert log["job"].tolist()[n:] == sorted(range(n), key=lambda k: (-(k % 7), k)) and log["accepted"].all()
