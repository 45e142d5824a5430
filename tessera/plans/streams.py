"""The survey's queue as a stream: leases, fences and crash budgets over messages that the events table gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import relational as ops
from tessera.registry import query
from tessera.streaming import leases, queue

C = F.col


def messages(events):
    """Events as messages of their user's queue: sign-ups and views wait, clicks claim, purchases complete, errors fail or renew."""
    op = F.when(C("event_type") == "click", "claim").when(C("event_type") == "purchase", "complete").when(C("event_type") == "error", F.when(C("event_id") % 2 == 0, "fail").otherwise("renew")).otherwise("enqueue")
    job = F.when(op == "enqueue", C("event_id"))
    return events.select(C("user_id").alias("queue"), C("event_id").alias("id"), C("ts").cast("timestamp").alias("ts"), op.alias("op"), job.alias("job"), (C("event_id") % 3).alias("worker"), F.lit(None).cast("int").alias("attempt"), C("value").alias("priority"), F.lit(12 * 3_600_000).alias("lease_ms"))


def in_pieces(spark, rows, by: str, pieces: int, step) -> None:
    """Writes rows to a folder in pieces of rising `by`, and calls step(folder) after each."""
    ops.settled(spark.range(1))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    cuts = rows.select(F.percentile_approx(by, [k / pieces for k in range(1, pieces)], 1000).alias("c")).first()["c"] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = rows if low is None else rows.where(C(by) >= F.lit(low))
        (part if high is None else part.where(C(by) < F.lit(high))).write.mode("append").parquet(f"{folder}/in")
        step(folder)


@query("st2_st4_st5_lease_stream", """
WITH RECURSIVE m AS (SELECT user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id AS id, epoch_us(ts) AS now, value AS p, event_id % 3 AS w,
  CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'renew' END ELSE 'enqueue' END AS op FROM events),
r AS (SELECT DISTINCT user_id AS q, 0::BIGINT AS i, []::STRUCT(job BIGINT, p DOUBLE, a BIGINT, s VARCHAR, n INT, w BIGINT, u BIGINT, c INT)[] AS jobs, []::STRUCT(w BIGINT, job BIGINT, n INT)[] AS held, NULL::BIGINT AS x, NULL::BOOLEAN AS ok FROM events
UNION ALL SELECT q, i,
  CASE WHEN op = 'enqueue' THEN list_append(rec, {'job': id, 'p': p, 'a': now, 's': 'queued', 'n': 0::INT, 'w': NULL::BIGINT, 'u': NULL::BIGINT, 'c': 0::INT})
    ELSE list_transform(rec, lambda j: CASE WHEN NOT ok OR j.job <> x THEN j
      WHEN op = 'claim' THEN {'job': j.job, 'p': j.p, 'a': j.a, 's': 'running', 'n': j.n + 1, 'w': w, 'u': now + 43200000000, 'c': j.c}
      WHEN op = 'renew' THEN {'job': j.job, 'p': j.p, 'a': j.a, 's': j.s, 'n': j.n, 'w': j.w, 'u': now + 43200000000, 'c': j.c}
      ELSE {'job': j.job, 'p': j.p, 'a': j.a, 's': CASE op WHEN 'fail' THEN 'failed' ELSE 'completed' END, 'n': j.n, 'w': j.w, 'u': j.u, 'c': j.c} END) END,
  CASE WHEN op = 'claim' AND ok THEN list_append(list_filter(held, lambda h: h.w <> w), {'w': w, 'job': x, 'n': list_filter(rec, lambda j: j.job = x)[1].n + 1}) ELSE held END, x, ok
FROM (SELECT *, CASE op WHEN 'claim' THEN best.job WHEN 'enqueue' THEN id ELSE mine.job END AS x,
    CASE op WHEN 'enqueue' THEN true WHEN 'claim' THEN best IS NOT NULL ELSE len(list_filter(rec, lambda j: j.job = mine.job AND j.s = 'running' AND j.n = mine.n AND j.w = w)) > 0 END AS ok
  FROM (SELECT *, list_sort(list_transform(list_filter(rec, lambda j: j.s = 'queued'), lambda j: {'k': -j.p, 'a': j.a, 'job': j.job}))[1] AS best, list_filter(held, lambda h: h.w = w)[1] AS mine
    FROM (SELECT r.q, m.i, now, m.p, m.w, op, id, held, list_transform(jobs, lambda j: CASE WHEN j.s = 'running' AND j.u < now
      THEN {'job': j.job, 'p': j.p, 'a': j.a, 's': CASE WHEN j.c + 1 >= 2 THEN 'failed' ELSE 'queued' END, 'n': j.n, 'w': NULL::BIGINT, 'u': NULL::BIGINT, 'c': j.c + 1} ELSE j END) AS rec FROM r JOIN m ON m.q = r.q AND m.i = r.i + 1)))),
f AS (SELECT q, unnest(jobs) AS j, (SELECT max(epoch_us(ts)) FROM events) AS z FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY i DESC) = 1),
k AS (SELECT q, x AS job, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused FROM r WHERE x IS NOT NULL GROUP BY ALL)
SELECT f.q AS queue, f.j.job AS job, CASE WHEN f.j.s = 'running' AND f.j.u < z THEN CASE WHEN f.j.c + 1 >= 2 THEN 'failed' ELSE 'queued' END ELSE f.j.s END AS status, f.j.n AS attempt, f.j.c + (f.j.s = 'running' AND f.j.u < z)::INT AS crashes, accepted, refused FROM f JOIN k ON k.q = f.q AND k.job = f.j.job
""")
def _(t):
    # Three pieces of the log in turn, the stream ended and begun again between them.
    spark, found = t("events").sparkSession, {}

    def step(folder: str) -> None:
        stream = spark.readStream.schema(leases.MESSAGE).parquet(f"{folder}/in")
        leases.run_available(stream, f"{folder}/log", f"{folder}/state", max_crashes=2)
        found["log"] = f"{folder}/log"

    in_pieces(spark, messages(t("events")), "ts", 3, step)
    now = t("events").agg(F.max(F.unix_micros(C("ts").cast("timestamp"))).alias("z")).first()["z"] or 0
    return leases.board(spark.read.schema(leases.LOG).parquet(found["log"]), now, max_crashes=2)


@query("st3_lease_sessions", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CASE event_type WHEN 'click' THEN 21600 WHEN 'view' THEN 43200 ELSE 3600 END * 1000000::BIGINT AS u FROM events),
n AS (SELECT *, coalesce(s > max(u) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, min(s) AS start, max(u) AS until, count(*) AS beats FROM r GROUP BY user_id, run
""")
def _(t):
    # Every event as a heartbeat whose lease hangs on its type. The last piece is a beat of nobody, long after: it lets the open leases run out.
    spark, e, found = t("events").sparkSession, t("events"), {}
    seconds = F.when(C("event_type") == "click", 21600).when(C("event_type") == "view", 43200).otherwise(3600)
    beats = e.select("user_id", C("ts").cast("timestamp").alias("ts"), seconds.alias("lease"))
    tick = beats.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit(1).alias("lease"))

    def step(folder: str) -> None:
        stream = spark.readStream.schema("user_id long, ts timestamp, lease int").parquet(f"{folder}/in")
        # The watermark has to see the tick, so its row has a key of its own.
        runs = queue.lease_sessions(stream.withColumn("user_id", F.coalesce("user_id", F.lit(-1))), "user_id", C("lease"), "0 seconds")
        runs.writeStream.format("parquet").option("path", f"{folder}/runs").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        found["runs"] = f"{folder}/runs"

    in_pieces(spark, beats.unionByName(tick), "ts", 3, step)
    runs = spark.read.schema("user_id long, start timestamp, end timestamp, beats long").parquet(found["runs"])
    return runs.where("user_id >= 0").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("until"), "beats")
