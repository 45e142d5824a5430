"""Structured Streaming forms of the queue, outbox and event-log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, size: str, slide: str | None, late: str, keys: list[str]) -> DataFrame:
    """Tumbling or sliding counts and sums per window; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def idempotent(commands: DataFrame, key: str, late: str) -> DataFrame:
    """Each command once: replays of a key within the watermark are dropped."""
    return commands.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def outbox(rows: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, key: str) -> StreamingQuery:
    """At-least-once projection: every batch's rows, once per key, go to an idempotent upsert."""
    return rows.writeStream.foreachBatch(lambda df, _: apply(df.dropDuplicates([key]))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lease_sessions(beats: DataFrame, key: str, seconds: Column, late: str) -> DataFrame:
    """(key, start, end, beats) of the runs of heartbeats (key, ts) in which each comes before the lease of an earlier one has ended; every row has its lease's seconds.

    A run ends when the watermark has passed its last lease, and is given then. Rows without a key make no run.
    """
    w = F.session_window("ts", F.concat(seconds.cast("string"), F.lit(" seconds")))
    out = beats.where(F.col(key).isNotNull()).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("beats"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def renewal_interval(lease_seconds: Column) -> Column:
    """How often a lease is renewed: a third of it, between 0.05 and 30 seconds."""
    return F.greatest(F.lit(0.05), F.least(F.lit(30.0), F.greatest(F.lit(1), lease_seconds) / 3))
