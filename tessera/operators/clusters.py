"""Greedy clusters of numbers measured from their head: a number joins the cluster if it is at most `gap` above the cluster's first one, else it heads the next.

Heads are found by pointer jumping. Every distinct number points to the least one more than `gap` above it; from the first number of a key on, what is
marked doubles each round, by pointers that jump twice as far. Numbers meet in buckets as wide as the gap, of which none has two heads, so no task
holds a key whole, and a row finds its head in its own bucket or the one below. Integers only, so that no boundary is a matter of rounding.

Null keys and numbers are dropped; equal numbers are in one cluster; a negative gap is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import relational as ops


def _pointers(values: DataFrame, width: int, gap: int, coarse: int = 1_024) -> DataFrame:
    """(key, x, to) of the distinct values (key, x): the least value above x + gap, null if there is none."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    low = values.groupBy("key", bucket(F.col("x")).alias("b")).agg(F.min("x").alias("low"))
    # Where x + gap falls: the least value above it in that bucket, or the first one of a later bucket.
    probe = values.select("key", bucket(F.col("x") + gap).alias("b"), (F.col("x") + gap).alias("at"), F.lit(0).alias("kind"))
    have = values.select("key", bucket(F.col("x")).alias("b"), F.col("x").alias("at"), F.lit(1).alias("kind"))
    above = Window.partitionBy("key", "b").orderBy("at", F.desc("kind")).rowsBetween(1, Window.unboundedFollowing)
    met = probe.unionByName(have).withColumn("near", F.min(F.when(F.col("kind") == 1, F.col("at"))).over(above)).where("kind = 0")
    # Then the first value of a later bucket: within a stretch of buckets, else in a later stretch.
    places = met.select("key", "b").distinct().join(low.select("key", "b"), ["key", "b"], "left_anti").select("key", "b", F.lit(None).cast("long").alias("low"))
    every = low.select("key", "b", "low").unionByName(places).withColumn("s", F.floor(F.col("b") / coarse))
    ahead = F.min("low").over(Window.partitionBy("key", "s").orderBy("b").rangeBetween(1, Window.unboundedFollowing))
    stretch = every.groupBy("key", "s").agg(F.min("low").alias("low"))
    stretch = stretch.select("key", "s", F.min("low").over(Window.partitionBy("key").orderBy("s").rangeBetween(1, Window.unboundedFollowing)).alias("later"))
    after = every.withColumn("ahead", ahead).join(stretch, ["key", "s"]).select("key", "b", F.coalesce("ahead", "later").alias("next"))
    return met.join(after, ["key", "b"]).select("key", (F.col("at") - gap).alias("x"), F.coalesce("near", "next").alias("to"))


def heads(values: DataFrame, gap: int) -> DataFrame:
    """(key, x): the heads of the values (key, x)."""
    if gap < 0:
        raise ValueError("the gap must not be negative")
    width = max(gap, 1)
    values = ops.settled(values.select("key", F.col("x").cast("long").alias("x")).dropna().distinct())
    jump = ops.settled(_pointers(values, width, gap).where("to IS NOT NULL"))
    marked = ops.settled(values.groupBy("key").agg(F.min("x").alias("x")))
    new = marked
    while not new.isEmpty():
        new = ops.settled(marked.join(jump, ["key", "x"]).select("key", F.col("to").alias("x")).join(marked, ["key", "x"], "left_anti"))
        marked = ops.settled(marked.unionByName(new))
        jump = ops.settled(jump.join(jump.select("key", F.col("x").alias("to"), F.col("to").alias("then")), ["key", "to"]).select("key", "x", F.col("then").alias("to")))
    return marked


def head_clusters(rows: DataFrame, key: str, x: str, gap: int, out: str = "head") -> DataFrame:
    """rows with the head of their cluster."""
    width = max(gap, 1)
    first = heads(rows.select(F.col(key).alias("key"), F.col(x).alias("x")), gap).withColumn("__b", F.floor(F.col("x") / width).cast("long"))
    rows = rows.dropna(subset=[key, x]).withColumn("__b", F.floor(F.col(x) / width).cast("long"))
    side = lambda d, name: first.select(F.col("key").alias(key), (F.col("__b") + d).alias("__b"), F.col("x").alias(name))
    rows = rows.join(side(0, "__own"), [key, "__b"], "left").join(side(1, "__below"), [key, "__b"], "left")
    return rows.withColumn(out, F.when(F.col("__own") <= F.col(x), F.col("__own")).otherwise(F.col("__below"))).drop("__b", "__own", "__below")


def column_edges(clusters: DataFrame, key: str, head: str, most: int = 2) -> DataFrame:
    """(key, head, n, place): the `most` largest clusters of a key, earlier ones first among equals, by their heads."""
    sized = clusters.groupBy(key, head).agg(F.count("*").alias("n"))
    kept = ops.first_per(sized, [key], [F.desc("n"), F.col(head)], most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(head)))
