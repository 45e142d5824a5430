"""Helpers that several training-data operators use: shared storage, text keys, graph components, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session names it; only a session on one machine may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint, so that a lost executor costs a read and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as Parquet in the shared folder: for wide tables, which an RDD checkpoint would keep uncompressed."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is stored in here goes to Python in batches of so many rows, for wide rows: a task holds a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def likely(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with __hit: false only where (__d, __th) is surely none of keys (d, th).

    A bitmap of the keys' hashes, 16 bits a key and at most 2**26 bits: a broadcast of at most two million small rows. Beyond
    that it lets more documents through, which the join behind it sorts out all the same.
    """
    n = keys.count()
    bits = 1 << min(26, max(10, (16 * n).bit_length()))
    place = lambda d, th: F.pmod(F.xxhash64(d, th), F.lit(bits))
    words = keys.select(place("d", "th").alias("b")).groupBy(F.floor(F.col("b") / 32).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("__bits"))
    docs = docs.withColumn("__b", place("__d", "__th")).withColumn("__w", F.floor(F.col("__b") / 32))
    docs = docs.join(F.broadcast(words), "__w", "left")
    hit = F.expr("coalesce(shiftrightunsigned(__bits, cast(__b % 32 as int)) & 1L, 0L) = 1L")
    return docs.withColumn("__hit", hit).drop("__b", "__w", "__bits")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], uses: str, spread: list[str], how: str = "inner", per_task: int = 4_096) -> DataFrame:
    """left joined with right, which has one row a key and in `uses` how many rows of left have that key.

    A key with more than `per_task` rows is salted: its rows are dealt over several parts by a hash of the columns `spread`, and
    right's row goes to each of them. Hot keys are broadcast; as one holds more than a 50,000th of all rows, they are at most 50,000.
    """
    right = stored(right, "keys")
    total = right.agg(F.coalesce(F.sum(uses), F.lit(0)).alias("n")).first()["n"]
    per = max(per_task, total // 50_000)
    hot = stored(right.where(F.col(uses) > per).select(*keys, F.ceil(F.col(uses) / per).cast("int").alias("__n")), "hot")
    one = F.coalesce("__n", F.lit(1))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__s", F.pmod(F.xxhash64(*spread), one).cast("int")).drop("__n")
    right = right.join(F.broadcast(hot), keys, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), one - 1))).drop("__n", uses)
    return left.join(right, [*keys, "__s"], how).drop("__s")


def prefix_sums(df: DataFrame, part: list[str], order: list[str], value: str, out: str, per_task: int = 500) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `part` before this one, by `order`.

    Two levels, so that no task holds a whole part: rows fall into buckets by the leading order column (a number spread
    evenly over [0, 1)), each bucket is summed on its own, and only the bucket totals meet per part. The number of
    buckets follows the row count, so a bucket stays near `per_task` rows at any size.
    """
    buckets = max(1, df.count() // per_task)
    df = df.withColumn("__b", F.floor(F.col(order[0]) * buckets).cast("int"))
    totals = df.groupBy(*part, "__b").agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inner = Window.partitionBy(*part, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals, [*part, "__b"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__b", "__base", "__in")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a long, b long); nodes of a component share their root.

    Randomised contraction: in each round a node joins the neighbour (or itself) with the least hash, and the edges are
    carried over to the representatives. A constant share of the nodes goes in each round, so the rounds grow with the
    logarithm of the graph and the total work with its size; a hub's edges meet only in a minimum, never in a list.
    Self-loops, repeated edges and null ends are dropped.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("v"))
        least = e.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a")).getField("v").alias("root"))
        least = cut(least)
        maps.append(least)
        left = e.join(least.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(least.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        e = cut(both.where(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("__r"))
        out = m.join(later, "root", "left").select("node", F.coalesce("__r", "root").alias("root"))
    return cut(out)
