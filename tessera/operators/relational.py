"""Joins, windows, paging and set operators as functions of DataFrames. Ties are always broken by an explicit id."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """base with changes merged in: the newest row of each key wins."""
    return first_per(base.unionByName(changes), keys, order)


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key base doesn't have yet."""
    return rows.join(base.select(*keys), keys, "left_anti")


def changed_only(base: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The rows that differ, nulls being equal, from what base has under their key."""
    old = base.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"__{v}"))
    return rows.join(old, keys).where(differs).select(*rows.columns)


def keyset_page(df: DataFrame, order: str, ident: str, after: tuple, size: int) -> DataFrame:
    """The page behind the cursor (order falling, id rising), with one row more that tells whether another page follows."""
    cond = (F.col(order) < F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(ident) > F.lit(after[1])))
    return df.where(cond).orderBy(F.col(order).desc(), F.col(ident)).limit(size + 1)


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """The value at rank ceil(share * n) of each key."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias(out))


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged half-open intervals per key; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    df = df.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows of the same keys up to this one, by bucket and then by order.

    The bucket has to rise with the order. A key's rows are summed bucket by bucket, and only the buckets' totals meet in one window, so no
    task holds a hot key whole.
    """
    df = df.withColumn("__b", bucket).withColumn("__v", value)
    totals = df.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inner = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__in", inner).join(totals, [*keys, "__b"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__b", "__v", "__base", "__in")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Pairs with the same keys whose half-open intervals (ls, le) and (rs, re) overlap.

    Each interval is listed under the cells of `span` units that it touches, and a pair counts in the first cell it shares: the
    join is an equi-join however many intervals a key has.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / span), F.floor((F.col(e) - 1) / span)))
    a = left.where("le > ls").withColumn("__c", cells("ls", "le"))
    b = right.where("re > rs").withColumn("__c", cells("rs", "re"))
    both = a.join(b, [*keys, "__c"])
    return both.where((F.greatest("ls", "rs") < F.least("le", "re")) & (F.col("__c") == F.floor(F.greatest("ls", "rs") / span))).drop("__c")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key that is not later: a union and a running last, no range join."""
    kind = right.select(F.struct(*values)).schema[0].dataType
    both = left.withColumn("__v", F.lit(None).cast(kind)).withColumn("__t", F.col(at)).withColumn("__left", F.lit(1))
    other = right.select(F.col(key), F.struct(*values).alias("__v"), F.col(since).alias("__t"), F.lit(0).alias("__left"))
    both = both.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__left = 1")
    return both.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def neighbours(df: DataFrame, keys: list[str], ident: str, start: str, end: str, rank: str) -> DataFrame:
    """(id, before, after): the best-ranked rows of the same keys that end where this one starts, or start where it ends."""
    me = df.select(*keys, ident, start, end)
    other = df.select(*keys, F.col(ident).alias("__o"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(rank).alias("__r"))
    best = F.min_by("__o", F.struct("__r", "__o"))
    before = me.join(other.withColumnRenamed("__e", start), [*keys, start]).groupBy(ident).agg(best.alias("before"))
    after = me.join(other.withColumnRenamed("__s", end), [*keys, end]).groupBy(ident).agg(best.alias("after"))
    return me.select(ident).join(before, ident, "left").join(after, ident, "left")


def _shared(df: DataFrame) -> str:
    """The folder that the session names; only a session on one machine may do without a name."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint in the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for rounds that join what they made before: the plan then knows the files' size.

    A checkpoint keeps the size that was estimated, for a join the product of both sides. Over rounds that number's digits double and more, and
    the driver takes minutes to multiply them.
    """
    path = f"{_shared(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str], rows: int, each: int = 500_000) -> DataFrame:
    """df, of about `rows` rows, dealt by its keys to as many tasks as have about `each` rows, so that what a task holds doesn't grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def sent(small: DataFrame, most: int = 200_000) -> DataFrame:
    """A settled table, marked to go to every task if it has `most` rows or fewer, counted."""
    return F.broadcast(small) if small.count() <= most else small


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over the undirected edges (a, b).

    Every round merges each node with the neighbour of least hash, itself included, and carries the edges over to what is left: a
    constant share of the nodes goes each time, so the rounds grow with the logarithm of the graph, chains and hubs alike. A hub's
    edges meet in a minimum only. Each round is stored, so the plan stays short and its sizes are real.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    chosen: list[DataFrame] = []
    while not pairs.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(chosen)), F.col(c)), F.col(c).alias("v"))
        into = stored(pairs.groupBy("a").agg(F.least(F.min(drawn("b")), F.first(drawn("a")))["v"].alias("to")))
        chosen.append(into)
        moved = pairs.join(into, "a").select(F.col("to").alias("x"), "b").join(into.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        pairs = stored(moved.where("a <> b").distinct())
    if not chosen:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    final = chosen[-1].select(F.col("a").alias("node"), "to")
    for into in reversed(chosen[:-1]):
        final = into.select(F.col("a").alias("node"), F.col("to").alias("mid")).join(final.select(F.col("node").alias("mid"), "to"), "mid", "left").select("node", F.coalesce("to", "mid").alias("to"))
    final = stored(final)
    least = final.groupBy("to").agg(F.min("node").alias("component"))
    return final.join(least, "to").select("node", "component")


def against(rows: DataFrame, queries: DataFrame, size: Column, most_bytes: int = 64 << 20) -> DataFrame:
    """Every row with every row of a stated query set, whose bytes `size` counts.

    Up to `most_bytes` of queries go to every task. More of them are met in blocks, a partition of the queries with a partition of the rows in each task.
    """
    q = settled(queries)
    n = q.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return rows.crossJoin(F.broadcast(q)) if n <= most_bytes else rows.crossJoin(q.repartition(-(-n // most_bytes)).hint("shuffle_replicate_nl"))
