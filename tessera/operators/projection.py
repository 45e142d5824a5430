"""Projections of tables into stores of partitioned files: points by collection, and a graph's nodes, memberships and edges.

A change rewrites the partitions that it touches and no other, by dynamic partition overwrite: files elsewhere stay as they are, and the same
change again leaves the same rows. What a change empties is deleted, as an overwrite without rows would leave it. Rows are read back from a
checkpoint before their own partition is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as ops
from tessera.sources import published

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the name space of URLs in RFC 4122


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID: SHA-1 of name space and name, with version 5 and the variant's two bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 1, 1)
    part = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def store(rows: DataFrame, path: str, partition: str) -> None:
    """Writes rows over the partitions that they have."""
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(make(path))


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored rows; none where nothing is stored."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    for v in values:
        published.delete_folder(spark, f"{path}/{partition}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v))}")


def index(points: DataFrame, path: str, key: str = "id", partition: str = "collection") -> None:
    """Upserts points by (partition, key): of the partitions that points touch, rows of other keys stay. Equal keys among the points: the greatest row wins."""
    spark = points.sparkSession
    new = ops.settled(points.groupBy(partition, key).agg(F.max(F.struct(*[c for c in points.columns if c not in (key, partition)])).alias("v")).select(key, partition, "v.*"))
    old = load(spark, path, points.schema).join(F.broadcast(new.select(partition).distinct()), partition, "left_semi")
    kept = old.join(new.select(partition, key), [partition, key], "left_anti")
    store(ops.settled(kept.select(*points.columns).unionByName(new.select(*points.columns))), path, partition)


def replace(points: DataFrame, path: str, collections: list[str] | None = None, key: str = "id", partition: str = "collection") -> None:
    """Replaces the named collections (a short list), or all, by what points have of them; a collection without points goes."""
    spark = points.sparkSession
    if collections is None:
        held = load(spark, path, points.schema).select(partition).distinct()
    else:
        held = spark.createDataFrame([(c,) for c in collections], f"{partition} string")
        points = points.join(F.broadcast(held), partition, "left_semi").select(*points.columns)
    points = ops.settled(points.dropDuplicates([partition, key]))
    gone = [r[0] for r in held.join(points.select(partition).distinct(), partition, "left_anti").collect()]  # folder names
    store(points, path, partition)
    _drop_partitions(spark, path, partition, gone)


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with the partition b of their key."""
    return rows.withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


class Graph:
    """Nodes (id, ...), memberships (collection, id) and edges (id, source, target, ...) as files in buckets of their ids."""

    def __init__(self, spark: SparkSession, path: str, node: str, edge: str, buckets: int = 64):
        """node and edge: the columns of nodes and edges as DDL, the ids strings."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {"nodes": f"{node}, b int", "memberships": "id string, collection string, b int", "edges": f"{edge}, b int"}

    def table(self, name: str) -> DataFrame:
        return load(self.spark, f"{self.path}/{name}", self.schemas[name])

    def _merge(self, name: str, new: DataFrame, by: DataFrame) -> None:
        """The rows of `name` whose id `by` has go, and new ones come; only their buckets are rewritten."""
        new, by = bucketed(new, "id", self.buckets), bucketed(by, "id", self.buckets)
        touched = F.broadcast(by.select("b").distinct())  # at most as many as buckets
        old = self.table(name).join(touched, "b", "left_semi").join(by.select("id"), "id", "left_anti")
        out = ops.settled(old.select(*new.columns).unionByName(new))
        empty = by.select("b").distinct().join(out.select("b").distinct(), "b", "left_anti").collect()
        store(out, f"{self.path}/{name}", "b")
        _drop_partitions(self.spark, f"{self.path}/{name}", "b", [r["b"] for r in empty])

    def upsert_nodes(self, nodes: DataFrame, collections: str = "collections") -> None:
        """Nodes by id, the greatest row of equal ids; their memberships become exactly those of the column `collections`."""
        rest = [c for c in nodes.columns if c != "id"]
        new = ops.settled(nodes.groupBy("id").agg(F.max(F.struct(*rest)).alias("v")).select("id", "v.*"))
        self._merge("nodes", new.drop(collections), new.select("id"))
        self._merge("memberships", new.select("id", F.explode(F.array_distinct(collections)).alias("collection")), new.select("id"))

    def upsert_edges(self, edges: DataFrame) -> None:
        """Edges by id. ValueError, and nothing written, if an end isn't a node."""
        rest = [c for c in edges.columns if c != "id"]
        new = ops.settled(edges.groupBy("id").agg(F.max(F.struct(*rest)).alias("v")).select("id", "v.*"))
        nodes = self.table("nodes").select("id")
        lost = new.join(nodes.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(new.join(nodes.withColumnRenamed("id", "target"), "target", "left_anti"), allowMissingColumns=True)
        first = lost.select("id", "source", "target").limit(1).collect()
        if first:
            raise ValueError(f"an end of the edge isn't a node: {first[0].asDict()}")
        self._merge("edges", new, new.select("id"))

    def replace_all(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Builds the graph anew from nodes (with collections) and edges."""
        for name in self.schemas:
            published.delete_folder(self.spark, f"{self.path}/{name}")
        self.upsert_nodes(nodes)
        self.upsert_edges(edges)
