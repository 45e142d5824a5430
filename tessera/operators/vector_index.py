"""A stored index of vectors by inverted lists, searched exactly under a filter.

Vectors are brought to length one and filed under the nearest of `lists` centroids, which are fitted on a bounded sample (`sample` rows, by a hash of
the id). Each list has a folder, is cut into tiles of about `tile` rows, and has the least and the greatest distance of its members from its centroid. A query is first
scored in the nearest lists that have rows its scope allows; the score of its last place so far, and the triangle inequality between query, centroid and
members, rule out lists that can't hold a better one, and all others are read. So the result is that of a full scan, whatever the centroids are.

The manifest, published with the lists, holds who made the vectors and a fingerprint of the rows; a search under another identity, or over
rows that aren't those of the fingerprint, is refused. Null, zero and non-finite vectors, and null ids, are not filed; vectors of another dimension than the
manifest's are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as ops
from tessera.operators.retrieval import normalised
from tessera.sources import published

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
SLACK = 1e-6  # more than what doubles and the rounding of scores lose


def limit_of(k: int) -> int:
    """How many candidates a search of k asks for. Fixed value."""
    return min(max(6 * k, k), 100)


def fingerprint(rows: DataFrame) -> str:
    """A digest of rows (id, doc, v) that doesn't depend on their order."""
    h = F.xxhash64("id", "doc", "v")
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{r['n']}:{r['x']}:{r['s']}".encode()).hexdigest()


def fit_centroids(rows: DataFrame, lists: int, sample: int, rounds: int = 5) -> np.ndarray:
    """Centroids of length one from at most `sample` rows, those of least hash of their id."""
    first = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in first], dtype=np.float64)
    c = x[:lists].copy()
    for _ in range(rounds if len(x) else 0):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build(vectors: DataFrame, path: str, identity: dict, dimension: int, lists: int = 64, sample: int = 20_000, tile: int = 8_192) -> None:
    """Publishes the index of vectors (id, doc, vector) at path, once."""
    v = F.col("vector").cast("array<double>")
    good = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select("id", "doc", v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    rows = ops.settled(rows.select("id", "doc", normalised(F.col("v")).alias("v")))
    if not rows.where(F.size("v") != dimension).isEmpty():
        raise ValueError(f"a vector's dimension isn't {dimension}")
    centroids = fit_centroids(rows, lists, sample)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            near = (x @ centroids.T).argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            away = np.linalg.norm(x - centroids[near], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*b.schema.names, "list", "away"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ops.settled(rows.mapInArrow(filed, f"id {kinds['id']}, doc {kinds['doc']}, v array<double>, list int, away double"))
    about = out.groupBy("list").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()  # a row a list
    tiles = F.element_at(F.create_map(*[F.lit(x) for r in about for x in (r["list"], -(-r["n"] // tile))]), F.col("list")) if about else F.lit(1)
    out = out.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).repartition("list", "tile")
    note = {"identity": identity, "dimension": dimension, "fingerprint": fingerprint(rows), "lists": [{**r.asDict(), "tiles": -(-r["n"] // tile), "centroid": centroids[r["list"]].tolist()} for r in about]}
    published.publish(out, path, note, ["list"])


class Index:
    """An index as it was published."""

    def __init__(self, spark: SparkSession, path: str, identity: dict, verify: bool = True):
        self.spark, self.path = spark, path
        self.note = published.note_of(spark, path)
        if json.dumps(self.note["identity"], sort_keys=True) != json.dumps(identity, sort_keys=True):
            raise ValueError("the index was made under another identity")
        self.rows = published.read(spark, path)
        if verify and fingerprint(self.rows.select("id", "doc", "v")) != self.note["fingerprint"]:
            raise ValueError("the stored vectors are not those of the manifest")
        self.lists = self.note["lists"]

    def search(self, queries: DataFrame, allowed: DataFrame, k: int, probe: int = 2) -> DataFrame:
        """(query_id, id, score, rank): for each of queries (query_id, scope, vector) the best rows whose doc its scope (scope, doc) allows.

        No allowed doc, no rows. A query without direction (null, zero, of another dimension) finds nothing.
        """
        found, _ = self.search_lists(queries, allowed, k, probe)
        return found

    def search_lists(self, queries: DataFrame, allowed: DataFrame, k: int, probe: int = 2) -> tuple[DataFrame, DataFrame]:
        """The result of search, and (query_id, list) of the lists that were read for it."""
        most = limit_of(k)
        v = F.col("vector").cast("array<double>")
        q = queries.where((F.size(v) == self.note["dimension"]) & F.exists(v, lambda x: x != 0)).select("query_id", "scope", normalised(v).alias("q"))
        q = ops.settled(q)
        empty = q.select("query_id", F.lit(None).cast(self.rows.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
        if not self.lists:
            return empty, q.select("query_id", F.lit(0).alias("list")).where("false")
        centroids = np.array([x["centroid"] for x in self.lists])
        number, near, far = (np.array([x[c] for x in self.lists]) for c in ("list", "near", "far"))
        # Which lists have rows that a scope allows, and how many tiles they have.
        allowed = allowed.select("scope", "doc").distinct()
        held = ops.settled(self.rows.select("list", "doc").distinct().join(allowed, "doc").select("scope", "list").distinct())

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each query and list the best score that a member can have."""
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    x = _matrix(part.column("q"))
                    d = np.sqrt(np.maximum(1 + (centroids**2).sum(axis=1) - 2 * (x @ centroids.T), 0))
                    gap = np.maximum(0, np.maximum(d - far, near - d) - SLACK)
                    best = 1 - gap * gap / 2
                    n = len(number)
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(np.repeat(np.arange(len(x)), n))), part.column("scope").take(pa.array(np.repeat(np.arange(len(x)), n))), pa.array(np.tile(number, len(x)).astype(np.int32)), pa.array(d.ravel()), pa.array(best.ravel())], ["query_id", "scope", "list", "d", "best"])

        kinds = {f.name: f.dataType.simpleString() for f in q.schema}
        open_ = q.mapInArrow(bounds, f"query_id {kinds['query_id']}, scope {kinds['scope']}, list int, d double, best double").join(held, ["scope", "list"])
        open_ = ops.settled(open_)
        first = ops.first_per(open_, ["query_id"], [F.col("d"), F.col("list")], probe).select("query_id", "list")
        tops = ops.settled(self._scored(q, first, allowed, most))
        last = tops.where(F.col("rank") == most).select("query_id", F.col("score").alias("last"))
        more = open_.join(first, ["query_id", "list"], "left_anti").join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("best") >= F.col("last") - SLACK)).select("query_id", "list")
        more = ops.settled(more)
        both = tops.drop("rank").unionByName(self._scored(q, more, allowed, most).drop("rank"))
        return self._ranked(both, most), first.unionByName(more)

    def _ranked(self, scored: DataFrame, most: int) -> DataFrame:
        out = ops.first_per(scored, ["query_id"], [F.desc("score"), F.col("id")], most)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return out.withColumn("rank", rank)

    def _scored(self, q: DataFrame, pairs: DataFrame, allowed: DataFrame, most: int) -> DataFrame:
        """The best rows of the lists that pairs (query_id, list) name, tile by tile."""
        tiles = F.element_at(F.create_map(*[F.lit(x) for r in self.lists for x in (r["list"], r["tiles"])]), F.col("list"))
        # Queries are cut into parts as the lists are into tiles, so no group holds all of them.
        parts = max(1, -(-q.count() // 8_192))
        asked = q.join(pairs, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
        wanted = asked.select("scope", "list", "part").distinct().join(allowed, "scope")
        rows = self.rows.join(wanted, ["list", "doc"]).select("scope", "list", "part", "tile", "id", "v")
        rows = rows.toDF(*rows.columns)  # columns of their own, so that the two sides of the cogroup share none
        types = {"query_id": q.schema["query_id"].dataType.simpleString(), "id": self.rows.schema["id"].dataType.simpleString()}
        schema = f"query_id {types['query_id']}, id {types['id']}, score double"

        def score(mine: pa.Table, of: pa.Table) -> pa.Table:
            qs, vs = _matrix(mine.column("q")), _matrix(of.column("v"))
            ids, names = of.column("id").combine_chunks(), mine.column("query_id").combine_chunks()
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            out = []
            for at in range(0, len(qs), 256):
                s = np.round(qs[at : at + 256] @ vs[order].T, 6)
                top = np.argsort(-s, axis=1, kind="stable")[:, :most]
                line = np.repeat(np.arange(len(s)), top.shape[1])
                out.append(pa.table({"query_id": names.take(pa.array(line + at)), "id": ids.take(pa.array(order[top.ravel()])), "score": s[line, top.ravel()]}))
            return pa.concat_tables(out)

        def tile_of(mine: pa.Table, of: pa.Table) -> pa.Table:
            if mine.num_rows and of.num_rows:
                return score(mine, of)
            return pa.table({"query_id": pa.array([], ARROW[types["query_id"]]), "id": pa.array([], ARROW[types["id"]]), "score": pa.array([], pa.float64())})

        by = ["scope", "list", "part", "tile"]
        met = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(tile_of, schema)
        return self._ranked(met, most)
