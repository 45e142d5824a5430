"""Embedding near-dedup with int8 tile products and rigorous error bounds.

A vector is scaled to length one and rounded once to int8 steps; the length of what rounding leaves out bounds the error of every
product of rounded vectors. Vectors of one label and length are compared tile by tile, and what the tiles hold are the int8 codes: a
product of codes, less or plus its bound, shows for most pairs whether their cosine reaches the threshold. Only vectors with a pair
that the bound leaves open are fetched in full precision, to the tiles where that pair is, and decided there.

Equal vectors of a label meet first and are compared as one. Vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing: they are components of their own. A null id counts as no id in a
component's least id. Vectors of different lengths don't link. Equal rows are separate rows that link. Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, stored
from tessera.llm.simhash import stars

SLACK = 1e-12  # more than what double precision loses in a norm or a product of unit vectors


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, the step's size, the length of the rounded vector and that of the error, for unit rows."""
    step = np.abs(v).max(axis=1) / 127
    q = np.rint(v / step[:, None]).astype(np.int8)
    back = q * step[:, None]
    return q, step, np.linalg.norm(back, axis=1) + SLACK, np.linalg.norm(v - back, axis=1) + SLACK


def coded(v: Column) -> Column:
    """struct<q, step, size, error>: what tiles hold of a vector."""

    @F.arrow_udf("struct<q:binary,step:double,size:double,error:double>")
    def codes(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lists:
            rows = []
            for x in batch:
                q, *rest = quantised(unit(x.values.to_numpy(zero_copy_only=False)[None, :]))
                rows.append({"q": q.tobytes(), **{k: float(r[0]) for k, r in zip(("step", "size", "error"), rest, strict=True)}})
            yield pa.array(rows, pa.struct([("q", pa.binary()), *((k, pa.float64()) for k in ("step", "size", "error"))]))

    return codes(v)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of int8 rows: exact integers, in a type that the processor multiplies fast where they fit it."""
    if a.shape[1] * 127 * 127 < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return a.astype(np.float64) @ b.astype(np.float64).T


class Tile:
    """A unit's rows: the codes of both sides."""

    def __init__(self, part: pa.Table):
        get = lambda c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        self.node, self.m, mine = get("node"), get("m"), get("mine")
        self.q = np.frombuffer(b"".join(part.column("q").to_pylist()), dtype=np.int8).reshape(len(self.node), -1)
        self.step, self.size, self.error = get("step"), get("size"), get("error")
        self.i, self.j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        self.left, self.right = np.flatnonzero(mine == self.i), np.flatnonzero(mine == self.j)

    def pairs(self, least: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, sure) of rows whose cosine may be `least` or more; sure where it is, whatever rounding has done."""
        for k in range(0, len(self.left), rows):
            x = self.left[k : k + rows]
            about = products(self.q[x], self.q[self.right]) * self.step[x, None] * self.step[self.right]
            bound = self.error[x, None] + self.size[x, None] * self.error[self.right] + SLACK
            i, j = np.nonzero(about + bound >= least)
            a, b = x[i], self.right[j]
            keep = a < b if self.i == self.j else a != b
            yield a[keep], b[keep], (about - bound >= least)[i, j][keep]


def linked(tile: Tile, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """One edge for every row with a link, and how many rows it is linked with."""
    n = np.bincount(x, weights=tile.m[y], minlength=len(tile.node)) + np.bincount(y, weights=tile.m[x], minlength=len(tile.node))
    label, out = stars(len(tile.node), x, y), np.flatnonzero(n > 0)
    return pa.table({"a": tile.node[out], "b": tile.node[label[out]], "n": n[out].astype(np.int64)})


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tile: int = 2048) -> DataFrame:
    """One row per row of vectors: (id, n_links, component)."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.withColumn("fit", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))).withColumn("node", F.xxhash64("label", "v"))
    alone = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    rows = rows.where("fit")
    nodes = rows.groupBy("node", "label", "v").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    nodes = stored(nodes.withColumn("dim", F.size("v")).withColumn("c", coded(F.col("v"))), "vectors")
    sized = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiled = nodes.drop("v").join(F.broadcast(sized), ["label", "dim"]) if sized.count() <= 100_000 else nodes.drop("v").join(sized, ["label", "dim"])
    tiled = tiled.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit_of = ["label", "dim", "i", "j"]
    tiled = tiled.select("label", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "m", "c.*")

    def compare(part: pa.Table) -> pa.Table:
        """Links that the codes prove, and as rows without b the nodes with a pair that they leave open."""
        t = Tile(part)
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        open_ = np.zeros(len(t.node), dtype=bool)
        for x, y, sure in t.pairs(least):
            found.append((x[sure], y[sure]))
            open_[x[~sure]] = open_[y[~sure]] = True
        done = linked(t, *(np.concatenate(c) for c in zip(*found, strict=True)))
        at = np.flatnonzero(open_)
        left = pa.table({"a": t.node[at], "b": pa.nulls(len(at), pa.int64()), "n": pa.nulls(len(at), pa.int64())})
        out = pa.concat_tables([done, left])
        where = {"dim": t.q.shape[1], "i": t.i, "j": t.j}
        return pa.table({"label": pa.repeat(part.column("label")[0], out.num_rows), **{c: pa.array(np.full(out.num_rows, k, dtype=np.int32)) for c, k in where.items()}, **dict(zip(out.column_names, out.columns, strict=True))})

    label = vectors.schema[label_col].dataType.simpleString()
    met = stored(tiled.groupBy(*unit_of).applyInArrow(compare, f"label {label}, dim int, i int, j int, a long, b long, n long"), "tiles")

    def decide(part: pa.Table) -> pa.Table:
        """Links of the pairs that the codes leave open, by cosines in double precision."""
        t = Tile(part)
        full = unit(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t.node), -1))
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for x, y, sure in t.pairs(least):
            x, y = x[~sure], y[~sure]
            for k in range(0, len(x), 65_536):
                a, b = x[k : k + 65_536], y[k : k + 65_536]
                link = np.einsum("ij,ij->i", full[a], full[b]) >= least
                found.append((a[link], b[link]))
        return linked(t, *(np.concatenate(c) for c in zip(*found, strict=True)))

    unsure = met.where("b IS NULL").select(*unit_of, F.col("a").alias("node"))
    whole = unsure.join(nodes.select("label", "dim", "node", "m", "c.*", "v"), ["label", "dim", "node"])
    side = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("mine")
    whole = whole.join(sized, ["label", "dim"]).select(*unit_of, side, "node", "m", "q", "step", "size", "error", "v")
    more = whole.groupBy(*unit_of).applyInArrow(decide, "a long, b long, n long")
    met = stored(met.where("b IS NOT NULL").select("a", "b", "n").unionByName(more), "links")
    direct = met.groupBy("a").agg(F.sum("n").alias("n"))
    info = nodes.select("node", "m", "least").join(components(met.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = info.groupBy("root").agg(F.min("least").alias("component"))
    info = info.join(component, "root").join(direct.withColumnRenamed("a", "node"), "node", "left")
    info = info.select("node", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component")
    return rows.select("id", "node").join(info, "node").select("id", "n_links", "component").unionByName(alone)
