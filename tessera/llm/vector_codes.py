"""Codes of vectors by parts, with integer codebooks searched in the Walsh-Hadamard domain.

A component x becomes floor(256 * x). Each of `parts` equal consecutive parts has a codebook, which begins as that part of the vectors of least id and
takes the floors of its members' means in each round. To find the nearest entry, parts and entries are padded by zeros to a power of two
and transformed by integer butterflies; the transform multiplies every squared distance by that power, so sums of squared differences of
coefficients, taken in order of sequency, are exact and rise to the scaled distance. The entry that leads after the first coefficients is summed
up whole; entries whose sum passes its distance are out, the rest go on block by block. Nothing is rounded, and ties go to the lower index.

Vectors that are null or hold null, NaN or infinite components are dropped. Vectors shorter than the longest, or of a length that `parts` doesn't
divide, count as padded by zeros at the end. Rows with one id are separate vectors; null ids come last. Ids and vectors break ties of the first entries.
Fewer vectors than entries: so many entries. Null labels are one label. Empty input: empty result. Integers beyond 2**62 count as 2**62, and sums of
errors beyond a long as its largest value; where squares of the largest components don't fit 64 bits, unbounded integers are used, slower.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dealt_join, stored

MOST = 1 << 62
LONG = (1 << 63) - 1


def whole_numbers(v: Column) -> Column:
    """floor(256 * x) of each component. A power of two as factor loses nothing."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * F.lit(256.0)))).cast("long"))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, padded to a power of two, its coefficients by sequency (sign changes)."""
    n = 1 << max(0, x.shape[-1] - 1).bit_length()
    x = np.concatenate([x, np.zeros((*x.shape[:-1], n - x.shape[-1]), dtype=x.dtype)], axis=-1)
    step = 1
    while step < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    # Coefficient k of the butterflies has as many sign changes as the Gray code decodes from k's bits reversed.
    bits = n.bit_length() - 1
    back = [int(f"{k:0{bits}b}"[::-1], 2) if bits else 0 for k in range(n)]
    changes = []
    for g in back:
        s = g
        while g := g >> 1:
            s ^= g
        changes.append(s)
    return x[..., np.argsort(changes)]


class Codebooks:
    """Entries of each part, as they are and transformed; finds the nearest ones of many vectors."""

    def __init__(self, entries: np.ndarray):
        """entries (parts, k, width), int64 or, if large, Python integers."""
        self.entries, self.coefficients = entries, hadamard(entries)

    def nearest(self, v: np.ndarray, block: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(code, error), each (n, parts), of vectors (n, parts, width)."""
        scale = self.coefficients.shape[-1]
        code, error = np.zeros(v.shape[:2], dtype=np.int64), np.zeros(v.shape[:2], dtype=v.dtype)
        for p, book in enumerate(self.coefficients):
            x = hadamard(v[:, p])
            sums = squares(x[:, None, :block], book[None, :, :block])
            leader = np.argmin(sums, axis=1)
            bound = sums[np.arange(len(x)), leader] + squares(x[:, block:], book[leader, block:])
            i, j = np.nonzero(sums <= bound[:, None])
            sums = sums[i, j]
            for k in range(block, scale, block):
                sums = sums + squares(x[i, k : k + block], book[j, k : k + block])
                keep = sums <= bound[i]
                i, j, sums = i[keep], j[keep], sums[keep]
            # What is left of a vector comes with rising index: the least sum's first row is the code.
            first = np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else i
            best = np.minimum.reduceat(sums, first) if len(i) else sums
            hit = np.flatnonzero(sums == np.repeat(best, np.diff(np.append(first, len(i)))))
            hit = hit[np.diff(i[hit], prepend=-1) > 0]
            code[:, p], error[:, p] = j[hit], best // scale
        return code, error


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Shape:
    """How vectors are cut: the number of parts, their width, and whether sums fit 64-bit integers."""

    def __init__(self, parts: int, longest: int, largest: int):
        self.parts, self.width = parts, -(-longest // parts)
        scale = 1 << max(0, self.width - 1).bit_length()
        self.kind = np.int64 if 4 * scale * self.width * largest * largest < 1 << 63 else object

    def cut(self, lists: pa.Array) -> np.ndarray:
        """(n, parts, width) from lists of integers."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        n, whole = len(lists), self.parts * self.width
        at = lists.offsets.to_numpy()
        size = np.diff(at)
        out = np.zeros((n, whole), dtype=np.int64)
        out[np.arange(whole)[None, :] < size[:, None]] = lists.values.to_numpy()[at[0] : at[-1]]
        return out.reshape(n, self.parts, self.width).astype(self.kind)

    def pieces(self, batches: Iterator[pa.RecordBatch], rows: int = 2048):
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                piece = batch.slice(k, rows)
                yield piece, self.cut(piece.column("v"))


def refined(vectors: DataFrame, shape: Shape, books: Codebooks) -> Codebooks:
    """The codebooks after one round: floors of the means of what each entry is nearest to."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = books.entries.shape[1]
        total, count = np.zeros((shape.parts, k, shape.width), dtype=object), np.zeros((shape.parts, k), dtype=np.int64)
        for _, v in shape.pieces(batches):
            code, _ = books.nearest(v)
            for p in range(shape.parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                part = np.zeros((k, shape.width), dtype=shape.kind)
                np.add.at(part, code[:, p], v[:, p])
                total[p] += part.astype(object)
        p, e = np.nonzero(count)
        at = np.arange(shape.width)
        if len(p) and shape.width:
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(np.repeat(p, shape.width), pa.int32()),
                "e": pa.array(np.repeat(e, shape.width), pa.int32()),
                "k": pa.array(np.tile(at, len(p)), pa.int32()),
                "s": pa.array([Decimal(int(x)) for x in total[p, e].ravel()], pa.decimal128(38, 0)),
                "n": pa.array(np.repeat(count[p, e], shape.width), pa.int64()),
            })

    found = vectors.select("v").mapInArrow(sums, "p int, e int, k int, s decimal(38,0), n long").groupBy("p", "e", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for r in found.collect():  # parts x entries x width rows at most
        entries[r["p"], r["e"], r["k"]] = int(r["s"]) // r["n"]
    return Codebooks(entries)


def coded(vectors: DataFrame, shape: Shape, books: Codebooks) -> DataFrame:
    """vectors (id, label) with their code and error."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, v in shape.pieces(batches):
            code, error = books.nearest(v)
            texts = [bytes(c).hex() for c in code.astype(np.uint8)]
            total = [min(int(x), LONG) for x in error.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.array(texts, pa.string()), pa.array(total, pa.int64())], ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(codes, f"id {types['id']}, label {types['label']}, code string, error long")


def fingerprint(books: Codebooks) -> str:
    """SHA-256 of the entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per kept row of vectors: (id, code, error, label_error, codebooks_sha256)."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = stored(rows.where(F.col("x").isNotNull() & finite).select("id", "label", whole_numbers(F.col("x")).alias("v")), "vectors")
    spread = rows.agg(F.max(F.size("v")).alias("size"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    shape = Shape(parts, spread["size"] or 0, spread["most"] or 0)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = shape.cut(pa.array([r["v"] for r in first], pa.list_(pa.int64())))
    books = Codebooks(start.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = refined(rows, shape, books)
    out = stored(coded(rows, shape, books), "codes")
    out = out.withColumn("key", F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("label").cast("string"))))
    per = stored(out.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"), F.count("*").alias("n")), "labels")
    met = out.join(F.broadcast(per.drop("n")), "key") if per.count() <= 100_000 else dealt_join(out, per, ["key"], "n", ["id", "code"])
    return met.select("id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
