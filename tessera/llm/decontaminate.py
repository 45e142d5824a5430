"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item gives its windows of `width` consecutive words, or all its words where it has fewer. Windows of one length
form one searcher: a table of the shifts that a block of the last two words allows (a block in no window skips the
whole window), buckets of windows by the hash of that block, and in a bucket the direct comparison of all words. A
document word inside an occurrence is hit.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Null or empty texts have no words, and
so no hits; items without words have no windows. Repeated items count under their own ids each; rows with a null
item_id or null doc_id are searched like others (a null item_id is left out of the list of items). Empty tables: no
hits, or no rows. Other columns of the documents are kept as they are, but for one that has the name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored

#: Every byte that is no part of a word becomes a space, and A-Z become a-z. UTF-8 bytes from 0x80 on are word bytes.
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class WuManber:
    """All windows of one length m, searched in a list of words."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = {}

    def add(self, window: tuple, item: int | None) -> None:
        for end in range(self.block, self.m + 1):
            key = window[end - self.block : end]
            self.shift[key] = min(self.shift.get(key, self.m), self.m - end)
        same = self.buckets.setdefault(window[-self.block :], {}).setdefault(window, [])
        if item is not None and item not in same:
            same.append(item)

    def search(self, words: list[bytes], hit: np.ndarray, found: set[int]) -> None:
        m, b, shift, buckets = self.m, self.block, self.shift, self.buckets
        skip, p, n = m - b + 1, m, len(words)
        while p <= n:
            key = tuple(words[p - b : p])
            step = shift.get(key, skip)
            if step == 0:
                items = buckets[key].get(tuple(words[p - m : p]))
                if items is not None:
                    hit[p - m : p] = True
                    found.update(items)
                step = 1
            p += step


def searchers(items: list[tuple[int | None, str | None]], width: int) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text.encode() if text else None)
        m = min(width, len(words))
        for p in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, WuManber(m)).add(tuple(words[p : p + m]), item)
    return list(by_length.values())


def ranges(hit: np.ndarray) -> list[int]:
    """The hit words as flat starts and ends, for a later block of patterns to add to."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return edge.tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 13, out: str = "hits", block_bytes: int = 16_000_000) -> DataFrame:
    """docs with the struct column `out` (n_words, n_hit, items): words, hit words, sorted ids of items with an occurrence.

    The windows are broadcast, at most about `block_bytes` of test text at a time. A larger benchmark is searched block by
    block: each pass adds to the hits of the one before, which is stored in the shared folder between passes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    state = "struct<n_words:bigint,edges:array<int>,items:array<bigint>>"
    for k in range(blocks):
        patterns = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).toLocalIterator()])

        @F.arrow_udf(state)
        def search(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            tables = searchers(patterns.value, width)
            for text, before in texts:
                rows = []
                for t, old in zip(text.cast(pa.binary()).to_pylist(), before.to_pylist(), strict=True):
                    words = words_of(t)
                    hit, found = np.zeros(len(words), dtype=bool), set()
                    if old:
                        found.update(old["items"])
                        for a, b in zip(old["edges"][::2], old["edges"][1::2], strict=True):
                            hit[a:b] = True
                    for s in tables:
                        s.search(words, hit, found)
                    rows.append({"n_words": len(words), "edges": ranges(hit), "items": sorted(found)})
                yield pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("edges", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]))

        last = F.col(f"`{out}`") if k else F.lit(None).cast(state)
        docs = docs.withColumn(out, search(F.col(text_col), last))
        if k < blocks - 1:
            docs = stored(docs, "decontaminate")
    edges = F.col(f"`{out}`.edges")
    hits = F.aggregate(edges, F.lit(0).cast("long"), lambda acc, e: e - acc)  # ends less starts: the signs alternate, and the last is an end
    return docs.withColumn(out, F.struct(F.col(f"`{out}`.n_words").alias("n_words"), hits.alias("n_hit"), F.col(f"`{out}`.items").alias("items")))


def contaminated(hits):
    """At least a twentieth of the words are hit."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])
