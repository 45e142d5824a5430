"""Quality rules by the frequency of lines across the documents of a host.

Each text is measured in one pass: words, their code points, symbols, lines that repeat an earlier one, and words in sequences of three
that the text holds more than once. Its distinct lines, normalised (A-Z lower-cased, digits 0, white space collapsed), go on as 64-bit hashes.
A line of more distinct texts of a host than `least_docs` and than `share` of all distinct texts of that host is boilerplate and is removed.
Exact copies of a text count once, as mirrored pages say nothing about their lines. A document is rejected if it has fewer than `least_words`
words, if more than half of its words are in repeated sequences, or if it is depleted: less than `least_left` of its words are outside boilerplate.

Null text: no words, rejected. A null host is a host of its own. Rows with one id are separate documents, equal texts of a host one text.
Lines without words are no lines here and stay. Empty input: empty result. Other columns, of any name, pass through `cleaned` untouched.
Words of sequences are compared by 64-bit hashes, all else of a text by its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dealt_join, stored
from tessera.llm.words import WHITE, Powers, Words, batches_of, mixed

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "struct<" + ",".join(f"{m}:long" for m in MEASURES) + ",lines:array<struct<h:long,n:long>>>"


def repeat_words(words: Words, k: int = 3) -> np.ndarray:
    """For each text the words that are in a sequence of k words which the text holds twice or more."""
    n = len(words.h)
    text = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    first = np.flatnonzero(text[: n - k + 1] == text[k - 1 :]) if n >= k else np.zeros(0, dtype=np.int64)
    h = mixed(text[first].astype(np.uint64))
    for i in range(k):
        h = mixed(h + words.h[first + i])
    _, group, times = np.unique(h, return_inverse=True, return_counts=True)
    edge = np.zeros(n + k + 1, dtype=np.int64)
    again = first[times[group] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:n] > 0)))
    return covered[words.at[1:]] - covered[words.at[:-1]]


def lines_of(text: bytes) -> tuple[int, Counter]:
    """How many lines with a word equal an earlier one, and the words of each normalised line."""
    seen, again, words = set(), 0, Counter()
    for raw, plain in zip(text.split(b"\n"), text.lower().translate(DIGITS).split(b"\n"), strict=True):
        parts = plain.split()
        if parts:
            again += raw in seen
            seen.add(raw)
            words[xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63)] += len(parts)
    return again, words


def measured(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines> of whole texts."""

    @F.arrow_udf(MEASURED)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = Powers()
        for batch in batches:
            out: dict[str, list] = {m: [] for m in (*MEASURES, "lines")}
            for _, texts in batches_of(batch.cast(pa.binary()).to_pylist()):
                w = Words(texts, powers)
                per = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[w.begin]).tolist()  # noqa: B023,E731
                out["n_words"] += np.diff(w.at).tolist()
                out["word_chars"] += per(~WHITE[w.data] & ((w.data & 0xC0) != 0x80))
                out["n_symbols"] += per(SYMBOL[w.data])
                out["n_repeat_words"] += repeat_words(w).tolist()
                for again, words in map(lines_of, texts):
                    out["n_dup_lines"].append(again)
                    out["lines"].append([{"h": h, "n": n} for h, n in words.items()])
            kinds = [("lines", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))]
            yield pa.StructArray.from_arrays([pa.array(out[m], pa.int64()) for m in MEASURES] + [pa.array(out["lines"], kinds[0][1])], [*MEASURES, "lines"])

    return measure(F.coalesce(text.cast("string"), F.lit("")))


def met(left: DataFrame, right: DataFrame, key: str, uses: str, spread: list[str], small: int = 200_000) -> DataFrame:
    """left joined with right, unique by key: broadcast if right is small, by salted keys beyond."""
    right = stored(right, "right")
    return left.join(F.broadcast(right.drop(uses)), key) if right.count() <= small else dealt_join(left, right, [key], uses, spread)


def boilerplate(rows: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(key, docs): the lines over the limits of rows (host, th, lines), by the hash of host and line, with the texts that have them."""
    texts = rows.groupBy("host", "th").agg(F.count("*").alias("copies"))
    limits = texts.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count("*") * F.lit(float(share))).alias("limit"))
    lines = rows.select("host", "th", F.explode("lines.h").alias("h"))
    per = lines.groupBy(F.xxhash64("host", "h").alias("key"), "th").agg(F.first("host").alias("host"))
    per = per.groupBy("key").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > least_docs)
    per = stored(per, "lines")
    limits = limits.join(per.groupBy("host").agg(F.count("*").alias("uses")), "host")
    return met(per, limits, "host", "uses", ["key"]).where("docs > limit").select("key", "docs")


def verdicts(rows: DataFrame, least_words: int, most_repeat: float, least_docs: int, share: float, least_left: float) -> DataFrame:
    """rows (row, host, th, measures, lines) with hits (the hashes of lines to remove), n_removed, base_failed and kept."""
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", F.xxhash64("host", "l.h").alias("key"), "l.h", "l.n")
    hits = met(lines, boilerplate(rows, least_docs, share), "key", "docs", ["row"])
    hits = hits.groupBy("row").agg(F.collect_list("h").alias("hits"), F.sum("n").alias("n_removed"))
    out = rows.join(hits, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 100 * most_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed") >= least_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def measured_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, whole: bool) -> DataFrame:
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    get = lambda c: F.col("doc").getField(c)
    cols = [get(id_col).alias("id"), F.xxhash64(get(host_col)).alias("host"), F.xxhash64(F.coalesce(get(text_col), F.lit(""))).alias("th"), measured(get(text_col)).alias("m")]
    out = row.select(F.monotonically_increasing_id().alias("row"), *cols, *([F.col("doc")] if whole else []))
    return stored(out.select("row", "id", "host", "th", *[f"m.{m}" for m in MEASURES], "m.lines", *(["doc"] if whole else [])), "measured")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_words: int = 50, most_repeat: float = 0.5, least_docs: int = 5, share: float = 0.01, least_left: float = 0.5) -> DataFrame:
    """One row per row of docs: (id, the five measures, n_removed, base_failed, kept)."""
    rows = verdicts(measured_rows(docs, id_col, text_col, host_col, whole=False), least_words, most_repeat, least_docs, share, least_left)
    return rows.select("id", *MEASURES, "n_removed", "base_failed", "kept")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_words: int = 50, most_repeat: float = 0.5, least_docs: int = 5, share: float = 0.01, least_left: float = 0.5) -> DataFrame:
    """The kept rows of docs, the lines over the limits removed from their texts."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.cast(pa.binary()).to_pylist(), hits.to_pylist(), strict=True):
            gone = set(gone)
            keep = [raw for raw in text.split(b"\n") if xxhash.xxh64_intdigest(b" ".join(raw.lower().translate(DIGITS).split())) - (1 << 63) not in gone]
            out.append(b"\n".join(keep).decode())
        return pa.array(out, pa.string())

    rows = verdicts(measured_rows(docs, id_col, text_col, host_col, whole=True), least_words, most_repeat, least_docs, share, least_left).where("kept")
    text = F.col("doc").getField(text_col)
    new = F.when(F.col("hits").isNotNull(), without(text, F.coalesce("hits", F.array().cast("array<long>")))).otherwise(text)
    return rows.select(*[(new if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
