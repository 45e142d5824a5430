"""Sources that a question names by their whole titles, for questions that ask to compare them.

Titles are sought as rows of tokens, words or single characters that belong to none: a title stands where its tokens do. A title is known by hashes of its
first tokens (for each of a few counts), of the most of those with its number of tokens, and of the whole. These are marked in one bitmap that goes
to every task, so of a place in a question only what all marks allow is kept: it meets the titles in an equi-join by the hash of the whole, and is compared
in full. Titles that merely begin alike aren't met. A question counts if it has a cue for a comparison and none
against it, every title it mentions belongs to one source, no two mentions overlap, and they name two sources or more.

Texts are compared in one normal form (NFKC, case folded, white space collapsed). Null and short titles name nothing; null questions name nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational as ops
from tessera.operators.fuzzy import merge_key

# What asks for a comparison, what speaks against it, and the shortest title.
CUES = ("compare", "comparison", "contrast", "versus", "vs", "difference", "differences", "respectively", "separately")
CJK_CUES = ("比较", "对比", "区别", "差异", "分别说明", "分别介绍", "分别解释")
AGAINST = ("no", "not", "without", "don't")
CJK_AGAINST = ("不要", "无需", "不必", "不比较", "不对比")
SHORTEST = 4

# Numbers of first tokens that titles are known by: words with spaces between them, up to 32.
COUNTS = (1, 2, 3, 5, 7, 15, 31, 63)

WORD = "[a-z0-9_]"
TOKEN = re.compile(f"{WORD}+|.", re.DOTALL)
MASK = (1 << 64) - 1


def _has(x: Column, words: tuple[str, ...], others: tuple[str, ...]) -> Column:
    return x.rlike(rf"(?U)\b(?:{'|'.join(words)})\b|{'|'.join(others)}")


def wants_comparison(normal: Column) -> Column:
    """Whether a question, in normal form, asks to compare or to describe separately."""
    return _has(normal, CUES, CJK_CUES) & ~_has(normal, AGAINST, CJK_AGAINST)


def hashed(text: str, ends: list[int], at: int, count: int) -> int:
    """64 bits of the tokens from a place on."""
    return int.from_bytes(blake2b(text[ends[at] : ends[at + count]].encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


def numbered(first: int, count: int) -> int:
    """64 bits of the hash of first tokens with a count of tokens."""
    x = ((first ^ count * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & MASK
    x ^= x >> 31
    return x - (x >> 63 << 64)


def all_numbered(first: int, counts: np.ndarray) -> np.ndarray:
    x = (np.uint64(first & MASK) ^ counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)).view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def hashes(titles: pa.Array) -> pa.Array:
    """What a title is known by; the last one is that of the whole."""
    out = []
    for t in titles.to_pylist():
        ends = [0, *(m.end() for m in TOKEN.finditer(t))]
        n = len(ends) - 1
        first = [hashed(t, ends, 0, c) for c in COUNTS if c <= n]
        out.append([*first, numbered(first[-1], n), hashed(t, ends, 0, n)])
    return pa.array(out, pa.list_(pa.int64()))


class Marks:
    """Two bits for each hash that is marked: what isn't marked is seldom taken for it."""

    def __init__(self, words: np.ndarray):
        self.bytes = words.tobytes()
        self.mask = 8 * len(self.bytes) - 1

    def has(self, x: int) -> bool:
        i, j = x & self.mask, x >> 32 & self.mask
        return bool(self.bytes[i >> 3] >> (i & 7) & self.bytes[j >> 3] >> (j & 7) & 1)

    def have(self, x: np.ndarray) -> np.ndarray:
        at, out = np.frombuffer(self.bytes, np.uint8), True
        for i in (x & self.mask, x >> 32 & self.mask):
            out = out & (at[i >> 3] >> (i & 7).astype(np.uint8) & 1 > 0)
        return out


def marked(known: DataFrame, most: int = 1 << 27) -> Broadcast[Marks]:
    """The hashes of known titles as a bitmap of 128 bits a title, at most `most`: a broadcast of 16 MB, beyond which more places are let through to the join."""
    bits = 1 << min(most.bit_length() - 1, max(10, (128 * known.count()).bit_length()))
    mask = bits - 1
    places = known.select(F.explode("hashes").alias("h")).select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftright("h", 32).bitwiseAND(mask))).alias("i"))
    words = places.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return known.sparkSession.sparkContext.broadcast(Marks(out))


def spots(text: str, marks: Marks, everywhere: bool = True) -> Iterator[tuple[int, int, int]]:
    """(start, end, hash) of what may be a known title in a text, or at its beginning."""
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    last = len(ends) - 1
    for k in range(last if everywhere else min(1, last)):
        if text[ends[k]] == " ":
            continue
        for c, more in zip(COUNTS, (*COUNTS[1:], last + 1), strict=True):
            if k + c > last:
                break
            first = hashed(text, ends, k, c)
            if not marks.has(first):
                break  # longer titles have their shorter beginnings marked, too
            counts = range(c, min(more, last - k + 1))
            if len(counts) <= 16:
                counts = [n for n in counts if marks.has(numbered(first, n))]
            else:
                counts = (at := np.array(counts))[marks.have(all_numbered(first, at))].tolist()
            for n in counts:
                whole = hashed(text, ends, k, n)
                if marks.has(whole):
                    yield ends[k], ends[k + n], whole


def beginnings(titles: Column, marks: Broadcast[Marks]) -> Column:
    """The hashes of what may be other titles that a title begins with."""

    def found(titles: pa.Array) -> pa.Array:
        return pa.array([[h for _, end, h in spots(t, marks.value, False) if end < len(t)] for t in titles.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(found, T.ArrayType(T.LongType()))(titles)


def places(questions: Column, marks: Broadcast[Marks]) -> Column:
    """What may be titles in a question; one question at a time."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for questions in batches:
            out = []
            for q in questions:
                start, _, key = zip(*rows, strict=True) if (rows := list(spots(q.as_py(), marks.value))) else ((), (), ())
                out.append(pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(key, pa.int64())], ["start", "key"]))
            lengths = np.cumsum([0, *map(len, out)], dtype="int32")
            flat = pa.concat_arrays(out) if out else pa.array([], pa.struct([("start", pa.int32()), ("key", pa.int64())]))
            yield pa.ListArray.from_arrays(pa.array(lengths), flat)

    kind = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("key", T.LongType())])
    return F.arrow_udf(found, T.ArrayType(kind))(questions)


def known_titles(titles: DataFrame) -> DataFrame:
    """(title, source, sources, hashes, key): each title once, and what it is known by."""
    t = titles.where(F.col("source").isNotNull()).select("source", merge_key("title").alias("title")).where(F.length("title") >= SHORTEST).distinct()
    t = t.groupBy("title").agg(F.min("source").alias("source"), F.count("*").alias("sources"))
    return t.withColumn("hashes", hashes("title")).withColumn("key", F.element_at("hashes", -1))


def stands(title: Column, text: Column, start: Column | int) -> Column:
    """Whether a title is what the text has from a place on where a token begins (0 is the first), and ends no earlier than the token."""
    size = F.length(title)
    goes_on = F.right(title, F.lit(1)).rlike(WORD) & F.substring(text, start + size + 1, F.lit(1)).rlike(WORD)
    return (F.substring(text, start + F.lit(1), size) == title) & ~goes_on


def decisive(titles: DataFrame) -> DataFrame:
    """The known titles that begin with one other title at most.

    A mention of one that begins with two is a mention of both, at one place, so the question has overlapping mentions without it.
    """
    known = ops.settled(known_titles(titles))
    return _decisive(known, marked(known))


def _decisive(known: DataFrame, marks: Broadcast[Marks]) -> DataFrame:
    each = known.select(F.col("title").alias("whole"), F.explode(beginnings(F.col("title"), marks)).alias("key"))
    begun = each.join(known.select("key", "title"), "key").where((F.length("whole") > F.length("title")) & stands(F.col("title"), F.col("whole"), F.lit(0)))
    deep = begun.groupBy(F.col("whole").alias("title")).agg(F.count("*").alias("begins")).where("begins > 1")
    return known.join(deep, "title", "left_anti")


def found(questions: DataFrame, known: DataFrame) -> DataFrame:
    known = ops.settled(known)
    return _found(questions, known, marked(known))


def _found(questions: DataFrame, known: DataFrame, marks: Broadcast[Marks]) -> DataFrame:
    q = questions.select("question", merge_key("text").alias("q")).where(F.col("q").isNotNull())
    # Few bytes take long to read, so the questions aren't left in as few tasks as their bytes need.
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q.sparkSession.sparkContext.defaultParallelism)
    q = ops.settled(q.where(wants_comparison(F.col("q"))).repartition(tasks, "question"))
    met = q.select("question", F.explode(places(F.col("q"), marks)).alias("o")).select("question", "o.start", "o.key").join(known.drop("hashes"), "key")
    met = met.join(q, "question").where(stands(F.col("title"), F.col("q"), F.col("start")))
    return met.select("question", "start", (F.col("start") + F.length("title")).alias("end"), "title", "source", "sources")


def mentions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(question, start, end, title, source, sources): every place of a title (source, title) in questions (question, text) that ask for a comparison."""
    return found(questions, known_titles(titles))


def compared_sources(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(question, sources): the sources that a question compares, in the order of their first mention; questions that compare none are left out."""
    known = ops.settled(known_titles(titles))
    marks = marked(known)
    m = _found(questions, _decisive(known, marks), marks)
    m = m.withColumn("clash", F.col("start") < F.lag("end", 1, 0).over(Window.partitionBy("question").orderBy("start", "end")))
    per = m.groupBy("question", "source").agg(F.min("start").alias("start"), F.bool_or("clash").alias("clash"), F.max("sources").alias("shared"))
    out = per.groupBy("question").agg(F.bool_or("clash").alias("clash"), F.max("shared").alias("shared"), F.array_sort(F.collect_list(F.struct("start", "source"))).alias("s"))
    out = out.where("NOT clash AND shared = 1 AND size(s) >= 2")
    return out.select("question", F.transform("s", lambda x: x["source"]).alias("sources"))
