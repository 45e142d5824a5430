"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, and one end token. The root of the tree is the
add-one unigram distribution over all training tokens. A context of 1 to `depth` words before a token is a state of the tree
if some symbol behind it, seen `least` times or more, differs enough from what the state's parent (the context without its
oldest word) predicts: count times the log ratio has to pass the `divergence` test. Such symbols stay in the state with a
discount, and the rest of the mass goes to the parent's distribution over the other symbols, so that each state sums to one.
A token is scored in the longest suffix state.

Counts of contexts, the tests and the states are tables that grow with the corpus. As a token's probability is the root's
times one ratio for each state on the way to the longest one, a text's score is a sum over its word sequences of 1 to
depth + 1 words: of the logarithms `v` that the table of factors has for their hashes. The most frequent factors, at most
`most_held` of them, are broadcast to save their join; all others are joined by hash, so the choice changes no result.
A bitmap of at most 2**27 bits keeps sequences that surely have no factor out of the join.

Words and sequences are known by 64-bit hashes. Null or empty text: the end token alone. A null in `learns` is false. Rows are
separate even if equal. With no training rows N and V are 0, so every token has probability 1 / 1. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.shared import arrow_rows, stored
from tessera.llm.words import BASE, Powers, Words, batches_of, mixed


END = np.uint64(0xE2D0E2D0E2D0E2D1)  # the end of a text: no word's hash but by chance


def tokens_of(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts on end, and how many each has: its words with A-Z lower-cased, and the end."""
    words = Words(texts, powers, lower=True)
    counts = np.diff(words.at)
    out = np.full(len(words.h) + len(texts), END)
    out[np.arange(len(words.h)) + np.repeat(np.arange(len(texts)), counts)] = words.h
    return out, counts + 1


def tokenised(text: Column) -> Column:
    """array<bigint>: the hashes of the words, then of the end."""

    @F.arrow_udf("array<bigint>")
    def hashes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = Powers()
        for batch in texts:
            found, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
            for _, part in batches_of(batch.cast(pa.binary()).to_pylist()):
                for c, x in zip((found, counts), tokens_of(part, powers), strict=True):
                    c.append(x)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))

    return hashes(text)


def pieces(lists: pa.ListArray, most: int = 400_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, tokens, the text of each token) for consecutive whole texts of about `most` tokens together."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat, ends = lists.values.to_numpy(zero_copy_only=False), ends
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield b - a, flat[ends[a] : ends[b]].view(np.uint64), np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        a = b


def longer(before: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n tokens from each place on, from those of n - 1 tokens; places too near to the end are left out."""
    return mixed(before[: len(tokens) - n + 1] * np.uint64(BASE) + tokens[n - 1 :])


def sequences(tokens: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the sequences of 1 to n tokens."""
    out = [tokens]
    for k in range(2, n + 1):
        out.append(longer(out[-1], tokens, k) if len(tokens) >= k else np.zeros(0, dtype=np.uint64))
    return out


class Bitmap:
    """Surely absent, or perhaps there: the lowest bits of hashes, once they are shifted."""

    def __init__(self, words: np.ndarray, bits: int, shift: int):
        self.words, self.mask, self.shift = words, np.uint64((1 << bits) - 1), np.uint64(shift)

    @staticmethod
    def of(hashes: DataFrame, most_bits: int = 27, shift: int = 0) -> Bitmap:
        """16 bits for each of the hashes (h), 2**most_bits at most; beyond that more pass that aren't there."""
        bits = min(most_bits, max(10, (16 * hashes.count()).bit_length()))
        word = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << bits) - 1), 6).alias("w")
        got = hashes.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return Bitmap(words, bits, shift)

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h >> self.shift
        return (self.words[((h & self.mask) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def runs(batches: Iterator[pa.RecordBatch], n: int, parts: Bitmap | None, whole: Bitmap | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Hashes of n-token sequences of the texts (seq), and of their first and last n - 1 tokens.

    Left out are those whose parts surely aren't among `parts`, or that surely aren't among `whole`.
    """
    for batch in batches:
        for _, tokens, doc in pieces(batch.column(0)):
            if len(tokens) < n:
                continue
            *_, short, h = [tokens, *sequences(tokens, n)]
            ctx, sfx = (short[: len(h)], short[1 : len(h) + 1]) if n > 1 else (h, h)
            keep = doc[: len(h)] == doc[n - 1 :]
            if whole:
                keep &= whole.has(h)
            elif parts:
                keep &= parts.has(ctx) & parts.has(sfx)
            yield h[keep], ctx[keep], sfx[keep]


def repeated(texts: DataFrame, n: int, parts: Bitmap, least: int, tokens: int, bucket: int = 2_000_000, most: int = 1_000_000) -> Bitmap:
    """The sequences of n tokens that the texts (seq) may have `least` times or more.

    They are counted by the highest bits of their hashes: those of a bucket and 32 more. Nearly all sequences of a corpus are there but once or twice, so what is shuffled is 32 bits for each in arrays, and a
    sequence that a task has seen often counts `least` times.
    """
    model = texts.sparkSession.sparkContext.broadcast(parts)
    bits = max(4, (tokens // bucket).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u = np.repeat(u, np.minimum(c, least))
            at = np.searchsorted(u >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            low = (u >> np.uint64(32 - bits)).astype(np.uint32).view(np.int32)
            full = np.flatnonzero(np.diff(at))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at[full], len(u)), pa.int32()), pa.array(low))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), lists], ["b", "low"])

        for h, _, _ in runs(batches, n, model.value, None):
            held.append(h)
            size += len(h)
            if size > most:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come in order, so a task holds one of them at a time."""
        held, now = [], None

        def out() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held).view(np.uint32), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((now << 32) + u[c >= least].astype(np.int64))], ["h"])

        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy()
            for k, b in enumerate(batch.column(0).to_pylist()):
                if b != now and held:
                    yield out()
                    held = []
                now = b
                held.append(flat[ends[k] : ends[k + 1]].copy())
        if held:
            yield out()

    dealt = texts.select("seq").mapInArrow(deal, "b int, low array<int>").repartition(1 << bits, "b").sortWithinPartitions("b")
    found = stored(dealt.mapInArrow(merge, "h long"), "repeated")
    model.destroy()
    return Bitmap.of(found, shift=32 - bits)


def count_sequences(texts: DataFrame, n: int, whole: Bitmap | None, least: int = 1, most: int = 400_000) -> DataFrame:
    """(h, c), and from two tokens on (h, ctx, sfx, c), stored: counts of n-token sequences of texts (seq) that `whole` may have, of `least` or more.

    Every task adds up what it has read before it passes it on. ctx and sfx are the hashes of the first and last n - 1 tokens.
    """
    model = texts.sparkSession.sparkContext.broadcast(whole)
    names = ["h", "ctx", "sfx", "c"] if n > 1 else ["h", "c"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.uint64)
        held, c = [none] * (len(names) - 1), np.zeros(0, dtype=np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (*held, c)], names)
        for found in runs(batches, n, None, model.value):
            u, at, k = np.unique(found[0], return_index=True, return_counts=True)
            rows = [np.concatenate((old, new[at])) for old, new in zip(held, found, strict=False)]
            u, at, inverse = np.unique(rows[0], return_index=True, return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate((c, k)), minlength=len(u)).astype(np.int64)
            held = [x[at] for x in rows]
            if len(u) > most:
                yield out()
                held, c = [none] * len(held), c[:0]
        yield out()

    rows = texts.select("seq").mapInArrow(count, ", ".join(f"{x} long" for x in names))
    rows = rows.groupBy("h").agg(*[F.min(x).alias(x) for x in names[1:-1]], F.sum("c").alias("c"))
    rows = stored(rows.where(F.col("c") >= least), "counts")
    model.destroy()
    return rows


def states(texts: DataFrame, words: DataFrame, tokens: int, depth: int, least: int, divergence: float, discount: float) -> tuple[DataFrame, DataFrame]:
    """(h, v, c) of contexts and (h, v, c) of contexts with a symbol: the factors of the tree over texts (seq), from its words (h, c, lp) and their number; c is the sequence's count.

    A symbol kept in a state has, under the hash of context and symbol, the ratio of its probability to its parent's, less the
    state's own factor; that is the ratio by which all other symbols' probabilities change, under the hash of the context.
    """
    known, found = stored(words.where(F.col("c") >= least).select("h", "c", "lp"), "sequences"), []
    for n in range(2, depth + 2):
        often = repeated(texts, n, Bitmap.of(known.select("h")), least, tokens)
        grams = count_sequences(texts, n, often, least)
        if grams.isEmpty():
            break
        g = grams.join(known.select(F.col("h").alias("sfx"), F.col("lp").alias("parent")), "sfx").join(known.select(F.col("h").alias("ctx"), F.col("c").alias("all")), "ctx")
        ratio = F.log(F.col("c") / F.col("all")) - F.col("parent") * F.lit(float(np.log(10)))
        g = g.withColumn("kept", F.col("c") * F.abs(ratio) >= divergence).withColumn("p", (F.col("c") - discount) / F.col("all"))
        g = stored(g, "tested")
        left = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-12))
        rest = g.where("kept").groupBy("ctx").agg(F.log10(left(F.col("p")) / left(F.pow(F.lit(10.0), "parent"))).alias("rest"), F.max("all").alias("n"))
        rest = stored(rest, "states")
        g = g.join(rest.drop("n"), "ctx", "left")
        found.append((rest.select(F.col("ctx").alias("h"), F.col("rest").alias("v"), F.col("n").alias("c")), g.where("kept").select("h", (F.log10("p") - F.col("parent") - F.col("rest")).alias("v"), "c")))
        lp = F.when(F.col("kept"), F.log10("p")).otherwise(F.col("parent") + F.coalesce("rest", F.lit(0.0)))
        known = stored(g.select("h", "c", lp.alias("lp")), "sequences")
    none = words.select("h", F.lit(0.0).alias("v"), "c").where("1 = 0")
    return tuple(reduce(DataFrame.unionByName, side, none) for side in (zip(*found, strict=True) if found else ((), ())))


def most_frequent(factors: DataFrame, most: int) -> float:
    """The least count from which on there are at most `most` factors, found by a histogram of the counts' logarithms."""
    bins = {r["b"]: r["n"] for r in factors.groupBy(F.ceil(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n")).collect()}
    held, at = 0, float("inf")
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if held > most:
            break
        at = 2.0 ** ((b - 1) / 8) * (1 + 1e-9)
    return at


class Held:
    """The broadcast factors, sorted by hash, and the bitmap of all factors."""

    def __init__(self, rows: pa.Table, every: Bitmap, unknown: float):
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.h, self.every, self.unknown = h[order], every, unknown
        self.v, self.root, self.word = (rows.column(c).to_numpy()[order] for c in ("v", "root", "word"))

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


#: A sequence to be joined: its hash, and how often it is there; less than zero for a single word.
TAIL = pa.struct([("h", pa.int64()), ("n", pa.int32())])


def summed(model: Held, n: int, tokens: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """known, base, score of n texts from the broadcast factors, and (doc, h, one) of the sequences to be joined."""
    known, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
    tails = []
    for k, h in enumerate(sequences(tokens, depth + 1), 1):
        d, maybe = doc[: len(h)], model.every.has(h)
        if k == 1:
            # What can't be a word of the training texts is known to be new at once.
            new = np.bincount(d[~maybe], minlength=n) * model.unknown
            base += new
            score += new
        else:
            maybe &= d == doc[k - 1 :]
        h, d = h[maybe], d[maybe]
        at = model.find(h)
        hit = at >= 0
        tails.append((d[~hit], h[~hit], np.full(int((~hit).sum()), k == 1)))
        at, d = at[hit], d[hit]
        score += np.bincount(d, weights=model.v[at], minlength=n)
        if k == 1:
            known += np.bincount(d, weights=model.word[at], minlength=n)
            base += np.bincount(d, weights=model.root[at], minlength=n)
    return known, base, score, *(np.concatenate(x) for x in zip(*tails, strict=True))


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least: int = 16, divergence: float = 12.0, discount: float = 0.5, most_held: int = 1_000_000) -> DataFrame:
    """(id, learnt, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; the model learns from the rows where `learns` holds."""
    with arrow_rows(docs.sparkSession, 1_500):
        return scored(docs, learns, id_col, text_col, depth, least, divergence, discount, most_held)


def scored(docs: DataFrame, learns: Column, id_col: str, text_col: str, depth: int, least: int, divergence: float, discount: float, most_held: int) -> DataFrame:
    """All that `score` does; what meets Python is stored before it ends."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learns, F.lit(False)).alias("learnt"), F.monotonically_increasing_id().alias("row"), tokenised(F.col(text_col)).alias("seq"))
    rows = stored(rows, "tokens")
    train = rows.where("learnt").select("seq")
    words = count_sequences(train, 1, None)
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    unknown = float(-np.log10(total + distinct + 1.0))
    words = words.withColumn("lp", F.log10(F.col("c") + 1) + F.lit(unknown))
    roots = words.select("h", F.col("lp").alias("v"), "c", F.col("lp").alias("root"), F.lit(True).alias("word"))
    contexts, symbols = states(train, words, total, depth, least, divergence, discount)
    tree = contexts.unionByName(symbols).withColumn("root", F.lit(0.0)).withColumn("word", F.lit(False))
    factors = roots.unionByName(tree).groupBy("h").agg(F.sum("v").alias("v"), F.max("c").alias("c"), F.sum("root").alias("root"), F.bool_or("word").alias("word"))
    factors = stored(factors, "factors")
    at = most_frequent(factors, most_held)
    others = factors.where(F.col("c") < at).select("h", "v", "root", "word")
    model = spark.sparkContext.broadcast(Held(factors.where(F.col("c") >= at).toArrow(), Bitmap.of(factors.select("h")), unknown))
    kind = StructType([rows.schema["id"], *StructType.fromDDL("learnt boolean, row long, n_tokens long, n_known long, base double, score double, tail array<struct<h:long,n:int>>")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for n, tokens, doc in pieces(batch.column(3)):
                known, base, value, d, h, one = summed(model.value, n, tokens, doc, depth)
                order = np.lexsort((h, d))
                d, h, one = d[order], h[order], one[order]
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))) if len(d) else np.zeros(0, dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(np.bincount(d[first], minlength=n))))
                cells = (h[first].view(np.int64), np.diff(np.append(first, len(d))) * np.where(one[first], -1, 1))
                items = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(cells, TAIL, strict=True)], fields=list(TAIL))
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                given = [batch.column(k).slice(a, n) for k in range(3)]
                made = [pa.array(np.bincount(doc, minlength=n)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)]
                yield pa.RecordBatch.from_arrays([*given, *made, tail], kind.names)
                a += n

    heads = stored(rows.select("id", "learnt", "row", "seq").mapInArrow(read, kind), "scores")
    model.destroy()
    tail = heads.select("row", F.explode("tail").alias("t")).select("row", "t.h", (F.col("t.n") < 0).alias("one"), F.abs("t.n").alias("n"))
    new = F.when(F.col("one"), F.lit(unknown)).otherwise(F.lit(0.0))
    met = tail.join(others, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.coalesce("v", new)).alias("tail_score"),
        F.sum(F.when(F.col("one"), F.col("n") * F.coalesce("root", new)).otherwise(F.lit(0.0))).alias("tail_base"),
        F.sum(F.when(F.col("one") & F.col("word"), F.col("n")).otherwise(0)).alias("tail_known"),
    )
    out = heads.drop("tail").join(met, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("id", "learnt", "n_tokens", (F.col("n_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("score") + zero("tail_score")).alias("score"))
