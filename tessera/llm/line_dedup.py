"""Line dedup by winnowing.

Two kinds of lines are hashed. A physical line of `min_line_words` words or more is a fingerprint itself. And as passages begin
and end inside physical lines, soft lines are winnowed: runs of `line_words` words, begun at every word. Of every
`window` consecutive soft-line hashes the least is a fingerprint, so any run of line_words + window - 1 words that two places
share leaves a fingerprint in both. Fingerprints are joined with the first place that has them (by id, nulls last, then text
hash, then position), neighbouring ones of one alignment become runs, and runs are extended word by word both ways. A run of
`min_words` words or more is deleted, and of a shorter one the whole physical lines in it, where they have `min_line_words` words
or more together; the first place stays.

The first place of a fingerprint may share less around it than later places do with one another. So the windows around joined
soft fingerprints that no long run holds whole are joined by a hash of all their words, and deleted at every place but the first.

Null text stays null; an empty one stays empty. Rows with equal id and text are one document, and each gets its result: the
first of them does not delete the others. Self-repeating texts keep their first round. Other columns stay as they are, whatever
their names; one called as the column for the count of removed words is replaced. Words are separated by ASCII white space and
compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, dealt_join, likely, stored
from tessera.llm.words import Powers, Words, batches_of, mixed

NO_ID = (1 << 63) - 1


def runs_of(h: np.ndarray, s: np.ndarray, e: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of the words from s to e, for arrays of both, from the words' hashes."""
    up, down = powers.of(len(h) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * down[: len(h)], dtype=np.uint64)))
    return mixed((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64))


#: A window's least is found by a hash's highest bits, and by the place among equal ones; both go into one number.
PLACE = 28


def soft_lines(words: Words, line: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the soft lines of k words that are minima of a window of w, in the texts' words on end; line has the hashes of all k-word runs.

    The least of a window is that of a block's end or of the next one's beginning: running minima over blocks of w from both
    sides. A text with fewer lines than a window is one window. A repeating text has the same minimum over and over: of such a
    chain one in every half window is kept, so a window still holds one.
    """
    count = np.diff(words.at)
    text = np.repeat(np.arange(len(count)), count)
    last = words.at[1:][text] - k  # the last soft line of each word's text
    key = line >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(line), dtype=np.uint64)
    most = np.iinfo(np.uint64).max
    blocks = np.concatenate((key, np.full(-len(key) % w, most))).reshape(-1, w)
    n = max(0, len(key) - w + 1)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 :][:n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(ahead, behind)[np.arange(n) + w - 1 <= last[:n]]
    short = np.flatnonzero((count >= k) & (count < k + w - 1))
    ends = np.column_stack((words.at[short], words.at[short] + count[short] - k + 1)).ravel()
    alone = np.minimum.reduceat(np.append(key, most), ends)[::2] if len(short) else key[:0]
    at = np.unique(np.concatenate((least, alone)) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    follows = np.concatenate(([False], (np.diff(at) < w) & (line[at[1:]] == line[at[:-1]]) & (text[at[1:]] == text[at[:-1]])))[: len(at)]
    if follows.any():
        chain = np.maximum.accumulate(np.where(follows, -1, at))
        stretch = (at - chain) // max(1, w // 2)
        at = at[~follows | np.concatenate(([True], np.diff(stretch) > 0))]
    return at


def fingerprints(words: Words, k: int, w: int, least: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, h, p, n) of all texts' fingerprints by text: physical lines of `least` words or more with their length n, and soft ones with 0."""
    starts = words.line_starts()
    s = np.concatenate([x[:-1] + a for x, a in zip(starts, words.at, strict=False)])
    e = np.concatenate([x[1:] + a for x, a in zip(starts, words.at, strict=False)])
    s, e = s[e - s >= least], e[e - s >= least]
    hard = ~runs_of(words.h, s, e, powers).view(np.int64)
    every = np.arange(max(0, len(words.h) - k + 1))
    line = runs_of(words.h, every, every + k, powers)
    at = soft_lines(words, line, k, w) if len(line) else every
    place = np.concatenate((at, s))
    text = np.searchsorted(words.at, place, side="right") - 1
    order = np.argsort(text, kind="stable")
    h, n = np.concatenate((line[at].view(np.int64), hard)), np.concatenate((np.zeros(len(at), dtype=np.int64), e - s))
    return text[order], h[order], (place - words.at[text])[order].astype(np.int32), n[order].astype(np.int32)


def parted(texts: list[bytes | None], powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the words and the starts of the lines of each text."""
    for _, part in batches_of(texts):
        words = Words(part, powers)
        for starts, a, b in zip(words.line_starts(), words.at[:-1], words.at[1:], strict=True):
            yield words.h[a:b], starts


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds d and th, which name a document: its id and a hash of its text."""
    i = F.col(id_col).cast("long")
    return docs.withColumn("__d", F.coalesce(i, F.lit(NO_ID))).withColumn("__th", F.xxhash64(F.col(text_col), i.isNull()))


def repeated_runs(docs: DataFrame, line_words: int, window: int, min_line_words: int) -> DataFrame:
    """(d, th, s, e, d0, th0, delta, soft): words s to e of (d, th) are those of the first place (d0, th0), delta words before."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sizes, cols = [np.zeros(1, dtype=np.int64)], [[np.zeros(0, dtype=t)] for t in (np.int64, np.int32, np.int32)]
            for _, part in batches_of(batch.column(2).cast(pa.binary()).to_pylist()):
                text, *found = fingerprints(Words(part, powers), line_words, window, min_line_words, powers)
                sizes.append(np.bincount(text, minlength=len(part)))
                for c, x in zip(cols, found, strict=True):
                    c.append(x)
            ends = np.cumsum(np.concatenate(sizes))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(c))) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["d", "th", "h", "p", "n"])

    # n is the length of a physical line, and 0 for a soft one.
    prints = stored(docs.select("__d", "__th", "__text").mapInArrow(pick, "d long, th long, h array<long>, p array<int>, n array<int>"), "fingerprints")
    each = prints.select("d", "th", F.explode(F.arrays_zip("h", "p", "n")).alias("x")).select("d", "th", "x.h", "x.p", "x.n")
    first = each.groupBy("h").agg(F.min(F.struct("d", "th", "p")).alias("f"), F.count("*").alias("uses")).where("uses > 1").select("h", "uses", F.col("f.d").alias("d0"), F.col("f.th").alias("th0"), F.col("f.p").alias("p0"))
    met = dealt_join(each, first, ["h"], "uses", ["d", "th", "p"]).where("NOT (d = d0 AND th = th0 AND p = p0)")
    met = met.select("d", "th", "p", (F.col("p") + F.when(F.col("n") > 0, F.col("n")).otherwise(line_words)).alias("e"), (F.col("n") == 0).alias("soft"), "d0", "th0", (F.col("p") - F.col("p0")).alias("delta")).distinct()
    line = Window.partitionBy("d", "th", "d0", "th0", "delta").orderBy("p", "e")
    before = F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("new", F.coalesce((F.col("p") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy("d", "th", "d0", "th0", "delta", "run").agg(F.min("p").alias("s"), F.max("e").alias("e"), F.bool_or("soft").alias("soft")).drop("run")


def surroundings(docs: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """places (d0, th0, s0, e0) with the hashes of up to `reach` words before (nearest first) and after."""
    wanted = cut(places.groupBy("d0", "th0").agg(F.collect_set(F.struct("s0", "e0")).alias("ranges")))
    near = likely(docs, wanted.select(F.col("d0").alias("d"), F.col("th0").alias("th"))).where("__hit")
    near = near.select("__d", "__th", "__text").join(wanted, (F.col("__d") == F.col("d0")) & (F.col("__th") == F.col("th0"))).groupBy("d0", "th0").agg(F.first("__text").alias("t"), F.first("ranges").alias("ranges"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            found = parted(batch.column(2).cast(pa.binary()).to_pylist(), powers)
            for d, th, (h, _), ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, batch.column(3).to_pylist(), strict=True):
                for r in ranges:
                    s, e = r["s0"], r["e0"]
                    rows.append((d, th, s, e, h[max(0, s - reach) : s][::-1].tobytes(), h[e : e + reach].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["d0", "th0", "s0", "e0", "pre", "post"])

    return near.mapInArrow(look, "d0 long, th0 long, s0 int, e0 int, pre binary, post binary")


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extended(h: np.ndarray, starts: np.ndarray, edits: list[dict], min_words: int, min_line_words: int) -> list[tuple[int, int]]:
    """What is to go of the runs after extension word by word both ways: long ones, and the whole lines of others."""
    out = []
    for x in edits:
        pre, post = (np.frombuffer(x[c], dtype=np.uint64) for c in ("pre", "post"))
        s, e = x["s"] - alike(h[: x["s"]][::-1], pre), x["e"] + alike(h[x["e"] :], post)
        if e - s < min_words:
            s, e = int(starts[np.searchsorted(starts, s)]), int(starts[np.searchsorted(starts, e, side="right") - 1])
        if e - s >= min(min_words, min_line_words):
            out.append((s, e))
    return out


def open_windows(docs: DataFrame, edits: DataFrame, line_words: int, n: int, min_words: int, min_line_words: int) -> DataFrame:
    """(d, th, gone, q, w) for each document with edits: what is to go, and starts and hashes of the windows they leave open.

    A window of n words that stands at two places has a fingerprint in both, which the first place of that fingerprint need not
    surround alike. So windows around a joined fingerprint, none of the long runs over them whole, are to be compared themselves.
    """
    near = likely(docs, edits.select("d", "th")).where("__hit").select("__d", "__th", "__text").join(edits, (F.col("__d") == F.col("d")) & (F.col("__th") == F.col("th")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            cols: list[list] = [[], [], []]
            for (h, starts), found in zip(parted(batch.column(2).cast(pa.binary()).to_pylist(), powers), batch.column(3).to_pylist(), strict=True):
                gone, wanted = extended(h, starts, found, min_words, min_line_words), np.zeros(max(0, len(h) - n + 1), dtype=bool)
                for x in filter(lambda x: x["soft"], found):
                    wanted[max(0, x["s"] + line_words - n) : max(0, x["e"] - line_words + 1)] = True
                for s, e in gone:
                    wanted[s : max(s, e - n + 1)] = False
                q = np.flatnonzero(wanted)
                w = runs_of(h, q, q + n, powers).view(np.int64) if len(q) else q
                for c, v in zip(cols, ([{"s": s, "e": e} for s, e in gone], q.astype(np.int32), w), strict=True):
                    c.append(v)
            kinds = (pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]], ["d", "th", "gone", "q", "w"])

    seen = near.select("d", "th", "__text", "edits").mapInArrow(look, "d long, th long, gone array<struct<s:int,e:int>>, q array<int>, w array<long>")
    return stored(seen, "windows")


def later_windows(seen: DataFrame) -> DataFrame:
    """(d, th, later): starts of the open windows that an earlier place has too."""
    each = seen.select("d", "th", F.explode(F.arrays_zip("q", "w")).alias("x")).select("d", "th", F.col("x.q").alias("q"), F.col("x.w").alias("w"))
    first = each.groupBy("w").agg(F.min(F.struct("d", "th", "q")).alias("f"), F.max(F.struct("d", "th", "q")).alias("l")).where("f <> l").select("w", "f")
    return each.join(first, "w").where(F.struct("d", "th", "q") != F.col("f")).groupBy("d", "th").agg(F.collect_set("q").alias("later"))


def shorten(text: bytes, begin: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the words of the ranges, and how many those are; begin has the bytes at which its words begin."""
    gone = np.zeros(len(begin), dtype=bool)
    for s, e in ranges:
        gone[s:e] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
    if not edge:
        return text, 0
    out, last = [], 0
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[last : begin[s]])
        last = int(begin[e]) if e < len(begin) else len(text)
    kept = b"".join([*out, text[last:]])
    return (kept.rstrip() if edge[-1] == len(begin) else kept), int(gone.sum())


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = 26, window: int = 26, min_words: int = 50, min_line_words: int = 8, out: str = "__removed") -> DataFrame:
    """The columns of docs, the text without later repeated runs, and `out`: how many of its words went."""
    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    runs = cut(repeated_runs(rows, line_words, window, min_line_words).withColumn("s0", F.col("s") - F.col("delta")).withColumn("e0", F.col("e") - F.col("delta")))
    around = surroundings(rows, runs.select("d0", "th0", "s0", "e0").distinct(), line_words + window)
    edits = runs.join(around, ["d0", "th0", "s0", "e0"]).groupBy("d", "th").agg(F.collect_list(F.struct("s", "e", "pre", "post", "soft")).alias("edits"))
    n = max(line_words + window - 1, min_words)
    seen = open_windows(rows, cut(edits), line_words, n, min_words, min_line_words)
    edits = seen.select("d", "th", "gone").distinct().join(later_windows(seen), ["d", "th"], "left").where("size(gone) > 0 OR later IS NOT NULL")
    edits = cut(edits.select("d", "th", F.struct("gone", "later").alias("edits")))

    @F.arrow_udf("struct<text:string,n_removed:bigint>")
    def edit(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        powers = Powers()
        for texts, found in rows:
            texts, found, done = texts.cast(pa.binary()).to_pylist(), found.to_pylist(), []
            for first, part in batches_of(texts):
                words = Words(part, powers)
                for k, t in enumerate(part):
                    x, begin = found[first + k], words.s[words.at[k] : words.at[k + 1]] - words.begin[k]
                    kept, n_gone = shorten(t, begin, [*((g["s"], g["e"]) for g in x["gone"]), *((q, q + n) for q in x["later"] or ())]) if x else (t, 0)
                    done.append({"text": None if texts[first + k] is None else kept.decode(), "n_removed": n_gone})
            yield pa.array(done, type=pa.struct([("text", pa.string()), ("n_removed", pa.int64())]))

    rows = likely(rows, edits.select("d", "th"))
    touched = rows.where("__hit").join(edits, (F.col("__d") == F.col("d")) & (F.col("__th") == F.col("th")), "left").select("__row", edit("__text", "edits").alias("__new"))
    plain = rows.where("NOT __hit").select("__row", F.struct(F.col("__text").alias("text"), F.lit(0).cast("long").alias("n_removed")).alias("__new"))
    done = touched.unionByName(plain)
    cells = [F.col("__new.text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != out]
    return done.select(*cells, F.col("__new.n_removed").alias(out))
