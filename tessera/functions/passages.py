"""Text cut into passages, sentences and similar neighbours, as Columns. Offsets are code points; the ranges of a text cover it without gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hashes, sliced

# What ends a sentence or a paragraph, and the sizes of passages.
STOP = r"[.!?。！？][\"”’)\]]*(?:\s+|$)"
ENDS = STOP + r"|\n[ \t]*\n"
BETWEEN = r"(?<=[。！？])|(?<=[.!?])\s+(?=[A-Z㐀-鿿])"
GOAL, MOST = 2400, 6000
NEAR, FAR, UNIT, CHUNK = 1200, 3600, 400, 1200

RANGES = "array<struct<start:int,end:int,hard:boolean>>"


def match_ends(text: Column, pattern: str) -> Column:
    """array<int>: the ends of a pattern's matches, from the lengths of the pieces between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(steps, start, add, lambda acc: acc["ends"])


def cut(text: Column, ends: Column, heads: Column, goal: int = GOAL, most: int = MOST) -> Column:
    """Ranges that end at the first of `ends` that is `goal` characters on, at each of `heads`, and hard at `most` where neither is near.

    One pass over the sorted ends: what is too long since the last cut is cut hard, then the end is taken or left.
    """
    n = F.length(text)
    stops = F.transform(ends, lambda e: F.struct(e.alias("e"), F.lit(False).alias("must")))
    must = F.transform(F.concat(heads, F.array(n)), lambda h: F.struct(h.cast("int").alias("e"), F.lit(True).alias("must")))
    stops = F.array_sort(F.filter(F.concat(stops, must), lambda x: (x["e"] > 0) & (x["e"] <= n)))

    def step(acc: Column, x: Column) -> Column:
        hard = F.greatest(F.ceil((x["e"] - acc["at"]) / F.lit(most)).cast("int") - 1, F.lit(0))
        pieces = F.when(hard > 0, F.transform(F.sequence(F.lit(1), F.greatest(hard, F.lit(1))), lambda k: F.struct((acc["at"] + (k - 1) * most).alias("start"), (acc["at"] + k * most).alias("end"), F.lit(True).alias("hard"))))
        at = acc["at"] + hard * most
        take = (x["e"] > at) & (x["must"] | (x["e"] - at >= goal))
        last = F.when(take, F.array(F.struct(at.alias("start"), x["e"].alias("end"), F.lit(False).alias("hard"))))
        none = F.array().cast(RANGES)
        out = F.concat(acc["out"], F.coalesce(pieces.cast(RANGES), none), F.coalesce(last.cast(RANGES), none))
        return F.struct(F.when(take, x["e"]).otherwise(at).cast("int").alias("at"), out.alias("out"))

    return F.coalesce(F.aggregate(stops, F.struct(F.lit(0).alias("at"), F.array().cast(RANGES).alias("out")), step, lambda acc: acc["out"]), F.array().cast(RANGES))


def passage_ranges(text: Column, heads: Column | None = None) -> Column:
    """Passages, none of them across one of the offsets `heads`."""
    none = F.array().cast("array<int>")
    return cut(text, match_ends(text, ENDS), F.coalesce(heads, none) if heads is not None else none)


def joined_while_short(parts: Column, most: int) -> Column:
    """Neighbouring strings joined by a space while they fit into `most` characters; a longer one stays whole."""

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        both = F.concat_ws(" ", last, x)
        return F.when((F.size(out) > 0) & (F.length(both) <= most), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def sentence_list(text: Column, most: int = CHUNK) -> Column:
    parts = F.transform(F.split(text, BETWEEN, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return joined_while_short(F.filter(parts, lambda p: p != ""), most)


def paragraph_ranges(text: Column, most: int = CHUNK) -> Column:
    """array<struct<start, end>>: neighbouring lines joined while they fit; one without letters is left out and parts its neighbours."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, line: Column) -> Column:
        s, e = acc["at"], acc["at"] + F.length(line)
        last = F.try_element_at(acc["out"], F.lit(-1))
        fits = acc["joins"] & (e - last["start"] <= most)
        start = F.when(F.coalesce(fits, F.lit(False)), last["start"]).otherwise(s)
        kept = F.when(F.coalesce(fits, F.lit(False)), F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"])
        blank, wordless = ~line.rlike(r"\S"), ~line.rlike(r"\p{L}")
        out = F.when(blank | wordless, acc["out"]).otherwise(F.concat(kept, F.array(F.struct(start.alias("start"), e.alias("end"))).cast(kind)))
        joins = F.when(blank, acc["joins"]).otherwise(~wordless)
        return F.struct((e + 1).alias("at"), joins.alias("joins"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("joins"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.split(text, "\n"), first, step, lambda acc: acc["out"])


def neighbour_similarity(words: Column, dim: int = 384) -> Column:
    """array<double>: cosine of each unit's and the following one's signed hash counts of words, of array<array<string>> words; 0 for the last and for none."""

    def alike(places: list[np.ndarray]) -> np.ndarray:
        counts = np.stack([np.bincount(p >> 1, 1 - 2 * (p & 1), dim) for p in places])
        size = np.sqrt((counts * counts).sum(axis=1))
        both, dot = size[:-1] * size[1:], (counts[:-1] * counts[1:]).sum(axis=1)
        return np.divide(dot, both, out=np.zeros(len(dot)), where=both > 0)

    def each(texts: pa.Array) -> pa.Array:
        out, hashed = [], hashes(dim)
        for units in texts.to_pylist():
            if units is None:
                out.append(None)
                continue
            places = [np.fromiter(map(hashed, u), dtype=np.int64, count=len(u)) for u in units]
            # Some units at a time; each part begins with the last unit of the one before.
            parts = [alike(places[k : k + 257]) for k in range(0, len(places) - 1, 256)]
            out.append(np.concatenate([*parts, np.zeros(min(1, len(places)))]))
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(sliced(each), "array<double>")(words)


def similar_ranges(docs: DataFrame) -> DataFrame:
    """(id, start, end, text) of docs (id, text): units of sentences, joined up to the least similar neighbours at a fitting distance. A text's units stay in its row."""
    docs = docs.select("id", "text", cut(F.col("text"), match_ends(F.col("text"), STOP), F.array().cast("array<int>"), UNIT).alias("r"))
    own = lambda r: F.lower(F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]))
    words = F.transform("r", lambda r: F.regexp_extract_all(own(r), F.lit(r"(?U)\w+"), F.lit(0)))
    docs = docs.select("id", "text", "r", neighbour_similarity(words).alias("alike"))
    u = F.zip_with("r", "alike", lambda r, a: F.struct(r["end"].alias("end"), F.round(a, 12).alias("alike")))
    per = docs.select("id", "text", u.alias("u"))
    n = F.try_element_at("u", F.lit(-1))["end"]

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        fitting = F.filter("u", lambda x: (x["end"] - at).between(NEAR, FAR) & (x["end"] < n))
        least = F.array_min(F.transform(fitting, lambda x: F.struct(x["alike"].alias("a"), F.abs(x["end"] - at - GOAL).alias("d"), x["end"].alias("e"))))["e"]
        longest = F.array_max(F.transform(F.filter("u", lambda x: (x["end"] > at) & (x["end"] - at <= MOST)), lambda x: x["end"]))
        following = F.array_min(F.transform(F.filter("u", lambda x: x["end"] > at), lambda x: x["end"]))
        end = F.coalesce(least, longest, following)
        one = F.array(F.struct(at.alias("start"), end.alias("end"))).cast("array<struct<start:int,end:int>>")
        return F.when(at >= n, acc).otherwise(F.struct(end.cast("int").alias("at"), F.concat(acc["out"], one).alias("out")))

    # A range has NEAR characters at least, but for the last one; so many turns suffice.
    turns = F.sequence(F.lit(0), F.ceil(n / NEAR).cast("int"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return per.select("id", "text", F.explode(F.aggregate(turns, first, step, lambda acc: acc["out"])).alias("r")).select("id", "r.*", "text")
