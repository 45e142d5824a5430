"""Regular-expression matches with code-point offsets, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string,pre:string,post:string>"


def spans(text: Column, pattern: str, gate: Column, context: int = 24) -> Column:
    """array<struct<s, e, m, pre, post>>: leftmost non-overlapping matches of a pattern that matches no empty text.

    s and e are code points, e exclusive; pre and post are up to `context` characters around. The text's pieces between the
    matches, zipped with the matches, give the offsets as running lengths. Where `gate` is not true the array is empty and
    the pattern is not run.
    """
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, 2, 1 << 30).alias("after"))
    names = F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["m"].alias("m"), z["after"].alias("after")))

    def add(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["gap"])
        e = s + F.length(z["m"])
        one = F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"), F.right(z["gap"], F.lit(context)).alias("pre"), F.left(z["after"], F.lit(context)).alias("post"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one.cast(SPAN))).alias("out"))

    empty = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(F.filter(names, lambda z: z["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(gate, found).otherwise(empty)


def kind_spans(kind: int, found: Column) -> Column:
    """array<struct<s, k, e>>, whose natural order is by start, then kind."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def written(kinds: tuple[str, ...], found: Column) -> Column:
    """kind:start:end, comma-joined in natural order."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in kinds]), k + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def crosses(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < span["e"]) & (span["s"] < o["e"]))
