"""Audit of how filters interact, by relations of failing ids.

Each filter has one stored table of the rows that fail it. The documents are split filter by filter: a left-semi join with a filter's table gives
those that the filter would remove, a left-anti join those that pass, and what has come so far is part of the row's name. After the last
filter every document is in one class, the set of filters that it fails. A prefix of filters leaves the classes that meet none of them; its
next filter removes what fails it among these, and is redundant where an earlier one has removed the rest. So every order of the filters is
read off the class counts of a part, and no order runs over the documents again.

Filters: A under 200 words; B less than half of the words distinct; C more than 2 % of the code points in A-Z; D any of #$%&*|; E the text of a
smaller id. Null text is empty, and fails A. A null id is smaller than none and has none smaller; rows with one id and text don't
fail E by one another. A null part is the empty part. A document has a label if any row of labels with its id has it. Empty documents: empty result.
Columns other than id, text and part are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, dealt_join, stored

LETTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that a text fails by itself."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * upper > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows (row, id, th) whose text a smaller id has."""
    first = rows.groupBy("th").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    return dealt_join(rows.select("row", "id", "th"), first, ["th"], "n", ["row"]).where("id > least").select("row")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, 0 or 1."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"__{c}")
    per = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(flag("quality"), flag("toxic"))
    out = rows.join(per, rows["id"] == per["__id"], "left")
    return out.select(*rows.columns, F.coalesce("__quality", F.lit(0)).alias("good"), F.coalesce("__toxic", F.lit(0)).alias("toxic"))


def classes(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """rows with `fails`, a bit for each filter of failing (in order) whose table has the row."""
    rows = rows.withColumn("fails", F.lit(0))
    for k, ids in enumerate(failing.values()):
        held = rows.join(ids, "row", "left_semi").withColumn("fails", F.col("fails") + (1 << k))
        rows = cut(held.unionByName(rows.join(ids, "row", "left_anti")))
    return rows


def steps(n: int = len(LETTERS)) -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(filter, bits of the filters before it, the orders in which they come before it and at which step) for every such pair."""
    out: dict[tuple[int, int], list] = {}
    for order in permutations(range(n)):
        for step, f in enumerate(order, 1):
            out.setdefault((f, sum(1 << g for g in order[: step - 1])), []).append(("".join(LETTERS[g] for g in order), step))
    return [(f, before, orders) for (f, before), orders in out.items()]


def audit(rows: DataFrame) -> DataFrame:
    """Counts for each part, order and step from rows (part, fails, good, toxic)."""
    n, every = len(LETTERS), range(1 << len(LETTERS))
    per = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    held = lambda c: F.array(*[F.sum(F.when(F.col("fails") == k, F.col(c)).otherwise(0)) for k in every]).alias(c)
    per = per.groupBy("part").agg(held("n"), held("good"), held("toxic"))
    pairs = F.array(*[F.struct(F.lit(1 << f).alias("bit"), F.lit(b).alias("before"), F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in orders]).alias("orders")) for f, b, orders in steps()])
    per = per.withColumn("p", F.explode(pairs)).select("*", "p.*").drop("p")

    def total(c: str, *conds) -> Column:
        at = F.sequence(F.lit(0), F.lit(len(every) - 1))
        return F.aggregate(F.filter(at, lambda k: all_of([f(k) for f in conds])), F.lit(0).cast("long"), lambda acc, k: acc + F.get(F.col(c), k))

    all_of = lambda conds: conds[0] if len(conds) == 1 else conds[0] & all_of(conds[1:])
    fails = lambda k: k.bitwiseAND(F.col("bit")) != 0
    earlier = lambda k: k.bitwiseAND(F.col("before")) != 0
    here = (fails, lambda k: ~earlier(k))
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    per = per.select(
        "part",
        "bit",
        "orders",
        total("n", lambda k: ~earlier(k) & ~fails(k)).alias("kept"),
        total("n", *here).alias("removed"),
        total("n", fails, earlier).alias("redundant"),
        total("n", lambda k: k == F.col("bit")).alias("unique_fails"),
        total("good", *here).alias("good_lost"),
        total("toxic", *here).alias("toxic_lost"),
        weight.alias("w"),
    )
    shapley = per.groupBy("part", "bit").agg(F.sum(F.col("w") * F.col("removed")).alias("shapley"))
    per = per.join(shapley, ["part", "bit"]).withColumn("at", F.explode("orders"))
    return per.select("part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step. See the module's text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2("text", 256)).alias("th"), *[c.alias(k) for k, c in text_filters(F.col("text")).items()]), "documents")
    failing = {k: stored(rows.where(k).select("row"), f"fails-{k}") for k in "ABCD"} | {"E": stored(later_copies(rows), "fails-E")}
    return audit(classes(labelled(rows.select("row", "id", "part"), labels), failing))
