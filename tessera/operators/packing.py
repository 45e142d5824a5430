"""Packing what a question may read under a budget of tokens: coverage of its parts first, in whole groups, at exact marginal cost.

A question has a bounded list of candidates (one row each, in `ranked`), and short lists of the parts' anchors, named sources, pins and groups. A candidate
costs its own characters, a separator behind another one, and the entries of shared tables (documents, sources, passages) that nothing chosen
before has brought; four characters are a token, rounded up. Candidates come with the whole of their group, and with the groups of those; a unit that
doesn't fit, or has a member that is no candidate, is refused, and its candidate isn't tried again. The order of the tries:

1. pins, as far as they and what comes with them take no more than half the budget by themselves;
2. for each part without a chosen anchor its anchors in turn, those with a source not yet covered first, until one fits;
3. for each named source of a part, if none of its anchors there is chosen, those anchors in turn;
4. the other anchors, one of each part in turn, again sources not yet covered first;
5. all candidates by rank.

A question without candidates has no row. Null lists are empty. What names no candidate is refused as `no_candidate`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHOICE = T.StructType([
    T.StructField("chosen", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("step", T.StringType())]))),
    T.StructField("refused", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("why", T.StringType())]))),
    T.StructField("tokens", T.LongType()),
])
CHOICE_ARROW = pa.struct([
    ("chosen", pa.list_(pa.struct([("id", pa.int64()), ("step", pa.string())]))),
    ("refused", pa.list_(pa.struct([("id", pa.int64()), ("why", pa.string())]))),
    ("tokens", pa.int64()),
])


def tokens(chars: int) -> int:
    return (chars + 3) // 4


class Choice:
    """What has been chosen for one question, what it costs, and why the rest wasn't."""

    def __init__(self, candidates: list[dict], groups: list[dict], budget: int, base: int):
        self.of = {c["id"]: c for c in candidates}
        self.needs: dict[int, set[int]] = {}
        for g in groups:
            self.needs.setdefault(g["id"], set()).update(g["members"] or ())
        self.budget, self.chars = budget, base
        self.steps: dict[int, str] = {}
        self.why: dict[int, str] = {}
        self.paid: set[tuple] = set()

    def unit(self, ident: int) -> set[int]:
        """The candidate with all that its group and theirs need, less what is chosen."""
        out, edge = set(), {ident} - self.steps.keys()
        while edge:
            out |= edge
            edge = {m for e in edge for m in self.needs.get(e, ())} - out - self.steps.keys()
        return out

    def price(self, unit: set[int]) -> tuple[int, set[tuple]]:
        """Characters that the unit adds, and the entries that it brings."""
        new = {(e["table"], e["item"], e["chars"]) for m in unit for e in self.of[m]["entries"] or ()} - self.paid
        own = sum(self.of[m]["chars"] for m in unit)
        tables = {t for t, *_ in self.paid}
        commas = len(unit) - (0 if self.steps else 1) + len(new) - len({t for t, *_ in new} - tables)
        return own + sum(c for *_, c in new) + commas, new

    def offer(self, ident: int, step: str) -> bool:
        if ident in self.steps:
            return True
        if ident in self.why:
            return False
        unit = self.unit(ident)
        if not unit <= self.of.keys():
            self.why[ident] = "group_conflict" if ident in self.of else "no_candidate"
            return False
        more, entries = self.price(unit)
        if tokens(self.chars + more) > self.budget:
            self.why[ident] = "over_budget"
            return False
        self.chars += more
        self.paid |= entries
        for m in sorted(unit, key=lambda m: (self.of[m]["rank"], m)):
            self.steps[m] = step
        return True

    def pin(self, pins: list[int]) -> None:
        spent, held = 0, set()
        for p in pins:
            new = self.unit(p) - held
            alone = sum(max(1, tokens(self.of[m]["chars"] + sum(e["chars"] for e in self.of[m]["entries"] or ()))) for m in new if m in self.of)
            if spent + alone > self.budget // 2:
                continue
            if self.offer(p, "pin"):
                spent, held = spent + alone, held | new

    def cover(self, anchors: dict[int, list[dict]], named: list[dict]) -> None:
        at = {p: {a["id"]: set(a["sources"] or ()) for a in reversed(row)} for p, row in anchors.items()}
        order = {p: list(dict.fromkeys(a["id"] for a in row)) for p, row in anchors.items()}
        parts = sorted(order)

        def fresh_first(part: int, ids: list[int]) -> list[int]:
            covered = {s for p in parts for i, ss in at[p].items() if i in self.steps for s in ss}
            return sorted(ids, key=lambda i: at[part][i] <= covered)

        for p in parts:
            if not any(i in self.steps for i in order[p]):
                any(self.offer(i, "part") for i in fresh_first(p, order[p]))
        for n in sorted(named, key=lambda n: (n["part"], n["place"])):
            mine = [i for i in order.get(n["part"], ()) if n["source"] in at[n["part"]][i]]
            if not any(i in self.steps for i in mine):
                any(self.offer(i, "source") for i in mine)
        left = {p: [i for i in order[p] if i not in self.steps and i not in self.why] for p in parts}
        while any(left.values()):
            for p in parts:
                if left[p]:
                    first = fresh_first(p, left[p])[0]
                    left[p].remove(first)
                    self.offer(first, "anchor")


def choose(candidates, groups, anchors, named, pins, budget: int, base: int) -> dict:
    c = Choice(candidates, groups, budget, base)
    c.pin([p["id"] for p in sorted(pins, key=lambda p: p["place"])])
    parts: dict[int, list[dict]] = {}
    for a in sorted(anchors, key=lambda a: (a["part"], a["place"])):
        parts.setdefault(a["part"], []).append(a)
    c.cover(parts, named)
    for x in sorted(candidates, key=lambda x: (x["rank"], x["id"])):
        c.offer(x["id"], "fill")
    refused = {k: w for k, w in c.why.items() if k not in c.steps}
    return {"chosen": [{"id": k, "step": s} for k, s in c.steps.items()], "refused": [{"id": k, "why": w} for k, w in sorted(refused.items())], "tokens": max(1, tokens(c.chars))}


def listed(rows: DataFrame, name: str) -> DataFrame:
    """(query_id, name): the rows of a question as one list."""
    return rows.groupBy("query_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "query_id"])).alias(name))


def pack(ranked: DataFrame, groups: DataFrame, anchors: DataFrame, named: DataFrame, pins: DataFrame, budget: int, base: int = 0) -> DataFrame:
    """(query_id, chosen, refused, tokens) for each question of ranked (query_id, id, rank, chars, entries array<struct<table, item, chars>>).

    groups (query_id, id, members), anchors (query_id, part, place, id, sources), named (query_id, part, place, source), pins (query_id, place, id). `base`:
    the characters that are there before. Lists of a question are short: as many candidates as its ranking has places.
    """
    one = listed(ranked, "candidates")
    for rows, name in ((groups, "groups"), (anchors, "anchors"), (named, "named"), (pins, "pins")):
        one = one.join(listed(rows, name), "query_id", "left")

    def each(candidates: pa.Array, groups: pa.Array, anchors: pa.Array, named: pa.Array, pins: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (candidates, groups, anchors, named, pins)), strict=True)
        return pa.array([choose(*(x or [] for x in row), budget, base) for row in rows], CHOICE_ARROW)

    choice = F.arrow_udf(each, CHOICE)("candidates", "groups", "anchors", "named", "pins")
    return one.select("query_id", choice.alias("c")).select("query_id", "c.*")


def reading_order(choice: DataFrame) -> DataFrame:
    """(query_id, id, step, place) of what was chosen."""
    return choice.select("query_id", F.posexplode("chosen").alias("place", "o")).select("query_id", F.col("o.id").alias("id"), F.col("o.step").alias("step"), F.col("place").cast("long").alias("place"))


def audit(choice: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, id, rank, selected, reason): every candidate of ranked, with the step that chose it or why it was left out."""
    into = choice.select("query_id", F.explode("chosen").alias("o")).select("query_id", F.col("o.id").alias("id"), F.lit(True).alias("selected"), F.col("o.step").alias("reason"))
    left = choice.select("query_id", F.explode("refused").alias("o")).select("query_id", F.col("o.id").alias("id"), F.lit(False).alias("selected"), F.col("o.why").alias("reason"))
    return ranked.select("query_id", "id", "rank").join(into.unionByName(left), ["query_id", "id"], "left")
