"""Operators that go row by row through a short list, against plain loops."""

import random

from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import fuzzy
from tessera.operators import packing as coverage
from tessera.plans import packing, views


def test_neighbours_follow_their_anchor_once(spark):
    rng = random.Random(4)
    rows = [(q, i, r, i - 1 if rng.random() < 0.7 else None, i + 1 if rng.random() < 0.7 else None) for q in range(4) for r, i in enumerate(rng.sample(range(30), 18), 1)]
    got = packing.expanded(spark.createDataFrame(rows, "query_id int, id long, rank long, before long, after long"), "before", "after", 10).orderBy("query_id", "place").collect()
    for q in range(4):
        out = []
        for _, i, rank, b, a in sorted((x for x in rows if x[0] == q), key=lambda x: x[2]):
            if i in [o[0] for o in out]:
                continue
            near = [n for n in (b, a) if rank <= 10 and n is not None and n not in [o[0] for o in out]]
            out += [(n, rank) for n in (i, *near)]
        assert [(r["id"], r["anchor_rank"]) for r in got if r["query_id"] == q] == out


def plain_packing(cands, groups, anchors, named, pins, budget, base):
    """The same rule on dictionaries, everything counted anew at every step."""
    info = {c["id"]: c for c in cands}
    chosen: list[tuple] = []
    tried: dict = {}

    def size(ids):
        tables: dict = {}
        for i in ids:
            for e in info[i]["entries"]:
                tables.setdefault(e["table"], {})[e["item"]] = e["chars"]
        return base + sum(info[i]["chars"] for i in ids) + max(0, len(ids) - 1) + sum(sum(t.values()) + len(t) - 1 for t in tables.values())

    def closure(i):
        seen, todo = [], [i]
        while todo:
            x = todo.pop()
            if x not in seen and x not in [c for c, _ in chosen]:
                seen.append(x)
                todo += [m for g in groups if g["id"] == x for m in g["members"]]
        return seen

    def attempt(i, step):
        if i in [c for c, _ in chosen]:
            return True
        if i in tried:
            return False
        unit = closure(i)
        if any(u not in info for u in unit):
            tried[i] = "no_candidate" if i not in info else "group_conflict"
        elif -(-size([c for c, _ in chosen] + unit) // 4) > budget:
            tried[i] = "over_budget"
        else:
            chosen.extend((u, step) for u in sorted(unit, key=lambda u: (info[u]["rank"], u)))
            return True
        return False

    spent, with_pins = 0, set()
    for p in sorted(pins, key=lambda p: p["place"]):
        new = [u for u in closure(p["id"]) if u not in with_pins]
        alone = sum(max(1, -(-(info[u]["chars"] + sum(e["chars"] for e in info[u]["entries"])) // 4)) for u in new if u in info)
        if spent + alone <= budget // 2 and attempt(p["id"], "pin"):
            spent, with_pins = spent + alone, with_pins | set(new)
    numbers = sorted({a["part"] for a in anchors})
    rows = {n: sorted((a for a in anchors if a["part"] == n), key=lambda a: a["place"]) for n in numbers}

    def fresh(n, row):
        have = {s for m in numbers for a in rows[m] if a["id"] in [c for c, _ in chosen] for s in a["sources"]}
        return [a for a in row if set(a["sources"]) - have] + [a for a in row if not set(a["sources"]) - have]

    inside = lambda row: any(a["id"] in [c for c, _ in chosen] for a in row)
    for n in numbers:
        for a in [] if inside(rows[n]) else fresh(n, rows[n]):
            if attempt(a["id"], "part"):
                break
    for x in sorted(named, key=lambda x: (x["part"], x["place"])):
        mine = [a for a in rows.get(x["part"], []) if x["source"] in a["sources"]]
        for a in [] if inside(mine) else mine:
            if attempt(a["id"], "source"):
                break
    left = {n: [a for a in rows[n] if a["id"] not in tried and a["id"] not in [c for c, _ in chosen]] for n in numbers}
    while any(left.values()):
        for n in numbers:
            if left[n]:
                a = fresh(n, left[n])[0]
                left[n].remove(a)
                attempt(a["id"], "anchor")
    for c in sorted(cands, key=lambda c: (c["rank"], c["id"])):
        attempt(c["id"], "fill")
    ids = [c for c, _ in chosen]
    return chosen, {k: w for k, w in tried.items() if k not in ids}, max(1, -(-(size(ids) if ids else base) // 4))


def test_packing_against_a_plain_loop(spark):
    rng = random.Random(5)
    tables = {n: [] for n in ("ranked", "groups", "anchors", "named", "pins")}
    for q in range(60):
        for i in range(rng.randint(1, 14)):
            entries = [("sources", f"s{s}", 20 + s) for s in rng.sample(range(4), rng.randint(0, 2))] + ([("docs", f"d{i // 2}", 50)] if rng.random() < 0.7 else [])
            tables["ranked"].append((q, i, rng.randint(1, 9), rng.randint(1, 300), entries))
            if rng.random() < 0.3:
                tables["groups"].append((q, i, rng.sample(range(16), rng.randint(0, 2))))
        for part in range(rng.randint(0, 3)):
            ids = rng.sample(range(15), rng.randint(0, 4))
            tables["anchors"] += [(q, part, k, i, rng.sample(["x", "y", "z"], rng.randint(0, 2))) for k, i in enumerate(ids)]
            tables["named"] += [(q, part, k, s) for k, s in enumerate(rng.sample(["x", "y", "z"], rng.randint(0, 2)))]
        tables["pins"] += [(q, k, i) for k, i in enumerate(rng.sample(range(15), rng.randint(0, 3)))]
    kinds = {"ranked": "query_id int, id long, rank long, chars long, entries array<struct<table:string,item:string,chars:long>>", "groups": "query_id int, id long, members array<long>", "anchors": "query_id int, part int, place int, id long, sources array<string>", "named": "query_id int, part int, place int, source string", "pins": "query_id int, place int, id long"}
    frames = {n: spark.createDataFrame(rows, kinds[n]) for n, rows in tables.items()}
    got = {r["query_id"]: r for r in coverage.pack(*frames.values(), 220, 37).collect()}
    steps, reasons = set(), set()
    plain = {n: [r.asDict(True) for r in f.collect()] for n, f in frames.items()}
    for q in range(60):
        cands, groups, anchors, named, pins = ([r for r in rows if r["query_id"] == q] for rows in plain.values())
        chosen, tried, n = plain_packing(cands, groups, anchors, named, pins, 220, 37)
        assert [tuple(c) for c in got[q]["chosen"]] == chosen and {r["id"]: r["why"] for r in got[q]["refused"]} == tried and got[q]["tokens"] == n, q
        steps |= {s for _, s in chosen}
        reasons |= set(tried.values())
    assert steps == {"pin", "part", "source", "anchor", "fill"} and reasons == {"over_budget", "group_conflict", "no_candidate"}
    rows = coverage.audit(coverage.pack(*frames.values(), 220, 37), frames["ranked"]).collect()
    assert len(rows) == len(tables["ranked"]) and all(r["reason"] is not None for r in rows)
    assert {(r["query_id"], r["id"]) for r in rows if r["selected"]} == {(q, c["id"]) for q, r in got.items() for c in r["chosen"]}
    assert coverage.reading_order(coverage.pack(*(f.where("false") for f in frames.values()), 220)).count() == 0


def test_batches_fill_up_to_the_limit(spark):
    rng = random.Random(6)
    rows = [(k, p, rng.randint(1, 90)) for k in range(5) for p in range(20)] + [(9, 0, 500), (9, 1, 1)]
    got = packing.batched(spark.createDataFrame(rows, "key int, pos int, size int"), 100).orderBy("key", "pos").collect()
    want = []
    for key in (0, 1, 2, 3, 4, 9):
        batch = used = 0
        for _, p, n in (r for r in rows if r[0] == key):
            if used and used + n > 100:
                batch, used = batch + 1, 0
            used += n
            want.append((key, p, batch))
    assert [tuple(r) for r in got] == want


def test_fuzzy_matches_want_one_best(spark):
    left = spark.createDataFrame([(1, 1, "retrieval augmented"), (1, 2, "xyz"), (1, 3, "abcdefghij"), (1, 4, "")], "b int, l int, x string")
    right = spark.createDataFrame([(1, 1, "retrieval augmentd"), (1, 2, "a retrieval augmented text"), (1, 3, "abcdefghiX"), (1, 4, "abcdefghiY")], "b int, r int, y string")
    assert [tuple(r) for r in fuzzy.unique_matches(left, right, ["b"]).collect()] == [(1, 2, 2.0)]


def test_bold_lines(spark):
    text = "a a a b b b c\na a a b\n\nx x x x x x"
    assert spark.range(1).select(views.collapsed_bold(F.lit(text))).first()[0] == "a b c\na a a b\n\nx x"


def test_queries_without_sql(spark):
    for name in ("r10_adjacent_expansion", "r12_r13_packing", "r20_packing_audit", "w16_running_batches", "f27_fake_bold", "e11_numeric_gate"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_every_question_is_packed(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    got = {r["query_id"] for r in packing._choice(table)[0].select("query_id").collect()}
    assert got == {r["item_id"] for r in table("benchmark").select("item_id").collect()}
