"""Choices under caps against plain loops in the order of the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import selection

DATA = "/root/testdata/sf0.01"


def plain_edges(edges, cap):
    """edges (g, a, b, key) in order of key."""
    degree, out = Counter(), set()
    for g, a, b, key in sorted(edges, key=lambda e: e[3]):
        if degree[g, a] < cap and degree[g, b] < cap:
            out.add((g, a, b, key))
            degree[g, a] += 1
            degree[g, b] += 1
    return out


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_edges_are_those_of_the_sequential_choice(spark, cap):
    rng = random.Random(cap)
    # A hub, a chain whose order runs along it, loops, repeated pairs and null ends.
    edges = [(0, 0, k, k * 7 % 101 + 0.5) for k in range(1, 100)] + [(1, k, k + 1, float(k)) for k in range(12)]
    edges += [(2, rng.randint(0, 30), rng.randint(0, 30), 1000.0 + k) for k in range(300)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (2, None, 1, -1.0), (None, 1, 2, -2.0)], "g int, a int, b int, key double")
    got = selection.capped_edges(df, [F.col("key"), F.col("a"), F.col("b")], cap)
    assert got.columns == df.columns and set(map(tuple, got.collect())) == plain_edges(edges, cap)
    assert selection.capped_edges(df.where("false"), [F.col("key")], cap).count() == 0


def test_edges_of_the_whole_table(spark):
    rows = spark.sql(f"SELECT l_partkey a, l_suppkey b, round(avg(l_discount) * 10, 6) conf FROM parquet.`{DATA}/lineitem.parquet` GROUP BY 1, 2").where("conf >= 0.65").collect()
    want = {(a, b, -k[0]) for _, (_, a), (_, b), k in plain_edges([(0, (0, r["a"]), (1, r["b"]), (-r["conf"], r["a"], r["b"])) for r in rows], 3)}
    got = [tuple(r) for r in registry.queries()["g7_edge_selection"](spark, DATA).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def plain_canvas(nodes, pairs, most, limits, fill, default):
    out = set()
    for g in {n[0] for n in nodes} | {p[0] for p in pairs}:
        kind = {n[1]: n[2] for n in nodes if n[0] == g}
        inside: dict = {}
        for _, key, a, b in sorted((p for p in pairs if p[0] == g), key=lambda p: p[1]):
            new = [x for x in dict.fromkeys((a, b)) if x not in inside]
            per = Counter([*inside.values(), *(kind.get(x) for x in new)])
            if a in kind and b in kind and len(inside) + len(new) <= most and all(per[kind[x]] <= limits.get(kind[x], default) for x in new):
                inside |= {x: kind[x] for x in new}
        out |= {(g, x, k, "pair") for x, k in inside.items()}
        for t in fill:
            rest = sorted((-n[4], n[3].lower(), n[1]) for n in nodes if n[0] == g and n[2] == t and n[1] not in inside)
            room = max(0, limits.get(t, default) - sum(k == t for k in inside.values()))
            out |= {(g, x, t, "fill") for *_, x in rest[:room]}
    return out


@pytest.mark.parametrize(("most", "batch"), [(6, 1), (6, 4), (20, 32)])
def test_nodes_are_those_of_the_sequential_choice(spark, most, batch):
    rng = random.Random(most)
    nodes = [(g, f"n{k:02d}", "ABCD"[k % 4], f"N{k % 7}", rng.randint(0, 5)) for g in (0, 1, 2) for k in range(40)]
    pairs = [(g, k, f"n{rng.randint(0, 44):02d}", f"n{rng.randint(0, 44):02d}") for g in (0, 1, 3) for k in range(150)]
    limits, fill = {"A": 3, "B": 2, "D": 0}, ["A", "C", "D"]
    got = selection.capped_nodes(spark.createDataFrame(nodes, "g int, node string, type string, name string, degree int"), spark.createDataFrame(pairs, "g int, key int, a string, b string"), [F.col("key")], most, limits, fill, batch=batch)
    assert sorted(map(tuple, got.collect())) == sorted(plain_canvas(nodes, pairs, most, limits, fill, 1))


def test_sides_of_edges(spark):
    boxes = spark.createDataFrame([(5, 5), (5, 6), (-5, 1), (0, -3), (0, 0)], "x int, y int")
    got = [tuple(r[0]) for r in boxes.select(selection.edge_sides(F.col("x"), F.col("y"))).collect()]
    assert got == [("right", "left"), ("bottom", "top"), ("left", "right"), ("top", "bottom"), ("right", "left")]


@pytest.mark.parametrize("batch", [8])
def test_types_of_their_own_give_the_same_nodes(spark, batch):
    # Group 1 begins with pairs whose ends are no nodes, group 2 has none but those, group 3 fills up at once; null ends are dropped.
    rng = random.Random(batch)
    kinds = [(f"n{k}", "xyz"[k % 3], f"name {k % 5}") for k in range(30)]
    pairs = [(1, f"u{k}", f"n{k}", k) for k in range(5)] + [(1, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", 10 + k) for k in range(80)]
    pairs += [(2, f"u{k}", f"v{k}", k) for k in range(5)] + [(3, f"n{k}", f"n{k + 1}", k) for k in range(0, 28)] + [(3, None, "n1", -1), (None, "n1", "n2", -1)]
    p = spark.createDataFrame(pairs, "g int, a string, b string, id int")
    k = spark.createDataFrame(kinds, "node string, type string, name string")
    nodes = p.where("g IS NOT NULL").select("g", F.explode(F.array("a", "b")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("degree")).join(k, "node").select("g", "node", "type", "name", "degree")
    for most in (9,):
        limits = {"x": 2, "y": 3, "z": most}
        got = [sorted(map(tuple, selection.capped_nodes(nodes, p, [F.col("id"), F.col("a"), F.col("b")], most, limits, ["x", "y"], batch=batch, **more).collect())) for more in ({}, {"kinds": k.drop("name")})]
        inside, of = {}, {n: t for n, t, _ in kinds}
        for g, a, b, _ in sorted((x for x in pairs if None not in x), key=lambda x: (x[3], x[1], x[2])):
            mine = inside.setdefault(g, [])
            new = [n for n in dict.fromkeys((a, b)) if n not in mine]
            if a in of and b in of and len(mine) + len(new) <= most and all(sum(of[n] == t for n in mine + new) <= limits[t] for t in {of[n] for n in new}):
                mine += new
        assert got[0] == got[1] and {x[:2] for x in got[0] if x[3] == "pair"} == {(g, n) for g, ns in inside.items() for n in ns}
