"""Write-once results, partitioned projections and the vector index: reruns, killed attempts, untouched files, filters."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import projection, vector_index
from tessera.sources import published

ROWS = "id string, collection string, v int"


def files(path) -> dict[str, int]:
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_results_are_published_once(spark, tmp_path):
    at = str(tmp_path / "r")
    one, two = spark.range(5), spark.range(9)
    with pytest.raises(FileNotFoundError):
        published.read(spark, at)
    # An attempt that was killed while it wrote, and one that was killed before its marker was moved.
    one.write.parquet(f"{at}/_attempts/dead")
    (tmp_path / "r" / "_attempts" / "dead.marker").write_text("{")
    assert not published.is_published(spark, at)
    published.publish(one, at, {"who": "é"})
    with pytest.raises(FileExistsError):
        published.publish(two, at)
    assert published.read(spark, at).count() == 5 and published.note_of(spark, at) == {"who": "é"}
    published.clear(spark, at)
    assert len([f for f in os.listdir(f"{at}/_attempts") if not f.startswith(".")]) == 1 and published.read(spark, at).count() == 5


def test_of_two_attempts_at_once_one_is_published(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "r")
    plain = published.is_published
    done = []

    def late(s, target):
        if not done:  # the other attempt comes between the first look and the move
            done.append(1)
            monkeypatch.setattr(published, "is_published", plain)
            published.publish(spark.range(3), at)
            return False
        return plain(s, target)

    monkeypatch.setattr(published, "is_published", late)
    with pytest.raises(FileExistsError):
        published.publish(spark.range(8), at)
    assert published.read(spark, at).count() == 3


def test_uuid5(spark):
    names = ["", "a", "doc:1", "日本", "http://x/y?z"] + [f"n{k}" for k in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", projection.uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_points_by_collection(spark, tmp_path):
    at = str(tmp_path / "p")
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    load = lambda: rows_of(projection.load(spark, at, "id string, v int, collection string"))
    assert load() == []
    projection.index(df([("a", "x", 1), ("b", "x", 2), ("a", "y", 3), ("c", "z/ü", 4), ("c", "z/ü", 5)]), at)
    assert load() == [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "x"), ("c", 5, "z/ü")]
    before = files(at)
    for _ in range(2):
        projection.replace(df([("d", "x", 7), ("e", "y", 8), ("q", "other", 9)]), at, ["x", "z/ü", "new"])
        assert load() == [("a", 3, "y"), ("d", 7, "x")]
    assert {k: v for k, v in files(at).items() if k.startswith("collection=y")} == {k: v for k, v in before.items() if k.startswith("collection=y")}
    for _ in range(2):
        projection.index(df([("d", "x", 70), ("f", "x", 1)]), at)
        assert load() == [("a", 3, "y"), ("d", 70, "x"), ("f", 1, "x")]
    projection.replace(df([("g", "w", 1)]), at)
    assert load() == [("g", 1, "w")]


def test_graph_merge_against_dictionaries(spark, tmp_path):
    rng = random.Random(2)
    graph = projection.Graph(spark, str(tmp_path / "g"), "id string, name string", "id string, source string, target string, w int", 6)
    nodes, members, edges = {}, set(), {}
    for step in range(4):
        new = {f"n{rng.randint(0, 25)}": (f"name{step}", sorted({f"c{rng.randint(0, 4)}" for _ in range(rng.randint(0, 3))})) for _ in range(8)}
        for _ in range(2 if step == 3 else 1):
            graph.upsert_nodes(spark.createDataFrame([(k, n, c) for k, (n, c) in new.items()], "id string, name string, collections array<string>"))
        for k, (n, c) in new.items():
            nodes[k] = n
            members = {m for m in members if m[0] != k} | {(k, x) for x in c}
        more = {f"e{rng.randint(0, 9)}": (rng.choice(list(nodes)), rng.choice(list(nodes)), step) for _ in range(5)}
        graph.upsert_edges(spark.createDataFrame([(k, *e) for k, e in more.items()], "id string, source string, target string, w int"))
        edges |= more
        assert rows_of(graph.table("nodes").drop("b")) == sorted(nodes.items())
        assert rows_of(graph.table("memberships").drop("b")) == sorted(members)
        assert rows_of(graph.table("edges").drop("b")) == sorted((k, *e) for k, e in edges.items())
    before = files(tmp_path / "g")
    with pytest.raises(ValueError, match="isn't a node"):
        graph.upsert_edges(spark.createDataFrame([("bad", "n1", "nobody", 1)], "id string, source string, target string, w int"))
    assert files(tmp_path / "g") == before
    graph.upsert_nodes(spark.createDataFrame([("n3", "again", [])], "id string, name string, collections array<string>"))
    mine = f"b={projection.bucketed(spark.createDataFrame([('n3',)], 'id string'), 'id', 6).first()['b']}"
    assert all(before.get(k) == v for k, v in files(tmp_path / "g").items() if mine not in k)
    graph.replace_all(spark.createDataFrame([("z", "n", ["c"])], "id string, name string, collections array<string>"), spark.createDataFrame([], "id string, source string, target string, w int"))
    assert rows_of(graph.table("nodes").drop("b")) == [("z", "n")] and graph.table("edges").count() == 0


def clustered(n: int, dim: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (12, dim))[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, dim))


@pytest.mark.parametrize(("lists", "tile", "probe"), [(16, 8192, 1), (5, 20, 3), (1, 50, 2), (600, 8192, 2)])
def test_index_equals_a_full_scan(spark, tmp_path, lists, tile, probe):
    x = clustered(500, 8, 3)
    rows = [(k, k % 7, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [float("nan")] * 8), (None, 1, [1.0] * 8), (903, 2, rows0 := [float(c) for c in x[0]]), (904, None, rows0)]
    at, who = str(tmp_path / "i"), {"model": "m", "dimension": 8}
    vector_index.build(spark.createDataFrame(rows, "id long, doc int, vector array<double>"), at, who, 8, lists=lists, sample=300, tile=tile)
    allowed = {"a": {0, 1, 2}, "b": {5}, "none": set()}
    queries = [(k, s, [float(c) for c in x[k]]) for k in range(0, 500, 50) for s in ("a", "b")] + [(2000, "a", None), (2001, "b", [0.0] * 8), (2002, "none", rows0), (2003, "lost", rows0)]
    queries = [(n, s, v) for n, (_, s, v) in enumerate(queries)]
    index = vector_index.Index(spark, at, who)
    found, read = index.search_lists(spark.createDataFrame(queries, "query_id int, scope string, vector array<double>"), spark.createDataFrame([(s, d) for s, ds in allowed.items() for d in ds], "scope string, doc int"), 3, probe)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = []
    for n, s, v in queries:
        if v is None or not any(v):
            continue
        mine = sorted((-np.round(unit(v) @ unit(w), 6), i) for i, d, w in rows if d in allowed.get(s, ()) and i is not None and w is not None and any(w) and np.isfinite(w).all())
        want += [(n, i, -c, r) for r, (c, i) in enumerate(mine[:18], 1)]
    got = rows_of(found.select("query_id", "id", "score", "rank"))
    assert [g[:2] + g[3:] for g in got] == sorted(w[:2] + w[3:] for w in want) and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-6)
    pairs, most = read.distinct().count(), len(index.lists) * 20
    assert read.count() == pairs and (lists != 16 or pairs < 0.8 * most)


def test_index_is_refused_under_another_identity_or_other_rows(spark, tmp_path):
    at, who = str(tmp_path / "i"), {"model": "m"}
    rows = spark.createDataFrame([(k, 0, [1.0, float(k)]) for k in range(9)], "id long, doc int, vector array<double>")
    vector_index.build(rows, at, who, 2, lists=2)
    with pytest.raises(FileExistsError):
        vector_index.build(rows, at, who, 2, lists=2)
    with pytest.raises(ValueError, match="identity"):
        vector_index.Index(spark, at, {"model": "other"})
    with pytest.raises(ValueError, match="dimension"):
        vector_index.build(rows, str(tmp_path / "j"), who, 3)
    index = vector_index.Index(spark, at, who)
    assert vector_index.limit_of(3) == 18 and vector_index.limit_of(40) == 100
    index.rows.limit(3).write.mode("append").partitionBy("list").parquet(index.rows.inputFiles()[0].split("/list=")[0])
    with pytest.raises(ValueError, match="manifest"):
        vector_index.Index(spark, at, who)
    vector_index.build(rows.where("false"), str(tmp_path / "k"), who, 2)
    assert vector_index.Index(spark, str(tmp_path / "k"), who).search(spark.createDataFrame([(1, 0, [1.0, 1.0])], "query_id int, scope int, vector array<double>"), spark.createDataFrame([(0, 0)], "scope int, doc int"), 3).count() == 0
