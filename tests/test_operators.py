"""Golden expectations of single operators, and a stream run to its end."""

import math
import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import relational as ops
from tessera.operators import retrieval as ret
from tessera.streaming import queue


def test_bm25_of_one_document(spark):
    one = spark.createDataFrame([("one", "term")], "id string, text string")
    got = ret.bm25(one, spark.createDataFrame([(1, "term term")], "query_id int, text string")).collect()
    assert [r["score"] for r in got] == [round(math.log(4 / 3), 6)]
    with pytest.raises(ValueError):
        ret.bm25(one, one, k1=-1)


def test_fusion_counts_first_places(spark):
    rows = [(1, "bm25", k, x) for k, x in enumerate("aab")] + [(1, "vector", k, x) for k, x in enumerate("bc")]
    got = {r["id"]: r["score"] for r in ret.fused(spark.createDataFrame(rows, "query_id int, channel string, pos int, id string")).collect()}
    assert sorted(got, key=lambda k: (-got[k], k)) == ["b", "a", "c"]
    assert got["b"] == round(1 / 62 + 1 / 61, 9)


def test_group_cap(spark):
    df = spark.createDataFrame([("b", "p1", 10), ("a", "p1", 10), ("c", "p1", 8), ("d", "p2", -2)], "id string, g string, s int")
    got = ops.first_per(df, ["g"], [F.col("s").desc(), F.col("id")], 2).orderBy(F.col("s").desc(), "id")
    assert [r["id"] for r in got.collect()] == ["a", "b", "d"]


def test_coverage_folds_sharp_s(spark):
    row = spark.createDataFrame([("Paragraph Straße",)], "x string").select(tx.coverage(F.lit(["rag", "strasse"]), F.col("x")), tx.coverage(F.array().cast("array<string>"), F.col("x"))).first()
    assert tuple(row) == (1.0, 0.0)


def test_identifier_tokens(spark):
    row = spark.createDataFrame([("Use gte-3000 now",)], "x string").select(tx.identifiers(F.col("x")).alias("t")).first()
    assert sorted(row["t"]) == ["3000", "gte", "gte3000", "now", "use"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(50, 40)], "a long, b long")
    assert {r["node"]: r["component"] for r in ops.connected(edges).collect()} == {k: 1 for k in range(1, 13)} | {40: 40, 50: 40}


def test_rounds_of_components_know_their_sizes(spark):
    # Sizes that are only estimated are products of products: after some rounds they have millions of digits.
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 20_000, (12_000, 2))], "a long, b long")
    found = ops.connected(edges)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**100
    assert found.count() == found.select("node").distinct().count() == edges.where("a <> b").select(F.explode(F.array("a", "b"))).distinct().count()


def test_stream_drops_replays_and_counts_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(k, datetime(2024, 1, 1, k // 4), float(k)) for k in range(8)]
    spark.createDataFrame(rows + rows[:2], "id int, ts timestamp, value double").coalesce(1).write.parquet(src)
    seen = []
    stream = queue.idempotent(queue.event_stream(spark, src, "id int, ts timestamp, value double"), "id", "1 day")
    q = queue.outbox(stream, lambda df: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"), "id")
    q.awaitTermination()
    assert sorted(seen) == list(range(8))
    w = queue.windowed(queue.event_stream(spark, src, "id int, ts timestamp, value double"), "1 hour", None, "10 minutes", [])
    q = w.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("win").collect()) == [4, 6]


def test_dense_in_blocks_equals_broadcast(spark):
    v = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("vector"))
    q = v.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    rows = lambda most: sorted(map(tuple, ret.dense(v, q, 5, most).collect()))
    assert rows(100) == rows(2) and len(rows(2)) == 30


def test_dense_search_in_blocks_is_that_of_pairs(spark):
    rng = random.Random(3)
    vec = lambda n: [rng.choice([-1.0, 0.0, 0.5, 1.0, rng.random()]) for _ in range(n)]
    rows = [(k, vec(rng.choice([3, 3, 3, 4]))) for k in range(300)] + [(k, [1.0, 2.0, 3.0]) for k in range(300, 340)]
    rows += [(340, None), (341, []), (342, [1.0, None, 2.0]), (343, [float("nan"), 1.0, 1.0]), (344, [0.0, 0.0, 0.0]), (345, [float("inf"), 1.0, 0.0]), (346, [-1.0, -2.0, -3.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 20 = 0 OR id > 338").withColumnRenamed("id", "query_id")
    both = v.crossJoin(q.withColumnRenamed("vector", "w")).select("query_id", "id", F.round(ret.cosine(F.col("vector"), F.col("w")), 6).alias("score"))
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in df.collect())
    for limit in (7, 400):
        want = plain(ret.ranked(both, limit))
        assert plain(ret.dense(v, q, limit)) == want and plain(ret.dense(v, q, limit, 200)) == want


def test_a_dense_search_makes_no_row_for_each_pair(spark):
    v = spark.range(200).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"))
    plan = ret.dense(v, v.withColumnRenamed("id", "query_id"), 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_text_is_folded_once_for_all_terms(spark):
    # A text of 4 MB and 3,000 terms that begin it: folded for each of them, that would be 12 GB.
    df = spark.range(1).select(F.repeat(F.lit("Straße "), 600_000).alias("x"), F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda k: F.lit("strasse")).alias("terms"))
    start = time.monotonic()
    assert df.select(tx.coverage(F.col("terms"), F.col("x")).alias("c")).where("c = 1").count() == 1 and time.monotonic() - start < 15


def test_terms_of_many_questions_in_one_reading(spark):
    texts = ["the abc-def_1 gh", "xabcx", "ab c", "", None, "ÄBCabcé abc", "x" * 70 + "abc"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    q = spark.createDataFrame([(1, ["abc", "def_1", "c-d"]), (2, ["zzz", "the"]), (3, [])], "q int, terms array<string>")
    rows = lambda most: sorted((r["id"], r["q"], r["held"]) for r in ret.covered(d, q, "text", most).where("id <> 4").select("id", "q", "held").collect())
    want = sorted((k, i, sum(t in x for t in ts) / len(ts) if ts else 0.0) for k, x in enumerate(texts) if x is not None for i, ts in ((1, ["abc", "def_1", "c-d"]), (2, ["zzz", "the"]), (3, [])))
    assert rows(1 << 20) == want and rows(1) == want


def test_ranking_in_tasks_says_what_the_joins_say(spark):
    texts = ["gte-3000 is a Model", "a--b_c-d ÄÖ x", "model model MODEL gte 3000 gte3000", "", None, "nothing here", "K-9 İ-7 kelvin K-9"] + [f"model w{i % 7} gte-3000" for i in range(60)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(1, "The gte-3000 model"), (2, "w3 w4 b_c-d k-9"), (3, "unheard of"), (4, "")], "query_id int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for limit in (3, 1000):
        got = rows(ret.bm25(docs, asked, limit=limit))
        assert got and got == rows(ret.bm25(docs, asked, limit=limit, most=0))
        got = rows(ret.hash_search(docs, asked, limit))
        assert got and got == rows(ret.hash_search(docs, asked, limit, most=0))


def test_token_lists_are_the_identifiers_in_another_order(spark):
    texts = ["gte-3000 x_y-z -a- b--c __d_e_ 9-", "AK-İb é-f", "", "-_-", "a-b_c--d-e f"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").select(tx.identifiers(F.col("text")).alias("t"), F.lower("text").cast("binary").alias("b"))
    for r in df.collect():
        assert sorted(r["t"]) == sorted(w.decode() for w in tx.token_list(bytes(r["b"])))


def test_rounded_is_spark_round(spark):
    xs = [0.0078125, -0.0078125, 1.0000005, 2.5e-7, 0.1234565, 0.1234575, 1 / 3, -1 / 3, 12.3456785, 0.0, 5e-7, 4.9999999e-7]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6)).collect()]
    assert [float(v) for v in ret.rounded(np.array(xs))] == want


def test_tasks_grow_in_number_with_the_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ops.spread(df, ["id"], 10**9).rdd.getNumPartitions() == 2000
    out = ops.spread(df, ["k"], 1000)
    assert out.rdd.getNumPartitions() == least and out.count() == 1000
