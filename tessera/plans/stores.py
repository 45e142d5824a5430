"""The survey's stores as files: write-once results, vector points by collection, a graph with stale deletes, an index of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import projection, vector_index
from tessera.operators import relational as ops
from tessera.registry import query
from tessera.sources import published

C = F.col


def folder(spark) -> str:
    """A fresh name below the folder that driver and executors share."""
    ops.settled(spark.range(1))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("sk7_write_once", "SELECT event_type, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even, true AS refused FROM events GROUP BY 1")
def _(t):
    # The second result of the same name is refused, and the first one read back.
    e = t("events")
    at = folder(e.sparkSession)
    per = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(C("event_id") % 2 == 0).alias("even"))
    published.publish(per, at)
    try:
        published.publish(per.withColumn("n", F.lit(0).cast("long")), at)
        refused = False
    except FileExistsError:
        refused = True
    return published.read(e.sparkSession, at).select("event_type", "n", "even", F.lit(refused).alias("refused"))


UUID = "h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17]), 1) || h[18:20] || '-' || h[21:32]"


@query("sk3_vector_points", f"""
WITH d AS (SELECT doc_id, source AS collection, n_chars, lang, text, sha1(unhex('{projection.URL_NAMESPACE}') || encode('doc:' || doc_id)) AS h FROM documents)
SELECT {UUID} AS id, doc_id, collection, CASE lang WHEN 'de' THEN md5(lower(text)) ELSE md5(text) END AS digest FROM d WHERE collection NOT IN ('src1', 'src2') OR n_chars % 2 = 0 OR lang = 'de'
""")
def _(t):
    # All points, then two collections replaced by some of theirs, then the points of one language upserted.
    d = t("documents")
    point = lambda df, text: df.select(projection.uuid5(F.concat(F.lit("doc:"), C("doc_id").cast("string"))).alias("id"), "doc_id", F.md5(text).alias("digest"), C("source").alias("collection"))
    at = folder(d.sparkSession)
    projection.index(point(d, C("text")), at)
    projection.replace(point(d.where("n_chars % 2 = 0"), C("text")), at, ["src1", "src2"])
    projection.index(point(d.where("lang = 'de'"), F.lower("text")), at)
    return projection.load(d.sparkSession, at, "id string, doc_id long, digest string, collection string")


@query("sk4_graph_merge", """
WITH l AS (SELECT 'p' || l_partkey AS id, 'c' || l_suppkey AS c, l_returnflag = 'R' AS r, 'p' || l_suppkey AS t, l_discount AS d FROM lineitem),
k AS (SELECT 'p' || p_partkey AS id, p_size > 25 AS again FROM part),
m AS (SELECT DISTINCT 'member' AS kind, k.id AS a, c AS b, 0.0::DOUBLE AS v FROM k JOIN l ON l.id = k.id AND l.r = k.again),
e AS (SELECT 'edge' AS kind, id AS a, t AS b, coalesce(max(d) FILTER (r) + 1, max(d)) AS v FROM l GROUP BY id, t)
SELECT * FROM m UNION ALL SELECT * FROM e
""")
def _(t):
    # Parts in the collections of their suppliers; half of them come again in other collections, and returned lines change their edges.
    spark = t("part").sparkSession
    line = t("lineitem").select(F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("id"), F.concat(F.lit("c"), C("l_suppkey").cast("string")).alias("c"), (C("l_returnflag") == "R").alias("r"), F.concat(F.lit("p"), C("l_suppkey").cast("string")).alias("target"), C("l_discount").alias("d"))
    part = t("part").select(F.concat(F.lit("p"), C("p_partkey").cast("string")).alias("id"), C("p_name").alias("name"), (C("p_size") > 25).alias("again"))
    none = F.array().cast("array<string>")

    def nodes(df, r: bool):
        of = line.where(C("r") == F.lit(r)).select("id", "c").distinct().groupBy("id").agg(F.collect_set("c").alias("collections"))
        return df.join(of, "id", "left").select("id", "name", F.coalesce("collections", none).alias("collections"))

    def edges(df, plus: float):
        return df.groupBy("id", "target").agg((F.max("d") + plus).alias("confidence")).select(F.concat_ws(">", "id", "target").alias("id"), C("id").alias("source"), "target", "confidence")

    graph = projection.Graph(spark, folder(spark), "id string, name string", "id string, source string, target string, confidence double", 8)
    graph.replace_all(nodes(part, False), edges(line.where("NOT r"), 0.0))
    graph.upsert_nodes(nodes(part.where("again"), True))
    graph.upsert_edges(edges(line.where("r"), 1.0))
    members = graph.table("memberships").select(F.lit("member").alias("kind"), C("id").alias("a"), C("collection").alias("b"), F.lit(0.0).alias("v"))
    return members.unionByName(graph.table("edges").select(F.lit("edge").alias("kind"), C("source").alias("a"), C("target").alias("b"), C("confidence").alias("v")))


@query("sc6_sc7_filtered_index", """
SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank
FROM embeddings v JOIN embeddings q ON v.label % 3 <> q.vec_id % 3 WHERE q.vec_id % 100 = 0 QUALIFY rank <= 30
""")
def _(t):
    # Three scopes, each without a third of the labels; the stated query set against an index that is stored, loaded and verified.
    e = t("embeddings").select(C("vec_id").alias("id"), C("label").alias("doc"), C("embedding").alias("vector"))
    spark, who = e.sparkSession, {"provider": "embeddings", "dimension": 64}
    at = folder(spark)
    vector_index.build(e, at, who, 64)
    scopes = e.select("doc").distinct().withColumn("scope", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).where(C("doc") % 3 != C("scope")).select("scope", "doc")
    queries = e.where("id % 100 = 0").select(C("id").alias("query_id"), (C("id") % 3).alias("scope"), "vector")
    return vector_index.Index(spark, at, who).search(queries, scopes, 5).select("query_id", "id", "score", C("rank").cast("long").alias("rank"))
