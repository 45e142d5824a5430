"""Aggregates and windows of the survey's groups A and W that the other plans don't have."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import clusters
from tessera.operators import relational as ops
from tessera.registry import query

C = F.col


def _long(c):
    return c.cast("long")


@query("a4_zero_filled", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    o = t("orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("a6_zero_groups", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    return t("nation").join(t("supplier"), C("s_nationkey") == C("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("a7_extremes", "SELECT min(o_orderdate)::VARCHAR AS oldest, max(o_orderkey) + 1 AS next_key FROM orders")
def _(t):
    return t("orders").agg(F.min("o_orderdate").cast("string").alias("oldest"), (F.max("o_orderkey") + 1).alias("next_key"))


@query("a10_duplicate_fold", "SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_orderkey) AS evidence, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2")
def _(t):
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    return t("lineitem").groupBy("l_partkey", "l_suppkey").agg(flags.alias("flags"), F.countDistinct("l_orderkey").alias("evidence"), F.max("l_discount").alias("confidence"))


@query("a12_undirected_degree", "SELECT id, count(*) AS degree FROM (SELECT DISTINCT 'p' || l_partkey AS id, 's' || l_suppkey AS other FROM lineitem UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem) GROUP BY id")
def _(t):
    e = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    return e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


@query("a13_macro_mean", "SELECT lang, round(avg(toxic), 9) AS toxic, round(avg(quality), 9) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def _(t):
    d = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.avg("toxic"), 9).alias("toxic"), F.round(F.avg("quality"), 9).alias("quality"))


@query("a16_running_mean", "SELECT event_id, (sum(round(value * 100)::BIGINT) OVER w)::DOUBLE / (100 * count(*) OVER w) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t("events").select("event_id", (F.sum(F.round(C("value") * 100).cast("long")).over(w).cast("double") / (100 * F.count("*").over(w))).alias("mean"))


@query("a19_conservative_merge", "SELECT l_orderkey, bool_and(coalesce(l_returnflag = 'N', false)) AS covered, bool_or(l_discount > 0.09) AS violated, count(DISTINCT l_suppkey) >= 2 AS judged FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.coalesce(C("l_returnflag") == "N", F.lit(False))).alias("covered"), F.bool_or(C("l_discount") > 0.09).alias("violated"), (F.countDistinct("l_suppkey") >= 2).alias("judged"))


@query("a20_arm_rates", "SELECT o_orderpriority AS arm, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 9) AS rate FROM orders GROUP BY 1")
def _(t):
    rate = F.count_if(C("o_orderstatus") == "F") / F.nullif(F.count_if(C("o_orderstatus") != "P"), F.lit(0))
    return t("orders").groupBy(C("o_orderpriority").alias("arm")).agg(F.round(rate, 9).alias("rate"))


@query("a23_a24_unknown_propagates", "SELECT l_suppkey, CASE WHEN bool_and(x IS NOT NULL) THEN max(x) END AS peak, CASE WHEN bool_and(x IS NOT NULL) THEN sum(x) END AS total FROM (SELECT l_suppkey, CASE WHEN l_orderkey % 997 > 0 THEN l_quantity END AS x FROM lineitem) GROUP BY 1")
def _(t):
    x = t("lineitem").select("l_suppkey", F.when(C("l_orderkey") % 997 > 0, C("l_quantity")).alias("x"))
    known = F.count("x") == F.count("*")
    return x.groupBy("l_suppkey").agg(F.when(known, F.max("x")).alias("peak"), F.when(known, F.sum("x")).alias("total"))


@query("a25_type_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


@query("a26_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query("a27_term_statistics", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM t) GROUP BY 1) SELECT term, df, (SELECT round(avg(len(w)), 6) FROM t) AS mean_length FROM f")
def _(t):
    tok = t("documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    mean = tok.agg(F.round(F.avg(F.size("w")), 6).alias("mean_length"))
    df = tok.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(mean))  # one row


@query("a30_paired_gates", "WITH a AS (SELECT o_orderpriority AS arm, round(avg(o_totalprice), 2) AS coverage, count(*) AS tokens FROM orders GROUP BY 1), b AS (SELECT tokens AS base FROM a WHERE arm = '5-LOW') SELECT arm, coverage, tokens FROM a, b WHERE tokens <= base * 1.05 + 10 ORDER BY coverage DESC, tokens, arm LIMIT 1")
def _(t):
    a = t("orders").groupBy(C("o_orderpriority").alias("arm")).agg(F.round(F.avg("o_totalprice"), 2).alias("coverage"), F.count("*").alias("tokens"))
    base = a.where("arm = '5-LOW'").select(C("tokens").alias("base"))  # one row
    return a.crossJoin(F.broadcast(base)).where("tokens <= base * 1.05 + 10").orderBy(C("coverage").desc(), "tokens", "arm").limit(1).drop("base")


@query("a31_support_lost", "SELECT l_partkey, count(*) AS lost FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING NOT bool_or(s_nationkey >= 20) ORDER BY lost DESC, l_partkey LIMIT 20")
def _(t):
    li = t("lineitem").join(t("supplier"), C("l_suppkey") == C("s_suppkey"))
    g = li.groupBy("l_partkey").agg(F.count("*").alias("lost"), F.bool_or(C("s_nationkey") >= 20).alias("stays"))
    return g.where("NOT stays").orderBy(C("lost").desc(), "l_partkey").limit(20).select("l_partkey", "lost")


@query("a34_grouped_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice < 1000) AS small, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(C("o_totalprice") < 1000).alias("small"), F.countDistinct("o_custkey").alias("customers"))


@query("a35_transition_matrix", "SELECT old, event_type AS new, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL GROUP BY 1, 2")
def _(t):
    old = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select(C("event_type").alias("new"), old.alias("old")).where("old IS NOT NULL").groupBy("old", "new").agg(F.count("*").alias("n"))


@query("a36_arm_selection", "WITH s AS (SELECT event_type AS arm, user_id % 2 AS stratum, avg(value) AS m FROM events GROUP BY 1, 2), a AS (SELECT arm, round(avg(m), 6) AS accuracy, bool_and(m > 0) AND count(*) = 2 AS ok FROM s GROUP BY 1) SELECT arm, accuracy FROM a WHERE ok ORDER BY accuracy DESC, arm LIMIT 1")
def _(t):
    s = t("events").groupBy(C("event_type").alias("arm"), (C("user_id") % 2).alias("stratum")).agg(F.avg("value").alias("m"))
    a = s.groupBy("arm").agg(F.round(F.avg("m"), 6).alias("accuracy"), (F.bool_and(C("m") > 0) & (F.count("*") == 2)).alias("ok"))
    return a.where("ok").orderBy(C("accuracy").desc(), "arm").limit(1).select("arm", "accuracy")


@query("w2_behind_other_queue", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) + CASE WHEN event_type = 'error' THEN 0 ELSE count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) END AS position FROM events")
def _(t):
    e = t("events").withColumn("urgent", C("event_type") == "error")
    own = F.row_number().over(W.partitionBy("user_id", "urgent").orderBy("ts", "event_id"))
    first = e.where("urgent").groupBy("user_id").agg(F.count("*").alias("ahead"))
    ahead = F.when(C("urgent"), 0).otherwise(F.coalesce("ahead", F.lit(0)))
    return e.withColumn("own", own).join(first, "user_id", "left").select("event_id", _long(C("own") + ahead).alias("position"))


@query("w4_w5_ranks", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS channel_rank FROM part")
def _(t):
    order = [C("p_retailprice").desc(), C("p_partkey")]
    rank = lambda *keys: _long(F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return t("part").select("p_partkey", rank("p_brand").alias("rank"), rank("p_brand", "p_type").alias("channel_rank"))


@query("w6_first_occurrence_rank", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS rank FROM events GROUP BY 1, 2")
def _(t):
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.select("user_id", "event_type", _long(F.row_number().over(W.partitionBy("user_id").orderBy("at"))).alias("rank"))


@query("w7_reciprocal_rank", "SELECT user_id, round(coalesce(1 / min(CASE WHEN event_type = 'purchase' THEN k END), 0), 9) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY 1")
def _(t):
    k = t("events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    first = F.min(F.when(C("event_type") == "purchase", C("k")))
    return k.groupBy("user_id").agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 9).alias("rr"))


@query("w10_round_robin", "SELECT doc_id, lang, k - 1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3 ORDER BY k, lang LIMIT 20")
def _(t):
    d = ops.first_per(t("documents").select("doc_id", "lang", "n_chars"), ["lang"], [C("n_chars").desc(), C("doc_id")], 3)
    depth = F.row_number().over(W.partitionBy("lang").orderBy(C("n_chars").desc(), "doc_id")) - 1
    return d.withColumn("depth", _long(depth)).orderBy("depth", "lang").limit(20).select("doc_id", "lang", "depth")


@query("w12_look_ahead", "SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS errors_ahead FROM events")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 8)
    return t("events").select("event_id", F.count(F.when(C("event_type") == "error", 1)).over(w).alias("errors_ahead"))


@query("w13_joined_blocks", "SELECT conv_id, turn, sum(s) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) THEN 0 ELSE 1 END AS s FROM conversations)")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    begins = t("conversations").withColumn("s", F.when(C("role") == F.lag("role").over(w), 0).otherwise(1))
    return begins.select("conv_id", "turn", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("block"))


@query("w14_repeated_headers", "SELECT source, regexp_replace(replace(lower(string_split(text, chr(10))[1]), ' ', ''), '[0-9]+', '#', 'g') AS signature, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING n >= 2")
def _(t):
    first = F.substring_index("text", "\n", 1)
    g = t("documents").where("text IS NOT NULL").groupBy("source", tx.digit_mask(first).alias("signature"))
    return g.agg(F.countDistinct("doc_id").alias("n")).where("n >= 2")


@query("w15_balanced_positions", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k < 2 OR k >= n - 2 OR k IN (n // 4, n // 2, 3 * n // 4)")
def _(t):
    w = W.partitionBy("user_id")
    e = t("events").select("user_id", "event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    middle = F.expr("k IN (n div 4, n div 2, 3 * n div 4)")
    return e.where((C("k") < 2) | (C("k") >= C("n") - 2) | middle).select("user_id", "event_id")


@query("w17_head_clusters", """
WITH RECURSIVE e AS (SELECT user_id AS k, round(value * 100)::BIGINT AS x FROM events),
h AS (SELECT k, min(x) AS x FROM e GROUP BY k UNION ALL SELECT h.k, min(e.x) FROM h JOIN e ON e.k = h.k AND e.x > h.x + 600 GROUP BY h.k, h.x),
c AS (SELECT e.k, (SELECT max(h.x) FROM h WHERE h.k = e.k AND h.x <= e.x) AS head FROM e),
z AS (SELECT k, head, count(*) AS n FROM c GROUP BY k, head),
n AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, head) <= 2)
SELECT k AS user_id, head, n, row_number() OVER (PARTITION BY k ORDER BY head) AS place FROM n
""")
def _(t):
    # A user's values as places of lines: clusters of six sizes of 1.00 from their head, and the two largest as columns from the left.
    e = t("events").select("user_id", F.round(C("value") * 100).cast("long").alias("x"))
    return clusters.column_edges(clusters.head_clusters(e, "user_id", "x", 600), "user_id", "head").select("user_id", "head", "n", C("place").cast("long").alias("place"))


@query("w18_median_reference", "SELECT doc_id, n_chars < 0.9 * m AS small FROM documents JOIN (SELECT source AS s, median(n_chars) AS m FROM documents GROUP BY 1) ON s IS NOT DISTINCT FROM source")
def _(t):
    d = t("documents").select("doc_id", "source", "n_chars")
    m = d.groupBy(C("source").alias("s")).agg(F.median("n_chars").alias("m"))
    return d.join(m, C("source").eqNullSafe(C("s"))).select("doc_id", (C("n_chars") < 0.9 * C("m")).alias("small"))


@query("w19_leading_run", "SELECT user_id, bool_and(event_type <> 'purchase') FILTER (k <= 3) AND count(*) >= 3 AS stop FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY 1")
def _(t):
    k = t("events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return k.groupBy("user_id").agg((F.bool_and((C("k") > 3) | (C("event_type") != "purchase")) & (F.count("*") >= 3)).alias("stop"))
