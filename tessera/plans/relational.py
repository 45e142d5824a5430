"""Scans, predicates, joins, aggregates, windows, paging and set operations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import hash_share
from tessera.operators import relational as ops
from tessera.registry import query

C = F.col


def seconds():
    """Seconds since 1970 of ts, a timestamp without zone, whatever zone the session has."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


@query("sk1_upsert_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    e = t("events")
    return ops.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), ["user_id"], [C("ts").desc(), C("event_id").desc()]).select("user_id", "event_type", "value")


@query("sk2_insert_if_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def _(t):
    return ops.insert_absent(t("orders").where("o_orderpriority = '1-URGENT'").select(C("o_custkey").alias("c_custkey")), t("customer"), ["c_custkey"]).select("c_custkey", "c_name")


@query("sk10_change_only", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size % 3 = 0")
def _(t):
    new = t("part").select("p_partkey", F.when(C("p_size") % 3 == 0, C("p_size") + 1).otherwise(C("p_size")).alias("p_size"))
    return ops.changed_only(t("part").select("p_partkey", "p_size"), new, ["p_partkey"], ["p_size"])


@query("p1_projected_label", "SELECT s_suppkey, coalesce(s_name, s_suppkey::VARCHAR) || ' / ' || s_nationkey::VARCHAR AS label, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM supplier")
def _(t):
    s = t("supplier")
    return s.select("s_suppkey", F.concat(F.coalesce("s_name", C("s_suppkey").cast("string")), F.lit(" / "), C("s_nationkey").cast("string")).alias("label"), F.when(C("s_acctbal") < 0, "debt").otherwise("credit").alias("side"))


@query("p2_optional_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def _(t):
    given = {"status": "F", "least": 100000, "priority": None}
    parts = [(given["status"], C("o_orderstatus") == given["status"]), (given["least"], C("o_totalprice") >= F.lit(given["least"])), (given["priority"], C("o_orderpriority") == F.lit(given["priority"]))]
    cond = F.lit(True)
    for value, p in parts:
        cond = cond & p if value is not None else cond
    return t("orders").where(cond).select("o_orderkey", "o_totalprice")


@query("p3_scope_fails_closed", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def _(t):
    d = t("documents")
    within = lambda scope: C("lang").isin(*scope) if scope else F.lit(False)
    return d.where(within(["de", "fr"])).select("doc_id").unionByName(d.where(within([])).select("doc_id"))


@query("p4_json_path_predicate", "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events WHERE json_extract(props, '$.k')::DOUBLE >= 50")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return t("events").select("event_id", k.alias("k")).where("k >= 50")


@query("p8_keyset_predicate", "SELECT o_orderkey FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5)")
def _(t):
    return t("orders").where((C("o_totalprice") < 200000) | ((C("o_totalprice") == 200000) & (C("o_orderkey") > 5))).select("o_orderkey")


@query("p14_hash_sample", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('audit:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.25")
def _(t):
    return t("documents").where(hash_share("audit", C("doc_id")) < 0.25).select("doc_id")


@query("p15_blind_order", "SELECT part_key, pos FROM (SELECT p_partkey AS part_key, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7:' || p_partkey::VARCHAR)) AS pos FROM part)")
def _(t):
    w = W.partitionBy("p_brand").orderBy(F.sha2(F.concat_ws(":", F.lit("7"), C("p_partkey").cast("string")), 256))
    return t("part").select(C("p_partkey").alias("part_key"), F.row_number().over(w).cast("long").alias("pos"))


@query("p18_referential_edges", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey <> l_suppkey")
def _(t):
    e = t("lineitem").select("l_partkey", "l_suppkey").where("l_partkey <> l_suppkey").distinct()
    e = e.join(t("part").where("p_size > 25"), C("l_partkey") == C("p_partkey"), "left_semi")
    return e.join(t("supplier").where("s_acctbal > 0"), C("l_suppkey") == C("s_suppkey"), "left_semi")


@query("p19_vector_validity", "SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 AS valid FROM embeddings")
def _(t):
    ok = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)
    return t("embeddings").select("vec_id", ok.alias("valid"))


JOINED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey"


@query("j1_evidence_chain", f"SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price {JOINED} WHERE l_quantity > 10 AND o_orderstatus = 'F' GROUP BY ALL")
def _(t):
    x = t("lineitem").where("l_quantity > 10").join(t("orders").where("o_orderstatus = 'F'"), C("l_orderkey") == C("o_orderkey"))
    x = x.join(t("customer"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey"))
    x = x.join(t("region"), C("n_regionkey") == C("r_regionkey")).join(t("supplier"), C("l_suppkey") == C("s_suppkey"))
    return x.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("j2_optional_owner", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def _(t):
    o = t("orders").where("o_orderstatus = 'O'")
    return t("customer").join(o, C("c_custkey") == C("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("j3_scope_authorisation", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)) OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def _(t):
    deep = t("orders").join(t("lineitem").where("l_discount > 0.09"), C("l_orderkey") == C("o_orderkey"), "left_semi")
    a = t("customer").join(deep, C("o_custkey") == C("c_custkey"), "left_semi").select("c_custkey")
    b = t("customer").join(t("nation").where("n_regionkey = 1"), C("n_nationkey") == C("c_nationkey"), "left_semi").select("c_custkey")
    return a.union(b).distinct()


@query("j4_not_superseded", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND (x.ts, x.event_id) > (e.ts, e.event_id))")
def _(t):
    return ops.first_per(t("events"), ["user_id", "event_type"], [C("ts").desc(), C("event_id").desc()]).select("event_id")


@query("j5_json_key_join", "SELECT p_size, count(*) AS n FROM events JOIN part ON json_extract(props, '$.k')::BIGINT = p_partkey GROUP BY p_size")
def _(t):
    e = t("events").select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.join(t("part"), C("k") == C("p_partkey")).groupBy("p_size").agg(F.count("*").alias("n"))


@query("j6_self_join_names", "SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM supplier s JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey")
def _(t):
    x = t("lineitem").join(t("supplier"), C("l_suppkey") == C("s_suppkey")).join(t("orders"), C("l_orderkey") == C("o_orderkey")).join(t("customer"), C("o_custkey") == C("c_custkey")).select("s_nationkey", "c_nationkey").distinct()
    n = t("nation")
    return x.join(n.select(C("n_nationkey").alias("s_nationkey"), C("n_name").alias("src")), "s_nationkey").join(n.select(C("n_nationkey").alias("c_nationkey"), C("n_name").alias("dst")), "c_nationkey").select("src", "dst").distinct()


@query("j8_undirected_neighbours", "SELECT node, count(DISTINCT other) AS degree FROM (SELECT 'p' || l_partkey AS node, 's' || l_suppkey AS other FROM lineitem UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem) GROUP BY node")
def _(t):
    e = t("lineitem").select(F.concat(F.lit("p"), C("l_partkey")).alias("node"), F.concat(F.lit("s"), C("l_suppkey")).alias("other")).distinct()
    return e.union(e.select("other", "node")).groupBy("node").agg(F.count("*").alias("degree"))


@query("j10_rehydration", "SELECT vec_id, coalesce(d.doc_id, -1) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.lang <> 'en' THEN 'out_of_scope' ELSE 'verified' END AS reason FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id")
def _(t):
    x = t("embeddings").join(t("documents").select("doc_id", "lang"), C("vec_id") == C("doc_id"), "left")
    return x.select("vec_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.when(C("doc_id").isNull(), "missing").when(C("lang") != "en", "out_of_scope").otherwise("verified").alias("reason"))


@query("j12_interval_overlap", "WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a FROM events) SELECT x.event_id AS l, y.event_id AS r FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND greatest(x.a, y.a) < least(x.a + 3600, y.a + 3600)")
def _(t):
    s = t("events").select("user_id", "event_id", seconds().alias("a"))
    left = s.select("user_id", C("event_id").alias("l"), C("a").alias("ls"), (C("a") + 3600).alias("le"))
    right = s.select("user_id", C("event_id").alias("r"), C("a").alias("rs"), (C("a") + 3600).alias("re"))
    return ops.overlap_join(left, right, ["user_id"], 3600).where("l < r").select("l", "r")


@query("j14_adjacent_intervals", "WITH s AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber + 1 AS e, l_orderkey * 100 + l_linenumber AS id, l_extendedprice AS r FROM lineitem), b AS (SELECT x.id, min_by(y.id, (y.r, y.id)) AS before FROM s x JOIN s y ON x.k = y.k AND y.e = x.s GROUP BY 1), a AS (SELECT x.id, min_by(y.id, (y.r, y.id)) AS after FROM s x JOIN s y ON x.k = y.k AND y.s = x.e GROUP BY 1) SELECT DISTINCT id, before, after FROM s LEFT JOIN b USING (id) LEFT JOIN a USING (id)")
def _(t):
    s = t("lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("s"), (C("l_linenumber") + 1).alias("e"), (C("l_orderkey") * 100 + C("l_linenumber")).alias("id"), C("l_extendedprice").alias("r"))
    return ops.neighbours(s, ["k"], "id", "s", "e", "r").distinct()


@query("j18_shadow_read", "WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT CASE WHEN b.id IS NULL THEN 'legacy_only' WHEN a.id IS NULL THEN 'core_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1")
def _(t):
    ids = lambda flag, name: t("lineitem").where(C("l_returnflag") == flag).select(C("l_partkey").alias("id")).distinct().withColumn(name, F.lit(True))
    both = ids("A", "a").join(ids("R", "b"), "id", "full")
    return both.groupBy(F.when(C("b").isNull(), "legacy_only").when(C("a").isNull(), "core_only").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


@query("j20_first_match", "SELECT c_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    first = t("orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return t("customer").select("c_custkey").join(first, "c_custkey")


@query("j22_unambiguous_title", "SELECT l_linenumber, count(*) AS n FROM lineitem JOIN (SELECT p_name, p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY p_name, p_brand, p_size HAVING count(DISTINCT p_partkey) = 1) ON l_partkey = k GROUP BY 1")
def _(t):
    one = t("part").groupBy("p_name", "p_brand", "p_size").agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("k")).where("n = 1")
    return t("lineitem").join(one.select("k"), C("l_partkey") == C("k")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("st6_as_of_heartbeat", "SELECT e.event_id, (SELECT x.value FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts <= e.ts ORDER BY x.ts DESC LIMIT 1) AS value FROM events e WHERE e.event_type = 'purchase'")
def _(t):
    e = t("events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", C("ts").alias("since"), "value")
    return ops.as_of(left, right, "user_id", "ts", "since", ["value"]).select("event_id", "value")


@query("a1_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a2_distinct_per_group", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("a3_conditional_sums", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O')::BIGINT AS open, count(*) FILTER (l_discount > 0.05)::BIGINT AS discounted FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if(C("l_linestatus") == "O").alias("open"), F.count_if(C("l_discount") > 0.05).alias("discounted"))


@query("a5_two_level_rollup", "SELECT r_name, n_name, count(*) AS n, grouping_id(r_name, n_name)::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(t):
    x = t("customer").join(t("nation"), C("c_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("a8_json_sums", "SELECT event_type, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events UNION ALL SELECT 'all', json_extract(props, '$.k')::BIGINT FROM events) GROUP BY 1")
def _(t):
    e = t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.union(e.select(F.lit("all"), "k")).groupBy("event_type").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


@query("a9_nested_collect", "SELECT o_orderkey, array_to_string(list(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey), ',') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    x = t("orders").select("o_orderkey").join(t("lineitem"), C("o_orderkey") == C("l_orderkey")).groupBy("o_orderkey").agg(lines.alias("x"))
    return x.select("o_orderkey", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ",").alias("lines"))


@query("a11_edge_weights", "SELECT l_suppkey AS src, l_partkey AS dst, greatest(1, count(DISTINCT l_orderkey))::BIGINT AS weight FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").groupBy(C("l_suppkey").alias("src"), C("l_partkey").alias("dst")).agg(F.greatest(F.lit(1), F.countDistinct("l_orderkey")).alias("weight"))


@query("a14_nearest_rank_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return ops.nearest_rank(t("events"), ["event_type"], "value", 0.95, "p95").join(t("events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type")


@query("a15_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median"))


@query("a33_length_bins", "SELECT lang, CASE WHEN n_chars <= 300 THEN 'short' WHEN n_chars <= 1200 THEN 'middle' ELSE 'long' END AS bin, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1, 2")
def _(t):
    bins = F.when(C("n_chars") <= 300, "short").when(C("n_chars") <= 1200, "middle").otherwise("long")
    return t("documents").groupBy("lang", bins.alias("bin")).agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("w1_queue_position", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS pos FROM orders")
def _(t):
    return t("orders").select("o_orderkey", "o_orderpriority", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).cast("long").alias("pos"))


@query("w3_group_cap", "SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(t):
    return ops.first_per(t("part"), ["p_brand"], [C("p_retailprice").desc(), C("p_partkey")], 2).orderBy(C("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_brand", "p_retailprice")


@query("w8_interval_union", "WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 7200 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i), g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, k")
def _(t):
    s = seconds()
    return ops.interval_union(t("events").select("user_id", s.alias("s"), (s + 7200).alias("e")), ["user_id"], "s", "e")


@query("w9_sequence_gaps", "SELECT conv_id, max(turn) + 1 AS next_turn, count(*) FILTER (turn - prev > 1)::BIGINT AS gaps FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def _(t):
    c = t("conversations").select("conv_id", "turn", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("prev"))
    return c.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.count_if(C("turn") - C("prev") > 1).alias("gaps"))


@query("w11_state_propagation", "SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'none') AS state FROM events")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t("events").select("event_id", F.coalesce(F.last(F.when(C("event_type").isin("signup", "error"), C("event_type")), ignorenulls=True).over(w), F.lit("none")).alias("state"))


@query("t2_ranked_sort_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    rank = F.when(C("o_orderpriority") == "1-URGENT", 0).when(C("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t("orders").orderBy(rank, C("o_orderdate").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderpriority")


@query("t4_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 21")
def _(t):
    return ops.keyset_page(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (300000.0, 0), 20)


@query("t8_recent_per_kind", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def _(t):
    return ops.first_per(t("events"), ["event_type"], [C("ts").desc(), C("event_id")], 5).select("event_type", "event_id")


@query("u1_union_kinds", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def _(t):
    return t("customer").select(F.lit("customer").alias("kind"), C("c_custkey").alias("id"), C("c_name").alias("name")).unionByName(t("supplier").select(F.lit("supplier").alias("kind"), C("s_suppkey").alias("id"), C("s_name").alias("name")))


@query("u3_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def _(t):
    return t("lineitem").where("l_returnflag = 'A'").select("l_partkey").intersect(t("lineitem").where("l_returnflag = 'N'").select("l_partkey"))


@query("u4_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t("part").select("p_partkey").subtract(t("lineitem").where("l_quantity > 45").select(C("l_partkey").alias("p_partkey")))
