"""Queues, leases, claims, versions and exports: the survey's groups D, ST and SK in their batch forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.retrieval import TOKENS
from tessera.registry import query

C = F.col


@query("st2_claim", "SELECT user_id, arg_max(event_id, (value, -epoch_us(ts), -event_id)) AS event_id, max(value) AS priority, 1 AS attempts FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    queued = t("events").where("event_type = 'view'").select("user_id", "event_id", "value", "ts")
    best = F.min_by("event_id", F.struct((-C("value")).alias("p"), "ts", "event_id"))
    return queued.groupBy("user_id").agg(best.alias("event_id"), F.max("value").alias("priority"), F.lit(1).alias("attempts"))


@query("st4_lease_recovery", "WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events) SELECT event_id, CASE WHEN event_type <> 'error' OR ts >= now THEN 'running' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'queued' END AS status FROM events, n")
def _(t):
    e = t("events").select("event_id", "event_type", "ts")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))  # one row
    spent = C("event_id") % 4 + 1 >= 3
    status = F.when((C("event_type") != "error") | (C("ts") >= C("now")), "running").when(spent, "failed").otherwise("queued")
    return e.crossJoin(F.broadcast(now)).select("event_id", status.alias("status"))


@query("st5_fenced_commit", "SELECT event_id, value >= max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS accepted FROM events")
def _(t):
    latest = F.max("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return t("events").select("event_id", (C("value") >= latest).alias("accepted"))


@query("st11_recovery_cascade", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'queued' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    again = t("lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey"), F.lit(True).alias("again")).distinct()
    return t("orders").join(again, "o_orderkey", "left").select("o_orderkey", F.when(C("again"), "queued").otherwise(C("o_orderstatus")).alias("status"))


@query("d3_ingestion_dedup", "WITH k AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY 1) SELECT suppliers, min(l_orderkey) AS kept, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def _(t):
    # An order has few lines, so its set is short.
    k = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("suppliers"))
    return k.groupBy("suppliers").agg(F.min("l_orderkey").alias("kept"), F.count("*").alias("n")).where("n > 1")


@query("d8_bulk_approval", "SELECT p_brand, count(*) FILTER (taken) AS conflicts, count(*) FILTER (NOT taken AND p_retailprice > 950) AS approved FROM (SELECT p.*, EXISTS (SELECT 1 FROM part o WHERE o.p_name = p.p_name AND o.p_partkey < p.p_partkey) AS taken FROM part p) GROUP BY 1")
def _(t):
    first = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    p = t("part").join(first, "p_name").withColumn("taken", C("p_partkey") > C("first"))
    return p.groupBy("p_brand").agg(F.count_if(C("taken")).alias("conflicts"), F.count_if(~C("taken") & (C("p_retailprice") > 950)).alias("approved"))


@query("d9_title_repair", "SELECT p_partkey, CASE WHEN n = 1 THEN sole ELSE p_name END AS title FROM part JOIN (SELECT p_brand AS b, p_type AS y, count(DISTINCT p_name) AS n, min(p_name) AS sole FROM part GROUP BY 1, 2) ON b = p_brand AND y = p_type")
def _(t):
    g = t("part").groupBy("p_brand", "p_type").agg(F.countDistinct("p_name").alias("n"), F.min("p_name").alias("sole"))
    return t("part").join(g, ["p_brand", "p_type"]).select("p_partkey", F.when(C("n") == 1, C("sole")).otherwise(C("p_name")).alias("title"))


@query("d12_claims", "SELECT subject, predicate, object FROM (SELECT p_name AS subject, 'defines' AS predicate, p_type AS object FROM part UNION SELECT s_name, 'supplies', p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)")
def _(t):
    defined = t("part").select(C("p_name").alias("subject"), F.lit("defines").alias("predicate"), C("p_type").alias("object"))
    edges = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    said = edges.join(t("supplier"), C("s_suppkey") == C("l_suppkey")).join(t("part"), C("p_partkey") == C("l_partkey")).select("s_name", F.lit("supplies"), "p_name")
    return defined.union(said).distinct()


@query("d14_collection_move", "SELECT CASE source WHEN 'src0' THEN 'src1' ELSE source END AS source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def _(t):
    moved = F.when(C("source") == "src0", "src1").otherwise(C("source"))
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    return t("documents").groupBy(moved.alias("source")).agg(F.count("*").alias("n"), langs.alias("langs"))


@query("d15_version_families", "SELECT regexp_replace(url, '[?#].*$', '') AS family, count(*) AS versions, max(page_id) AS newest, bool_or(contains(html, '<h1')) AS has_evidence FROM pages GROUP BY 1")
def _(t):
    family = F.regexp_replace("url", "[?#].*$", "")
    return t("pages").groupBy(family.alias("family")).agg(F.count("*").alias("versions"), F.max("page_id").alias("newest"), F.bool_or(F.contains("html", F.lit("<h1"))).alias("has_evidence"))


@query("d17_full_replacement", "SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'error'")
def _(t):
    base, new = t("events").select("user_id", "event_id"), t("events").where("event_type = 'error'").select("user_id", "event_id")
    return base.join(new.select("user_id"), "user_id", "left_anti").unionByName(new)


@query("d18_latest_run", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS runs FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("runs"))


@query("g3_drilldown", "SELECT l_partkey AS node, 'in' AS direction, l_returnflag AS type, l_suppkey AS other, count(DISTINCT l_orderkey) AS papers FROM lineitem GROUP BY ALL UNION ALL SELECT l_suppkey, 'out', l_returnflag, l_partkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY ALL")
def _(t):
    g = t("lineitem").groupBy("l_partkey", "l_suppkey", C("l_returnflag").alias("type")).agg(F.countDistinct("l_orderkey").alias("papers"))
    side = lambda node, way, other: g.select(C(node).alias("node"), F.lit(way).alias("direction"), "type", C(other).alias("other"), "papers")
    return side("l_partkey", "in", "l_suppkey").unionByName(side("l_suppkey", "out", "l_partkey"))


@query("sk5_markdown_export", "SELECT s_suppkey, sha256('# ' || s_name || chr(10) || chr(10) || '* nation: ' || n_name || chr(10) || '* balance: ' || s_acctbal::BIGINT || chr(10) || chr(10) || '<!-- manual -->' || chr(10)) AS h FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    x = t("supplier").join(t("nation"), C("n_nationkey") == C("s_nationkey"))
    page = F.concat(F.lit("# "), "s_name", F.lit("\n\n* nation: "), "n_name", F.lit("\n* balance: "), F.rint("s_acctbal").cast("long").cast("string"), F.lit("\n\n<!-- manual -->\n"))
    return x.select("s_suppkey", F.sha2(page, 256).alias("h"))


@query("sk6_content_address", "WITH a AS (SELECT doc_id, sha256(lang || ':' || source || ':' || text) AS address, CASE WHEN doc_id % 10 = 0 THEN text || ' ' ELSE text END AS stored, lang, source FROM documents) SELECT doc_id, address, sha256(lang || ':' || source || ':' || stored) = address AS verified FROM a")
def _(t):
    # Every tenth stored text has been changed since its address was made, and has to fail the check.
    address = lambda text: F.sha2(F.concat_ws(":", "lang", "source", text), 256)
    d = t("documents").select("doc_id", "lang", "source", address("text").alias("address"), F.when(C("doc_id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(C("text")).alias("stored"))
    return d.select("doc_id", "address", (address("stored") == C("address")).alias("verified"))


@query("sk9_projection_counts", "SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS relations, (SELECT count(DISTINCT source) FROM documents) AS topics")
def _(t):
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # one row
    edges = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    return one(t("part"), "entities").crossJoin(one(edges, "relations")).crossJoin(one(t("documents").select("source").distinct().where("source IS NOT NULL"), "topics"))


@query("f44_report", "SELECT lang, sha256('## ' || lang || chr(10) || count(*) || ' documents, ' || sum(n_chars) || ' characters') AS h FROM documents GROUP BY lang")
def _(t):
    g = t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return g.select("lang", F.sha2(F.concat(F.lit("## "), "lang", F.lit("\n"), C("n").cast("string"), F.lit(" documents, "), C("c").cast("string"), F.lit(" characters")), 256).alias("h"))


@query("f3_f7_tokens", f"SELECT doc_id, len({TOKENS.format('text')}) AS n, md5(array_to_string(list_sort({TOKENS.format('text')}), ' ')) AS h FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, url FROM pages)")
def _(t):
    # URLs have joined identifiers, which give their parts and the whole.
    both = t("documents").select("doc_id", "text").unionByName(t("pages").select((-C("page_id") - 1).alias("doc_id"), C("url").alias("text")))
    tokens = tx.identifiers(C("text"))
    return both.select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(tokens), " ")).alias("h"))
