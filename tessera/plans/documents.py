"""Scalar text functions, chunking, entity resolution and graph queries over documents, pages and the part-supplier edges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import relational as ops
from tessera.registry import query

C = F.col


@query("f1_collapsed_text", "SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))), 'ß', 'ss')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.collapsed(C("text"))).alias("h"))


@query("f4_query_terms", "SELECT page_id, array_to_string(list_distinct(regexp_extract_all(lower(url), '[a-z0-9_-]{3,}')), ' ') = '' AS none, len(list_distinct(regexp_extract_all(lower(url), '[a-z0-9_-]{3,}'))) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(url), '[a-z0-9_-]{3,}'))), ' ') AS terms FROM pages")
def _(t):
    terms = tx.query_terms(C("url"), 1000)
    return t("pages").select("page_id", (F.size(terms) == 0).alias("none"), F.size(terms).cast("long").alias("n"), F.array_join(F.array_sort(terms), " ").alias("terms"))


@query("f8_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("f10_canonical_url", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(substr(url, length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1), '#.*$', '') AS url FROM pages")
def _(t):
    return t("pages").select("page_id", tx.url_parts(C("url"))[0].alias("url"))


@query("f11_f12_versioned_ids", "SELECT page_id, 'paper:' || substr(sha256(url || chr(0) || 'content-sha256:' || sha256(html)), 1, 20) AS id FROM pages")
def _(t):
    version = tx.version_of(F.lit(None).cast("string"), F.lit(" "), digest=F.sha2("html", 256))
    return t("pages").select("page_id", tx.stable_id(C("url"), version).alias("id"))


@query("f13_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", tx.slug(C("p_name")).alias("slug"))


@query("f16_redaction", "SELECT doc_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(https?://)[^/@ ]+@', '\\1[redacted]@', 'g'), '(Bearer )[A-Za-z0-9._-]+', '\\1[redacted]', 'g'), '((?i:token|password|passwd|api[_-]?key|access[_-]?key|secret|authorization)[\"'']? *[=:] *[\"'']?)[A-Za-z0-9_./+-]{8,}', '\\1[redacted]', 'g'), 'sk-[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), 1, 4000)) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.redacted(C("text"))).alias("h"))


@query("f25_symbol_share", "SELECT doc_id, round(length(regexp_replace(text, '[A-Za-z0-9À-ÿ \\n]', '', 'g')) / nullif(length(text), 0), 6) AS share FROM documents")
def _(t):
    return t("documents").select("doc_id", F.round(tx.symbol_share(C("text")), 6).alias("share"))


@query("f32_digit_signature", "SELECT regexp_replace(replace(lower(url), ' ', ''), '[0-9]+', '#', 'g') AS signature, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return t("pages").groupBy(tx.digit_mask(C("url")).alias("signature")).agg(F.count("*").alias("n"))


@query("f33_token_estimate", "SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.token_estimate(C("text")).alias("tokens"))


@query("f34_json_extract", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, -1) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


WORDS = "regexp_split_to_array(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ')"


@query("c1_sliding_chunks", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, i AS chunk_index, len(w[750 * i + 1:750 * i + 900]) AS n_words, md5(array_to_string(w[750 * i + 1:750 * i + 900], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 900) / 750))::BIGINT)) AS i FROM w)")
def _(t):
    w = t("documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), " ").alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - 900) / 750)).cast("long")
    c = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    part = F.slice("w", (750 * C("chunk_index") + 1).cast("int"), 900)
    return c.select("doc_id", "chunk_index", F.size(part).cast("long").alias("n_words"), F.md5(F.array_join(part, " ")).alias("h"))


@query("c9_line_offsets", "WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, line, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at, length(x) AS n FROM l")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x")).select("doc_id", (C("p") + 1).cast("long").alias("line"), F.length("x").cast("long").alias("n"))
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.select("doc_id", "line", F.coalesce(F.sum(C("n") + 1).over(w), F.lit(0)).alias("start_at"), "n")


@query("c13_interval_verification", "WITH c AS (SELECT doc_id, text, unnest(range(0, 1 + length(text) // 1000)) AS k FROM documents), x AS (SELECT doc_id, k, text, substr(text, 1000 * k + 1, 1000) AS chunk FROM c) SELECT doc_id, k, CASE WHEN (doc_id + k) % 10 = 0 THEN chunk || '.' ELSE chunk END = substr(text, 1000 * k + 1, 1000) AS ok FROM x WHERE chunk <> ''")
def _(t):
    # Chunks are kept with their intervals; every tenth was changed afterwards, and its interval reads otherwise.
    at = lambda k: F.substring("text", (1000 * k + 1).cast("int"), F.lit(1000))
    c = t("documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("text") / 1000))).alias("k")).where(at(C("k")) != "")
    chunk = F.when((C("doc_id") + C("k")) % 10 == 0, F.concat(at(C("k")), F.lit("."))).otherwise(at(C("k")))
    return c.withColumn("chunk", chunk).select("doc_id", "k", (C("chunk") == at(C("k"))).alias("ok"))


@query("d2_duplicate_groups", "WITH RECURSIVE e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id <> b.doc_id), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def _(t):
    h = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return ops.connected(h.join(first, "h").select(C("doc_id").alias("a"), "b"))


@query("d4_idempotent_commands", "SELECT user_id, event_type, CASE WHEN count(DISTINCT props) = 1 THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    g = t("events").groupBy("user_id", "event_type").agg(F.countDistinct("props").alias("d"), F.count("*").alias("n")).where("n > 1")
    return g.select("user_id", "event_type", F.when(C("d") == 1, "replay").otherwise("conflict").alias("outcome"), "n")


@query("d7_supersession", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events")
def _(t):
    return t("events").select("event_id", F.lead("event_id").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("superseded_by"))


@query("d16_version_chain", "SELECT o_orderkey, row_number() OVER w AS version, lag(o_orderkey) OVER w AS supersedes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("version"), F.lag("o_orderkey").over(w).alias("supersedes"))


@query("g1_knowledge_map", "WITH e AS (SELECT l_partkey AS p, l_suppkey AS s, count(DISTINCT l_orderkey) AS w FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'ring') GROUP BY 1, 2), d AS (SELECT id, count(*) AS degree, sum(w)::BIGINT AS weight FROM (SELECT 'p' || p AS id, w FROM e UNION ALL SELECT 's' || s, w FROM e) GROUP BY 1), n AS (SELECT count(*) AS total FROM d) SELECT id, degree, weight, total, total > 50 AS truncated FROM d, n ORDER BY weight DESC, degree DESC, id LIMIT 50")
def _(t):
    # Nodes whose name answers the question with their neighbours, the heaviest fifty of them, and how many there are.
    asked = t("part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select(C("p_partkey").alias("l_partkey"))
    e = t("lineitem").join(asked, "l_partkey", "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("w"))
    ends = e.select(F.concat(F.lit("p"), "l_partkey").alias("id"), "w").union(e.select(F.concat(F.lit("s"), "l_suppkey"), "w"))
    nodes = ops.settled(ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("w").alias("weight")))
    total = nodes.agg(F.count("*").alias("total"))  # one row
    top = nodes.orderBy(C("weight").desc(), C("degree").desc(), "id").limit(50)
    return top.crossJoin(F.broadcast(total)).select("id", "degree", "weight", "total", (C("total") > 50).alias("truncated"))


@query("g2_derived_edges", "SELECT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def _(t):
    # Lines are dealt by order and pairs by their ends, to as many tasks as the lines ask for; the count comes from the files' footers.
    n = t("lineitem").count()
    li = ops.spread(t("lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], n).distinct()
    pair = li.withColumnRenamed("l_partkey", "a").join(li.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b")
    return ops.spread(pair.select("a", "b"), ["a", "b"], 2 * n).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("g4_source_drilldown", "SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k <= 5")
def _(t):
    n = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return ops.first_per(n, ["l_suppkey"], [C("n").desc(), C("l_partkey")], 5)
