"""Predicates, joins, paging and set operations of the survey's groups P, J, T and U that the other plans don't have."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import relational as ops
from tessera.registry import query

C = F.col


@query("p5_status_sets", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS live FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def _(t):
    return t("orders").where(~C("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", C("o_orderstatus").isin("F", "O").alias("live"))


@query("p6_like", "SELECT p_partkey FROM part WHERE p_name LIKE 's%' OR p_name LIKE '%ring%'")
def _(t):
    return t("part").where(C("p_name").like("s%") | C("p_name").like("%ring%")).select("p_partkey")


@query("p7_nullable_parameter", "SELECT c_custkey FROM customer WHERE (NULL IS NULL OR c_mktsegment = NULL) AND c_nationkey = 3")
def _(t):
    given = {"c_mktsegment": None, "c_nationkey": 3}
    cond = F.lit(True)
    for name, value in given.items():
        cond = cond if value is None else cond & (C(name) == value)
    return t("customer").where(cond).select("c_custkey")


@query("p9_p10_overlaps", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10) < least(l_quantity + 5, 20) AS half_open, l_quantity <= 20 AND l_quantity + 5 >= 10 AS inclusive, l_quantity >= 10 AND l_quantity + 5 <= 20 AS contained FROM lineitem")
def _(t):
    start, end = C("l_quantity"), C("l_quantity") + 5
    half = F.greatest(start, F.lit(10.0)) < F.least(end, F.lit(20.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", half.alias("half_open"), ((start <= 20) & (end >= 10)).alias("inclusive"), ((start >= 10) & (end <= 20)).alias("contained"))


@query("p11_p12_p17_text_integrity", "SELECT doc_id, length(text) = n_chars AND text <> '' AS whole, contains(lower(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), trim(lower(regexp_replace(substr(text, 5, 30), '[ \\t\\n\\r\\f]+', ' ', 'g')))) AS quoted, regexp_matches(text, '^\\s*(references|bibliography|REFERENCES|BIBLIOGRAPHY|References|Bibliography)\\b') AS listing FROM documents")
def _(t):
    flat = lambda x: F.lower(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))
    quote = F.trim(flat(F.substring("text", 5, 30)))
    listing = C("text").rlike(r"^\s*(references|bibliography|REFERENCES|BIBLIOGRAPHY|References|Bibliography)\b")
    return t("documents").select("doc_id", ((F.length("text") == C("n_chars")) & (C("text") != "")).alias("whole"), F.contains(flat(C("text")), quote).alias("quoted"), listing.alias("listing"))


@query("p13_strict_threshold", "SELECT event_id FROM events WHERE value > 50")
def _(t):
    return t("events").where("value > 50").select("event_id")


@query("p16_meaningful_names", "SELECT p_partkey FROM part WHERE length(p_name) >= 3 AND NOT regexp_full_match(p_name, '[0-9]+') AND p_name NOT IN ('small ring', 'thing')")
def _(t):
    name = C("p_name")
    return t("part").where((F.length(name) >= 3) & ~name.rlike("^[0-9]+$") & ~name.isin("small ring", "thing")).select("p_partkey")


MOVES = [("view", "click"), ("click", "purchase"), ("error", "view")]


@query("p20_transition_guard", "SELECT event_id, (old, event_type) IN (('view', 'click'), ('click', 'purchase'), ('error', 'view')) AS allowed FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL")
def _(t):
    e = t("events").select("event_id", "event_type", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("old")).where("old IS NOT NULL")
    allowed = F.lit(False)
    for old, new in MOVES:
        allowed = allowed | ((C("old") == old) & (C("event_type") == new))
    return e.select("event_id", allowed.alias("allowed"))


@query("p21_p23_revisions", "SELECT o_orderkey, o_orderkey % 20 = n AS applies, o_orderkey % 20 <> n AS stale FROM orders JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) ON c = o_custkey")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    now = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    expected = C("o_orderkey") % 20
    return o.join(now, "o_custkey").select("o_orderkey", (expected == C("n")).alias("applies"), (expected != C("n")).alias("stale"))


@query("p22_j19_fence", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey) IN (SELECT (l_orderkey, l_partkey, l_suppkey) FROM lineitem WHERE l_discount > 0.05)")
def _(t):
    li, keys = t("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    return li.join(li.where("l_discount > 0.05").select(*keys), keys, "left_semi").select("l_orderkey", "l_linenumber")


@query("j7_discriminated", "SELECT event_id, coalesce(p_name, s_name, 'none') AS resource FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) LEFT JOIN part ON event_type = 'purchase' AND p_partkey = k LEFT JOIN supplier ON event_type = 'error' AND s_suppkey = k")
def _(t):
    e = t("events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.join(t("part"), (C("event_type") == "purchase") & (C("p_partkey") == C("k")), "left")
    e = e.join(t("supplier"), (C("event_type") == "error") & (C("s_suppkey") == C("k")), "left")
    return e.select("event_id", F.coalesce("p_name", "s_name", F.lit("none")).alias("resource"))


@query("j9_j11_one_hop", "SELECT DISTINCT n_name, s_name, p_name FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'ring') OR contains(lower(n_name), 'a')")
def _(t):
    edges = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    x = edges.join(t("supplier"), C("l_suppkey") == C("s_suppkey")).join(t("nation"), C("s_nationkey") == C("n_nationkey")).join(t("part"), C("l_partkey") == C("p_partkey"))
    return x.where(F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("n_name"), F.lit("a"))).select("n_name", "s_name", "p_name").distinct()


@query("j13_single_cover", "SELECT doc_id, count(*) AS n_lines, count(DISTINCT b) AS n_blocks FROM (SELECT doc_id, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1) // 500 AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) GROUP BY doc_id")
def _(t):
    lines = t("documents").select("doc_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "x"))
    start = F.sum(F.length("x") + 1).over(W.partitionBy("doc_id").orderBy("i")) - F.length("x") - 1
    lines = lines.select("doc_id", "i", start.alias("ls"), (start + 1).alias("le"))
    blocks = t("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int"))).alias("b"))
    blocks = blocks.select("doc_id", "b", (C("b") * 500).alias("rs"), (C("b") * 500 + 500).alias("re"))
    return ops.overlap_join(lines, blocks, ["doc_id"], 500).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.countDistinct("b").alias("n_blocks"))


@query("j15_tolerance", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 200")
def _(t):
    cell = lambda c: F.floor(c / 200)
    a = t("customer").select("c_custkey", C("c_nationkey").alias("nation"), "c_acctbal", F.explode(F.array(*[cell(C("c_acctbal")) + d for d in (-1, 0, 1)])).alias("cell"))
    b = t("supplier").select("s_suppkey", C("s_nationkey").alias("nation"), "s_acctbal", cell(C("s_acctbal")).alias("cell"))
    return a.join(b, ["nation", "cell"]).where(F.abs(C("c_acctbal") - C("s_acctbal")) <= 200).select("c_custkey", "s_suppkey")


@query("j21_fallback_map", "SELECT l_orderkey, l_linenumber, coalesce(a.p_partkey, b.p_partkey) AS part FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey * 2 LEFT JOIN part b ON b.p_partkey = l_partkey")
def _(t):
    p = t("part").select("p_partkey")
    x = t("lineitem").join(p.withColumnRenamed("p_partkey", "a"), C("l_partkey") * 2 == C("a"), "left").join(p.withColumnRenamed("p_partkey", "b"), C("l_partkey") == C("b"), "left")
    return x.select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("part"))


@query("j23_dispatchable", "SELECT c_nationkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 0 GROUP BY 1")
def _(t):
    x = t("orders").where("o_orderstatus = 'O'").join(t("customer").where("c_acctbal > 0"), C("c_custkey") == C("o_custkey"))
    return x.groupBy("c_nationkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("t3_offset_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, 60 AS next_offset FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    total = t("orders").agg(F.count("*").alias("total"))  # one row
    page = t("orders").orderBy(C("o_totalprice").desc(), "o_orderkey").offset(40).limit(20)
    return page.select("o_orderkey").crossJoin(F.broadcast(total)).withColumn("next_offset", F.lit(60))


@query("t5_t7_forward_page", "SELECT event_id, more FROM (SELECT event_id, count(*) OVER () > 50 AS more, row_number() OVER (ORDER BY event_id) AS k FROM (SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 51)) WHERE k <= 50")
def _(t):
    page = t("events").where("event_id > 100").select("event_id").orderBy("event_id").limit(51)
    more = page.agg((F.count("*") > 50).alias("more"))
    return page.orderBy("event_id").limit(50).crossJoin(F.broadcast(more))


@query("t6_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def _(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(C("p_retailprice").desc(), "p_partkey").limit(25)


@query("t9_partial_reorder", "SELECT n_name, row_number() OVER (ORDER BY coalesce(CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 END, 99), n_nationkey) AS place FROM nation")
def _(t):
    listed = F.coalesce(F.nullif(F.array_position(F.lit([7, 3]), C("n_nationkey").cast("int")), F.lit(0)), F.lit(99))
    return t("nation").select("n_name", F.row_number().over(W.orderBy(listed, "n_nationkey")).cast("long").alias("place"))  # nations: a fixed, small table


@query("t10_nocase_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, lower(c_name), c_custkey LIMIT 30")
def _(t):
    return t("customer").orderBy(C("c_acctbal").desc(), F.lower("c_name"), "c_custkey").limit(30).select("c_custkey", "c_name")


@query("u2_u6_distinct_union", "SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(C("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("u5_ordered_distinct", "SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\n\\r\\t\\f\\v]+') AS w FROM conversations)")
def _(t):
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[^ \\n\\r\\t\\f\\x0B]+"), F.lit(0)))
    return t("conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query("u7_set_equality", "SELECT count(*) = 0 AS equal, count(o_orderkey) AS unmatched_orders, count(l_orderkey) AS unmatched_lines FROM (SELECT o_orderkey, l_orderkey FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey) WHERE o_orderkey IS NULL OR l_orderkey IS NULL")
def _(t):
    both = t("orders").select("o_orderkey").join(t("lineitem").select("l_orderkey").distinct(), C("o_orderkey") == C("l_orderkey"), "full")
    return both.where("o_orderkey IS NULL OR l_orderkey IS NULL").agg((F.count("*") == 0).alias("equal"), F.count("o_orderkey").alias("unmatched_orders"), F.count("l_orderkey").alias("unmatched_lines"))


@query("f5_term_coverage", "WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]{3,}')) AS terms FROM benchmark WHERE item_id % 20 = 0) SELECT item_id, page_id, round(len(list_filter(terms, lambda x: contains(replace(lower(html), 'ß', 'ss'), x))) / len(terms), 9) AS coverage FROM pages, q WHERE len(terms) > 0")
def _(t):
    q = t("benchmark").where("item_id % 20 = 0").select("item_id", tx.query_terms(C("text"), 100_000).alias("terms")).where("size(terms) > 0")
    terms = F.aggregate("terms", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    return ops.against(t("pages").select("page_id", tx.folded(C("html")).alias("html")), q, terms).select("item_id", "page_id", F.round(tx.share_held(C("terms"), C("html")), 9).alias("coverage"))


@query("f6_latin_anchors", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[a-zA-Z][a-zA-Z0-9_-]*'))), ' ') AS anchors FROM pages")
def _(t):
    return t("pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("[a-zA-Z][a-zA-Z0-9_-]*"), F.lit(0)))), " ").alias("anchors"))


@query("f14_file_names", "SELECT page_id, substr(trim(regexp_replace(url, '[<>:\"/\\\\|?*\\n\\r\\t]+', '_', 'g')), 1, 100) AS file_name FROM pages")
def _(t):
    return t("pages").select("page_id", tx.file_name(C("url")).alias("file_name"))


@query("f21_citations", "WITH d AS (SELECT conv_id, turn, 'As [E' || turn || '] and [cite:' || role || '] say, ' || text || ' [E' || (conv_id % 7) || '] [E]' AS x FROM conversations) SELECT conv_id, turn, array_to_string(regexp_extract_all(x, '\\[(E[0-9]+)\\]', 1), ' ') AS numbered, array_to_string(regexp_extract_all(x, '\\[cite:([^\\]]+)\\]', 1), ' ') AS named FROM d")
def _(t):
    x = F.concat(F.lit("As [E"), C("turn").cast("string"), F.lit("] and [cite:"), "role", F.lit("] say, "), "text", F.lit(" [E"), (C("conv_id") % 7).cast("string"), F.lit("] [E]"))
    found = lambda p: F.array_join(F.regexp_extract_all("x", F.lit(p), F.lit(1)), " ")
    return t("conversations").select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", found(r"\[(E[0-9]+)\]").alias("numbered"), found(r"\[cite:([^\]]+)\]").alias("named"))


@query("f22_heading_count", "WITH d AS (SELECT page_id, regexp_replace(regexp_replace(html, '<h1[^>]*>', chr(10) || '# ', 'g'), '<h2[^>]*>', chr(10) || '## ', 'g') AS x FROM pages) SELECT page_id, len(regexp_extract_all(x, '(?m)^##?[ \\t\\n\\f\\r]+[^ \\t\\n\\f\\r]+')) AS headings FROM d")
def _(t):
    x = F.regexp_replace(F.regexp_replace("html", "<h1[^>]*>", "\n# "), "<h2[^>]*>", "\n## ")
    return t("pages").select("page_id", F.regexp_count(x, F.lit(r"(?m)^##?[ \t\n\f\r]+[^ \t\n\f\r]+")).cast("long").alias("headings"))


@query("f9_newline_digest", "SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(F.regexp_replace("text", r"\r\n?", "\n"), 256).alias("h"))


@query("f15_f17_f18_markup", "SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS stripped, md5(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def _(t):
    stripped = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    escaped = C("url")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return t("pages").select("page_id", F.md5(stripped).alias("stripped"), F.md5(escaped).alias("escaped"))


@query("f20_centred_window", "SELECT doc_id, md5(substr(text, greatest(1, n_chars // 2 - 100), 240)) AS h FROM documents")
def _(t):
    at = F.greatest(F.lit(1), F.floor(C("n_chars") / 2) - 100).cast("int")
    return t("documents").select("doc_id", F.md5(F.substring(C("text"), at, F.lit(240))).alias("h"))


@query("f39_f40_vectors", "SELECT e.vec_id, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm, round(log2(1 + e.label), 9) AS discount FROM embeddings e")
def _(t):
    e = C("embedding")
    sq = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return t("embeddings").select("vec_id", F.round(F.sqrt(sq), 6).alias("norm"), F.round(F.log2(1 + C("label")), 9).alias("discount"))
