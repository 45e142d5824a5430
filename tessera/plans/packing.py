"""What follows a ranking: fusion over several queries, neighbours, packing under a budget, scopes and gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import mentions
from tessera.operators import packing as coverage
from tessera.operators import relational as ops
from tessera.operators import retrieval as ret
from tessera.operators import selection
from tessera.plans.retrieval import TOKENS
from tessera.registry import query

C = F.col


def bm25_sql(docs: str, queries: str, limit: int = 40) -> str:
    """BM25 as common table expressions, from relations docs (id, text) and queries (query_id, text)."""
    return f"""
tok AS (SELECT id, {TOKENS.format("text")} AS t FROM ({docs})), st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tok),
qt AS (SELECT DISTINCT query_id, unnest({TOKENS.format("text")}) AS term FROM ({queries})),
po AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY ALL),
fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM po JOIN fr USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {limit})"""


ALL = "SELECT doc_id AS id, text FROM documents"
ITEMS = "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0"


def _docs(t):
    return t("documents").select(C("doc_id").alias("id"), "text")


def _items(t):
    return t("benchmark").where("item_id % 100 = 0").select(C("item_id").alias("query_id"), "text")


@query("r8_multi_query_fusion", f"WITH {bm25_sql(ALL, 'SELECT item_id * 10 + v AS query_id, CASE v WHEN 0 THEN text WHEN 1 THEN left(text, 80) ELSE right(text, 80) END AS text FROM benchmark, (SELECT unnest([0, 1, 2]) AS v) WHERE item_id % 100 = 0')} SELECT query_id // 10 AS item_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM bm GROUP BY 1, 2")
def _(t):
    # Three wordings of each question, each with its own ranks.
    wording = F.explode(F.array(F.struct(F.lit(0).alias("v"), C("text").alias("x")), F.struct(F.lit(1).alias("v"), F.left("text", F.lit(80)).alias("x")), F.struct(F.lit(2).alias("v"), F.right("text", F.lit(80)).alias("x"))))
    q = _items(t).select("query_id", wording.alias("w")).select((C("query_id") * 10 + C("w.v")).alias("query_id"), C("w.x").alias("text"))
    ranks = ret.bm25(_docs(t), q)
    fused = ret.fused(ranks.select(F.floor(C("query_id") / 10).alias("query_id"), (C("query_id") % 10).alias("channel"), C("rank").alias("pos"), "id"))
    return fused.select(C("query_id").alias("item_id"), "id", "score")


def expanded(ranked, before: str, after: str, anchors: int = 10):
    """(query_id, id, place, group): each of the first anchors not yet out is followed by its neighbours not yet out; others follow by rank.

    Ranked is (query_id, id, rank, before, after), a bounded list for each query. A neighbour that is out doesn't expand again.
    """
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", C(before).alias("b"), C(after).alias("a")))).alias("r"))
    kind = "array<struct<id:bigint,g:bigint>>"

    def step(out: Column, x: Column) -> Column:
        has = lambda i: F.exists(out, lambda o: o["id"] == i)
        near = F.filter(F.array_distinct(F.array(x["b"], x["a"])), lambda i: i.isNotNull() & ~has(i) & (i != x["id"]))
        group = F.concat(F.array(x["id"]), F.when(x["rank"] <= anchors, near).otherwise(F.array().cast("array<bigint>")))
        return F.when(has(x["id"]), out).otherwise(F.concat(out, F.transform(group, lambda i: F.struct(i.alias("id"), x["rank"].cast("long").alias("g"))).cast(kind)))

    out = rows.select("query_id", F.posexplode(F.aggregate("r", F.array().cast(kind), step)).alias("place", "x"))
    return out.select("query_id", C("x.id").alias("id"), C("place").cast("long").alias("place"), C("x.g").alias("anchor_rank"))


@query("r10_adjacent_expansion")
def _(t):
    # Texts of one source touch where their ids follow one another.
    ids = t("documents").select(C("doc_id").alias("id"), "source")
    side = lambda d, name: ids.select((C("id") - d).alias("id"), "source", C("id").alias(name))
    ranked = ret.bm25(_docs(t), _items(t)).join(ids, "id").join(side(-1, "before"), ["id", "source"], "left").join(side(1, "after"), ["id", "source"], "left")
    return expanded(ranked.select("query_id", "id", C("rank").cast("long").alias("rank"), "before", "after"), "before", "after")


def _choice(t):
    """What is chosen for each question, and its candidates."""
    # Questions with their sentences as parts. Anchors are the sentence's three best documents; a source counts where the text has the sentence's
    # first words verbatim. Neighbours of a document's source come with it, the source is a shared entry, and every eleventh candidate is pinned.
    q = t("benchmark").select(C("item_id").alias("query_id"), "text")
    d = t("documents").select(C("doc_id").alias("id"), "source", "n_chars", "text")
    sentence = q.select("query_id", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")).alias("part", "s"))
    # Questions (even ids) and their sentences (odd ones) are ranked together, so the texts are read once.
    asked = q.select((C("query_id") * 2).alias("query_id"), "text").unionByName(sentence.select(((C("query_id") * 1000 + C("part")) * 2 + 1).alias("query_id"), C("s").alias("text")))
    both = ops.settled(ret.bm25(_docs(t), asked))
    ranked = both.where("query_id % 2 = 0").select(F.expr("query_id div 2").alias("query_id"), "id", "rank")
    best = both.where("query_id % 2 <> 0 AND rank <= 3").select(F.expr("query_id div 2").alias("query_id"), "id", "rank")
    best = best.select(F.expr("query_id div 1000").alias("query_id"), (C("query_id") % 1000).cast("int").alias("part"), "id", "rank")
    # What the questions rank goes to the documents, so that no text is shuffled.
    best = ops.settled(best.join(sentence, ["query_id", "part"]))
    anchors = d.select("id", "source", "text").join(ops.sent(best), "id")
    held = F.contains("text", F.concat_ws(" ", F.slice(F.split("s", " "), 1, 4)))
    sources = F.when(held, F.array("source")).otherwise(F.array().cast("array<string>"))
    anchors = ops.settled(anchors.select("query_id", "part", C("rank").cast("int").alias("place"), "id", sources.alias("sources")))
    entry = F.struct(F.lit("sources").alias("table"), C("source").alias("item"), (F.length("source") + 40).cast("long").alias("chars"))
    cost = d.select("id", "source", C("n_chars").alias("chars"), F.array(entry).alias("entries"))
    both = ranked.select("query_id", "id", C("rank").cast("long").alias("rank")).unionByName(anchors.select("query_id", "id", F.lit(1000).cast("long").alias("rank")))
    candidates = ops.settled(cost.join(ops.sent(ops.settled(both.groupBy("query_id", "id").agg(F.min("rank").alias("rank")))), "id").select("query_id", "id", "rank", "source", "chars", "entries"))
    near = candidates.select("query_id", (C("id") - 1).alias("id"), "source", C("id").alias("next"))
    groups = candidates.join(near, ["query_id", "id", "source"]).select("query_id", "id", F.array("next").alias("members"))
    named = anchors.select("query_id", "part", F.explode("sources").alias("source")).distinct().select("query_id", "part", F.lit(0).alias("place"), "source")
    pins = candidates.where("id % 11 = 0").select("query_id", C("rank").alias("place"), "id")
    return coverage.pack(candidates.drop("source"), groups, anchors, named, pins, 4000, 100), candidates


@query("r12_r13_packing")
def _(t):
    return coverage.reading_order(_choice(t)[0])


@query("r20_packing_audit")
def _(t):
    choice, candidates = _choice(t)
    return coverage.audit(ops.settled(choice), candidates)


#: A document's title is its first sentence; a question compares it with that of the next document of its language, in four ways.
ASKED = """
d AS (SELECT doc_id, lang, source, trim(regexp_extract(text, '^[^.\\n]*')) AS title FROM documents),
n AS (SELECT doc_id, title AS a, lead(title) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM d),
q AS (SELECT doc_id, lower(trim(regexp_replace(replace(CASE doc_id % 4 WHEN 0 THEN 'Compare ' || a || ' with ' || b WHEN 1 THEN 'Do not compare ' || a || ' with ' || b WHEN 2 THEN a || ' versus ' || b || ', respectively' ELSE a || ' and ' || b END, 'ß', 'ss'), '[ \\t\\r\\f]+', ' ', 'g'))) AS q FROM n WHERE b IS NOT NULL),
t AS (SELECT title, min(source) AS source, count(*) AS shared FROM (SELECT DISTINCT lower(trim(regexp_replace(replace(title, 'ß', 'ss'), '[ \\t\\r\\f]+', ' ', 'g'))) AS title, source FROM d) WHERE length(title) >= 4 GROUP BY 1),
m AS (SELECT doc_id, q, title, source, shared, unnest(range(1, length(q) + 1)) AS p FROM q JOIN t ON contains(q, title) WHERE regexp_matches(q, '\\b(compare|comparison|contrast|versus|vs|differences?|respectively|separately)\\b') AND NOT regexp_matches(q, '\\b(no|not|without)\\b')),
h AS (SELECT doc_id, p, p + length(title) AS e, source, shared FROM m WHERE substr(q, p, length(title)) = title AND NOT (p > 1 AND regexp_matches(substr(q, p - 1, 2), '^[a-z0-9_]{2}$')) AND NOT regexp_matches(substr(q, p + length(title) - 1, 2), '^[a-z0-9_]{2}$')),
c AS (SELECT *, p < lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY p, e) AS clash FROM h),
s AS (SELECT doc_id, source, min(p) AS p, bool_or(clash) AS clash, max(shared) AS shared FROM c GROUP BY 1, 2)"""


@query("r14_named_comparison", f"WITH {ASKED} SELECT doc_id, string_agg(source, ',' ORDER BY p) AS sources FROM s GROUP BY 1 HAVING NOT bool_or(clash) AND max(shared) = 1 AND count(*) > 1")
def _(t):
    d = t("documents").select("doc_id", "lang", "source", F.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("a"))
    k, b = C("doc_id") % 4, F.lead("a").over(W.partitionBy("lang").orderBy("doc_id"))
    q = F.when(k == 0, F.concat(F.lit("Compare "), "a", F.lit(" with "), "b")).when(k == 1, F.concat(F.lit("Do not compare "), "a", F.lit(" with "), "b")).when(k == 2, F.concat("a", F.lit(" versus "), "b", F.lit(", respectively"))).otherwise(F.concat_ws(" and ", "a", "b"))
    asked = d.withColumn("b", b).where("b IS NOT NULL").select(C("doc_id").alias("question"), q.alias("text"))
    out = mentions.compared_sources(asked, d.select("source", C("a").alias("title")))
    return out.select(C("question").alias("doc_id"), F.array_join("sources", ",").alias("sources"))


@query("r15_coverage_order", f"WITH {bm25_sql(ALL, 'SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0', 3)}, f AS (SELECT id, min((rank, query_id)) AS k FROM bm GROUP BY 1) SELECT id, k[1]::BIGINT AS round, k[2] AS part FROM f")
def _(t):
    # Anchors breadth first over the parts: all first ones, then all second ones; a candidate counts where it comes first.
    parts = t("benchmark").where("item_id % 20 = 0").select(C("item_id").alias("query_id"), "text")
    best = ret.bm25(_docs(t), parts, limit=3).groupBy("id").agg(F.min(F.struct("rank", "query_id")).alias("k"))
    return best.select("id", C("k.rank").cast("long").alias("round"), C("k.query_id").alias("part"))


@query("r18_authorised_scope", "SELECT source, count(*) AS allowed, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND source <> 'src1' GROUP BY 1")
def _(t):
    ok = t("labels").where("quality = 1").select("doc_id")
    h = F.conv(F.substring(F.sha2(C("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return t("documents").where("source <> 'src1'").join(ok, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("allowed"), F.sum(h).alias("fingerprint"))


@query("r22_gap_evidence", f"WITH {bm25_sql('SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)', ITEMS, 5)} SELECT query_id, id, rank FROM bm")
def _(t):
    pending = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select(C("doc_id").alias("id"), "text")
    return ret.bm25(pending, _items(t), limit=5).select("query_id", "id", C("rank").cast("long").alias("rank"))


@query("r23_profile", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'classic' WHEN value < 10 THEN 'classic' ELSE 'standard' END AS profile, CASE WHEN event_type = 'error' THEN 'index_missing' WHEN value < 10 THEN 'scope_too_small' END AS reason FROM events")
def _(t):
    bad, small = C("event_type") == "error", C("value") < 10
    return t("events").select("event_id", F.when(bad | small, "classic").otherwise("standard").alias("profile"), F.when(bad, "index_missing").when(small, "scope_too_small").alias("reason"))


def batched(sizes, limit: int):
    """(key, pos, batch) of sizes (key, pos, size): neighbours share a batch while they fit into the limit; a larger one is alone."""

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + x["size"] <= limit)
        batch = F.when(fits | (acc["used"] == 0), acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"]).otherwise(F.lit(0)) + x["size"]
        return F.struct(batch.cast("long").alias("batch"), used.cast("long").alias("used"), F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), batch.cast("long").alias("batch")))).alias("out"))

    rows = sizes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(C("pos").cast("long").alias("pos"), C("size").cast("long").alias("size")))).alias("r"))
    first = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,batch:bigint>>").alias("out"))
    return rows.select("key", F.explode(F.aggregate("r", first, step, lambda a: a["out"])).alias("x")).select("key", "x.*")


@query("w16_running_batches")
def _(t):
    return batched(t("conversations").select(C("conv_id").alias("key"), C("turn").alias("pos"), F.greatest(F.length("text"), F.lit(1)).alias("size")), 600)


@query("t1_mixed_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 100")
def _(t):
    top = t("orders").orderBy("o_orderpriority", C("o_totalprice").desc(), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(W.orderBy("o_orderpriority", C("o_totalprice").desc(), "o_orderkey")).cast("long").alias("k"))


@query("g5_pending_overlay", "SELECT DISTINCT l_partkey AS node, l_suppkey AS other, 'published' AS state FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 'pending' FROM lineitem WHERE l_returnflag = 'N' AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag <> 'N')")
def _(t):
    edges = t("lineitem").select(C("l_partkey").alias("node"), C("l_suppkey").alias("other"), (C("l_returnflag") != "N").alias("out"))
    return edges.groupBy("node", "other").agg(F.bool_or("out").alias("out")).select("node", "other", F.when(C("out"), "published").otherwise("pending").alias("state"))


def _lines(t):
    """Lines (g, a, b, conf, pri, id) of a year's orders: parts and suppliers by name of kind and key."""
    line = t("lineitem").select(F.year("l_shipdate").alias("g"), "l_partkey", "l_suppkey", F.round(C("l_quantity") / 50, 2).alias("conf"), F.ascii("l_returnflag").alias("pri"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"))
    return line.select("g", F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("b"), "conf", "pri", "id")


def _pairs(lines):
    return lines.groupBy("g", "a", "b", "id").agg(F.max("conf").alias("conf"), F.min("pri").alias("pri"))


def _canvas(t):
    """Nodes (g, node, type, name, degree), pairs (g, a, b, conf, pri, id) and (node, type, name) of a year's orders: parts and suppliers, each line a pair."""
    # Lines are dealt by their ids; the count comes from the files' footers.
    line = _pairs(ops.spread(_lines(t), ["id"], t("lineitem").count()))
    named = t("part").select(F.concat(F.lit("p"), C("p_partkey").cast("string")).alias("node"), C("p_type").alias("type"), C("p_name").alias("name"))
    named = named.unionByName(t("supplier").select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("node"), F.lit("SUPPLIER").alias("type"), C("s_name").alias("name")))
    degree = line.select("g", F.explode(F.array("a", "b")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("degree"))
    return degree.join(named, "node").select("g", "node", "type", "name", "degree"), line, named


LIMITS, FILL, MOST = {"SUPPLIER": 6, "ECONOMY": 4, "STANDARD": 3}, ["SUPPLIER", "ECONOMY", "STANDARD"], 12


def _ranked():
    return [(-C("conf")).alias("c"), C("pri"), C("id"), C("a"), C("b")]


CANVAS = """
WITH RECURSIVE l AS (SELECT year(l_shipdate) AS g, 'p' || l_partkey AS a, 's' || l_suppkey AS b, l_orderkey * 10 + l_linenumber AS id, max(round(l_quantity / 50, 2)) AS conf, min(ascii(l_returnflag)) AS pri FROM lineitem GROUP BY ALL),
k AS (SELECT 'p' || p_partkey AS node, p_type AS type, p_name AS name FROM part UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER', s_name FROM supplier),
n AS (SELECT g, node, type, name, count(*) AS degree FROM (SELECT g, unnest([a, b]) AS node FROM l) JOIN k USING (node) GROUP BY ALL),
e AS (SELECT l.g, l.a, l.b, x.type AS ta, y.type AS tb, conf, pri, id, row_number() OVER (PARTITION BY l.g ORDER BY conf DESC, pri, id, l.a, l.b) AS o FROM l JOIN k x ON x.node = l.a JOIN k y ON y.node = l.b),
m AS (SELECT 'SUPPLIER' AS type, 6 AS lim UNION ALL SELECT 'ECONOMY', 4 UNION ALL SELECT 'STANDARD', 3),
r AS (SELECT DISTINCT g, 0 AS i, []::STRUCT(node VARCHAR, type VARCHAR)[] AS ins FROM l
UNION ALL SELECT g, i + 1, list_concat(ins, new) FROM (SELECT r.g, i, ins, arg_min(list_filter([{'node': a, 'type': ta}, {'node': b, 'type': tb}], lambda z: NOT list_contains(ins, z)), o) AS new FROM r JOIN e ON e.g = r.g
  WHERE NOT (list_contains(ins, {'node': a, 'type': ta}) AND list_contains(ins, {'node': b, 'type': tb}))
    AND len(ins) + (NOT list_contains(ins, {'node': a, 'type': ta}))::INT + (NOT list_contains(ins, {'node': b, 'type': tb}))::INT <= 12
    AND (list_contains(ins, {'node': a, 'type': ta}) OR len(list_filter(ins, lambda z: z.type = ta)) < CASE ta WHEN 'ECONOMY' THEN 4 WHEN 'STANDARD' THEN 3 ELSE 1 END)
    AND (list_contains(ins, {'node': b, 'type': tb}) OR len(list_filter(ins, lambda z: z.type = tb)) < 6) GROUP BY r.g, i, ins)),
s AS (SELECT g, unnest(ins) AS z FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
p AS (SELECT g, z.node AS node, z.type AS type FROM s),
f AS (SELECT g, node, type, row_number() OVER (PARTITION BY g, type ORDER BY degree DESC, lower(name), node) AS r FROM n JOIN m USING (type) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = n.g AND p.node = n.node)),
c AS (SELECT g, node, type, 'pair' AS via FROM p UNION ALL SELECT f.g, f.node, f.type, 'fill' FROM f JOIN m USING (type) LEFT JOIN (SELECT g, type, count(*) AS had FROM p GROUP BY ALL) h ON h.g = f.g AND h.type = f.type WHERE r + coalesce(had, 0) <= lim)
"""


@query("g6_canvas_selection", f"{CANVAS} SELECT * FROM c")
def _(t):
    nodes, pairs, named = _canvas(t)
    return selection.capped_nodes(nodes, pairs, _ranked(), MOST, LIMITS, FILL, kinds=named)


@query("g7_canvas_edges", f"""{CANVAS},
h AS (SELECT e.*, row_number() OVER (PARTITION BY e.g ORDER BY o) AS i FROM e JOIN c x ON x.g = e.g AND x.node = e.a JOIN c y ON y.g = e.g AND y.node = e.b WHERE conf >= 0.65),
w AS (SELECT DISTINCT g, 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::BIGINT AS id, NULL::VARCHAR AS a, NULL::VARCHAR AS b, false AS ok FROM h
UNION ALL SELECT w.g, h.i, CASE WHEN t.ok THEN list_concat(used, [h.a, h.b]) ELSE used END, h.id, h.a, h.b, t.ok FROM w JOIN h ON h.g = w.g AND h.i = w.i + 1, LATERAL (SELECT len(list_filter(used, lambda z: z = h.a)) < 3 AND len(list_filter(used, lambda z: z = h.b)) < 3 AS ok) t),
v AS (SELECT c.g, c.node, 50 + 148 * (row_number() OVER (PARTITION BY c.g, c.type = 'SUPPLIER' ORDER BY degree DESC, lower(name), c.node) - 1) AS y, CASE c.type WHEN 'SUPPLIER' THEN 460 ELSE 0 END AS x FROM c JOIN n USING (g, node)),
d AS (SELECT w.g, id, w.a, w.b, q.x - p.x AS dx, q.y - p.y AS dy FROM w JOIN v p ON p.g = w.g AND p.node = w.a JOIN v q ON q.g = w.g AND q.node = w.b WHERE ok QUALIFY row_number() OVER (PARTITION BY w.g ORDER BY i) <= 18)
SELECT g, id, a, b, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'right' ELSE 'left' END WHEN dy >= 0 THEN 'bottom' ELSE 'top' END AS from_side, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'left' ELSE 'right' END WHEN dy >= 0 THEN 'top' ELSE 'bottom' END AS to_side FROM d
""")
def _(t):
    # Edges among what the canvas shows; parts in one lane, suppliers in the other, by degree from the top.
    nodes, pairs, named = _canvas(t)
    shown = ops.settled(selection.capped_nodes(nodes, pairs, _ranked(), MOST, LIMITS, FILL, kinds=named))
    # Lines of nodes that aren't shown go before lines are brought together.
    end = lambda name: ops.sent(shown.select("g", C("node").alias(name)))
    among = ops.settled(_pairs(_lines(t).join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"])).where("conf >= 0.65"))
    ends = _lines(t).select("g", "a", "b", "id", F.explode(F.array("a", "b")).alias("node")).join(end("node"), ["g", "node"])
    degree = ends.distinct().groupBy("g", "node").agg(F.count("*").alias("degree"))
    edges = selection.first_edges(selection.capped_edges(among, _ranked(), 3), _ranked(), 18)
    lane = (C("type") == "SUPPLIER").cast("int")
    at = ops.settled(named.drop("type").join(ops.sent(shown), "node").join(degree, ["g", "node"]).withColumn("lane", lane))
    y = F.row_number().over(W.partitionBy("g", "lane").orderBy(C("degree").desc(), F.lower("name"), "node")) * 148
    at = at.select("g", "node", (C("lane") * 460).alias("x"), y.alias("y"))
    side = lambda end, x, y: at.select("g", C("node").alias(end), C("x").alias(x), C("y").alias(y))
    placed = edges.join(side("a", "x0", "y0"), ["g", "a"]).join(side("b", "x1", "y1"), ["g", "b"])
    return placed.select("g", "id", "a", "b", selection.edge_sides(C("x1") - C("x0"), C("y1") - C("y0")).alias("s")).select("g", "id", "a", "b", "s.*")


@query("g7_edge_selection")
def _(t):
    # All parts and suppliers as one collection: no node has more than three edges, and the edges are those of the sequential choice.
    e = t("lineitem").groupBy(C("l_partkey").alias("a"), C("l_suppkey").alias("b")).agg(F.round(F.avg("l_discount") * 10, 6).alias("conf")).where("conf >= 0.65")
    e = e.select(F.lit(0).alias("g"), (2 * C("a")).alias("a"), (2 * C("b") + 1).alias("b"), "conf")
    return selection.capped_edges(e, [(-C("conf")).alias("c"), C("a"), C("b")], 3).select(F.expr("a div 2").alias("a"), F.expr("b div 2").alias("b"), "conf")

