"""Retrieval queries: BM25, fusion, hash embeddings, dense search, hybrid and evidence selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import relational as ops
from tessera.operators import retrieval as ret
from tessera.registry import query

C = F.col

TOKENS = "list_concat(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda w: contains(w, '-') OR contains(w, '_')), lambda w: regexp_replace(w, '[-_]', '', 'g')), flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda w: regexp_split_to_array(w, '[-_]'))))"
BM25 = f"""
tok AS (SELECT doc_id AS id, {TOKENS.format("text")} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark WHERE item_id % 100 = 0),
po AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY ALL),
fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM po JOIN fr USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 40)"""
DENSE = """
dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 40),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn)"""
#: Hash embeddings of the documents against those of the questions.
SPARSE = f"""
hx AS (SELECT id, kind, unnest(t) AS w FROM (SELECT doc_id AS id, 'd' AS kind, {TOKENS.format("text")} AS t FROM documents UNION ALL SELECT item_id, 'q', {TOKENS.format("text")} FROM benchmark WHERE item_id % 100 = 0)),
hs AS (SELECT id, kind, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 384 AS idx, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM hx GROUP BY 1, 2, 3 HAVING s <> 0),
hv AS (SELECT id, kind, idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY id, kind)), 6) AS value FROM hs),
dn AS (SELECT q.id AS query_id, v.id, round(sum(q.value * v.value), 6) AS score FROM hv v JOIN hv q USING (idx) WHERE q.kind = 'q' AND v.kind = 'd' GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn WHERE score > 0 QUALIFY rank <= 40)"""
FUSED = "fu AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM dr) GROUP BY 1, 2)"


#: The same for all questions.
EVERY = f"{BM25}, {SPARSE}".replace(" WHERE item_id % 100 = 0", "")


def _every(t):
    return t("benchmark").select(C("item_id").alias("query_id"), "text")


def _questions(t):
    return _every(t).where("query_id % 100 = 0")


def _bm25(t, questions):
    return ret.bm25(t("documents").select(C("doc_id").alias("id"), "text"), questions)


def _sparse(t, questions, limit: int):
    return ret.hash_search(t("documents").select(C("doc_id").alias("id"), "text"), questions, limit)


def _dense(t):
    v = t("embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector"))
    return ret.dense(v, v.where("id % 100 = 0").select(C("id").alias("query_id"), "vector"))


def _fused(t, questions):
    """Two rankings of the documents for the same questions, by words and by hash embeddings."""
    both = _bm25(t, questions).select("query_id", F.lit("bm25").alias("channel"), C("rank").alias("pos"), "id")
    return ret.fused(both.unionByName(_sparse(t, questions, 40).select("query_id", F.lit("dense").alias("channel"), C("rank").alias("pos"), "id")))


@query("r1_bm25", f"WITH {BM25} SELECT query_id, id, score, rank FROM bm")
def _(t):
    return _bm25(t, _questions(t)).select("query_id", "id", "score", C("rank").cast("long").alias("rank"))


@query("r2_reciprocal_rank_fusion", f"WITH {EVERY}, {FUSED} SELECT * FROM fu")
def _(t):
    return _fused(t, _every(t))


@query("r3_hash_embedding", f"WITH t AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS w FROM documents), s AS (SELECT id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 384 AS idx, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t GROUP BY 1, 2 HAVING s <> 0) SELECT id, idx::INTEGER AS idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS value FROM s")
def _(t):
    return ret.hash_embedding(t("documents").select(C("doc_id").alias("id"), "text"))


@query("r4_dense_search", f"WITH {DENSE} SELECT query_id, id, score, rank FROM dr")
def _(t):
    return _dense(t).select("query_id", "id", "score", C("rank").cast("long").alias("rank"))


@query("r5_sparse_search", f"WITH {SPARSE} SELECT query_id, id, score FROM dr WHERE rank <= 10")
def _(t):
    return _sparse(t, _questions(t), 10).select("query_id", "id", "score")


R6 = "least(greatest({0}, 0), 1)"


@query("r6_weighted_ranking", f"WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 - 0.2 AS lex, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 10 END AS sem, l_tax * 10 AS ent, CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 0.0 END AS gra, CASE WHEN l_linestatus = 'O' THEN l_discount * 9 END AS con, l_linenumber AS evi FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest({R6.format('lex')}, {R6.format('coalesce(sem, 0)')}, {R6.format('ent')}) > 0 THEN least(1.0, 0.35 * {R6.format('lex')} + 0.25 * {R6.format('coalesce(sem, 0)')} + 0.2 * greatest({R6.format('ent')}, gra) + 0.1 * coalesce(con, 0.5) + 0.1 * least(1.0, evi / 2)) ELSE 0 END, 6) AS score FROM c")
def _(t):
    # Six channels, two of them with nulls, out of range values on both sides.
    channels = (C("l_quantity") / 50 - 0.2, F.when(C("l_linenumber") % 3 != 0, C("l_discount") * 10), C("l_tax") * 10, F.when(C("l_returnflag") == "R", 0.9).otherwise(0.0), F.when(C("l_linestatus") == "O", C("l_discount") * 9), C("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(ret.weighted(*channels), 6).alias("score"))


@query("r7_hybrid_retrieval", f"WITH {BM25}, {SPARSE}, {FUSED}, ca AS (SELECT query_id, id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS k FROM fu JOIN documents ON doc_id = id) SELECT query_id, id, source, score FROM ca WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def _(t):
    x = _fused(t, _questions(t)).join(t("documents").select(C("doc_id").alias("id"), "source"), "id")
    order = [C("score").desc(), C("id")]
    return ops.first_per(ops.first_per(x, ["query_id", "source"], order, 2), ["query_id"], order, 10).select("query_id", "id", "source", "score")


TERMS = "list_slice(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]{3,}')), 1, 100000)"


@query("r9_evidence_selection", f"WITH q AS (SELECT item_id, {TERMS} AS terms FROM benchmark WHERE item_id % 20 = 0), s AS (SELECT item_id, doc_id, source, len(list_filter(terms, lambda x: contains(replace(lower(d.text), 'ß', 'ss'), x))) / len(terms) AS cov FROM (SELECT * FROM documents WHERE NOT regexp_matches(text, '(?i)^\\s*(references|bibliography)')) d, q WHERE len(terms) > 0) SELECT item_id, doc_id, source, round(0.25 * cov, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY round(0.25 * cov, 6) DESC, doc_id) <= 2")
def _(t):
    q = t("benchmark").where("item_id % 20 = 0").select("item_id", tx.query_terms(C("text"), 100_000).alias("terms")).where("size(terms) > 0")
    d = t("documents").where(~C("text").rlike(r"(?i)^\s*(references|bibliography)"))
    d = d.select("doc_id", "source", tx.folded(C("text")).alias("text"))
    s = ret.covered(d, q, "text").select("item_id", "doc_id", "source", F.round(0.25 * C("held"), 6).alias("score"))
    return ops.first_per(s, ["item_id", "source"], [C("score").desc(), C("doc_id")], 2)


@query("r11_budget_trim", "SELECT doc_id, source, used FROM (SELECT doc_id, source, sum(greatest(1, (n_chars + 3) // 4)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 20000")
def _(t):
    cost = F.greatest(F.lit(1), F.floor((C("n_chars") + 3) / 4)).cast("long")
    used = ops.running_sum(t("documents").select("doc_id", "source", "n_chars"), ["source"], -F.floor(C("n_chars") / 50), [C("n_chars").desc(), C("doc_id")], cost, "used")
    return used.where("used <= 20000").select("doc_id", "source", "used")


@query("r17_coverage_label", "WITH w AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{4,}')) AS word FROM benchmark WHERE item_id % 10 = 0), l AS (SELECT DISTINCT lang FROM documents UNION ALL SELECT 'none') SELECT word, l.lang, CASE WHEN count(doc_id) = 0 THEN 'empty_core' WHEN sum(CASE WHEN contains(lower(text), word) THEN 1 ELSE 0 END) = 0 THEN 'no_relevant_claims' ELSE 'available' END AS label FROM l LEFT JOIN documents d ON d.lang = l.lang, w GROUP BY ALL")
def _(t):
    # Probes from the stated queries in each language's documents, and in a scope without any.
    words = t("benchmark").where("item_id % 10 = 0").select(F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)).alias("word")).distinct()
    hits = ops.against(t("documents").select("lang", "text"), words, F.octet_length("word") + 16).groupBy("word", "lang").agg(F.count_if(F.contains(F.lower("text"), C("word"))).alias("hits"))
    scopes = t("documents").select("lang").distinct().unionByName(t("documents").sparkSession.range(1).select(F.lit("none").alias("lang")))
    scopes = ops.against(scopes, words, F.octet_length("word") + 16)
    label = F.when(C("hits").isNull(), "empty_core").when(C("hits") == 0, "no_relevant_claims").otherwise("available")
    return scopes.join(hits, ["word", "lang"], "left").select("word", "lang", label.alias("label"))


@query("r19_read_guard", "WITH a AS (SELECT source, doc_id // 1000 AS b, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2), m AS (SELECT source, b // 1000 AS c, sha256(string_agg(h, ',' ORDER BY b)) AS h FROM a GROUP BY 1, 2) SELECT source, sha256(string_agg(h, ',' ORDER BY c)) AS fingerprint FROM m GROUP BY 1")
def _(t):
    # A tree of digests, at most a thousand below each of its inner nodes, so that a hot source isn't one list.
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda r: r["h"]), ","), 256).alias("h")
    leaf = F.concat_ws(":", C("doc_id").cast("string"), F.sha2("text", 256)).alias("h")
    d = t("documents").select("source", "doc_id", F.floor(C("doc_id") / 1000).alias("b"), leaf)
    a = d.groupBy("source", "b").agg(joined("doc_id"))
    m = a.groupBy("source", F.floor(C("b") / 1000).alias("c")).agg(joined("b"))
    return m.groupBy("source").agg(joined("c").alias("fingerprint"))
