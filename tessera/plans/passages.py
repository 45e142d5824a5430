"""Chunkers, quote and number queries over whole texts. Those without SQL are tested against plain loops on small rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import passages as ps
from tessera.functions import quotes as qt
from tessera.operators import relational as ops
from tessera.registry import query

C = F.col


def _pieces(df, ranges=None):
    r = df if ranges is None else df.withColumn("r", F.explode(ranges)).select("doc_id", "r.*", "text")
    return r.withColumn("h", F.md5(F.substring(C("text"), C("start") + 1, C("end") - C("start")))).drop("text")


@query("c2_lossless_passages")
def _(t):
    return _pieces(t("documents").select("doc_id", "text"), ps.passage_ranges(C("text")))


@query("c3_paragraph_chunks")
def _(t):
    return _pieces(t("documents").select("doc_id", "text"), ps.paragraph_ranges(C("text")))


@query("c4_sentences")
def _(t):
    return t("documents").select("doc_id", F.posexplode(ps.sentence_list(C("text"))).alias("k", "sentence")).withColumn("sentence", F.md5("sentence"))


@query("c5_structure_ranges")
def _(t):
    d = t("documents").select("doc_id", "text")
    # A line of 60 characters or fewer that doesn't end like a sentence is taken for a heading.
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    start = F.sum(F.length("x") + 1).over(W.partitionBy("doc_id").orderBy("i")) - F.length("x") - 1
    heads = lines.withColumn("at", start).where("length(x) BETWEEN 1 AND 60 AND NOT x RLIKE '[.!?,;:]$'").groupBy("doc_id").agg(F.array_sort(F.collect_list(C("at").cast("int"))).alias("heads"))
    return _pieces(d.join(heads, "doc_id", "left"), ps.passage_ranges(C("text"), C("heads")))


@query("c6_similarity_ranges")
def _(t):
    d = t("documents").select(C("doc_id").alias("id"), "text")
    return _pieces(ps.similar_ranges(d).withColumnRenamed("id", "doc_id"))


@query("c10_label_expansion", "SELECT doc_id, i - 1 AS line, CASE WHEN length(string_split(text, chr(10))[i]) < 60 THEN 'head' ELSE 'body' END AS label FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).select("doc_id", "line", F.when(F.length("x") < 60, "head").otherwise("body").alias("label"))
    # Compact spans (first, last, label) of equal neighbours, as an annotator writes them, and expanded again.
    w = W.partitionBy("doc_id").orderBy("line")
    run = F.sum(F.coalesce((C("label") != F.lag("label").over(w)).cast("int"), F.lit(0))).over(w)
    spans = lines.withColumn("run", run).groupBy("doc_id", "run", "label").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return spans.select("doc_id", F.explode(F.sequence(C("first").cast("long"), C("last").cast("long"))).alias("line"), "label")


@query("c12_contiguous_cover", "WITH p AS (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 999) // 1000)) AS k FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, n, 1000 * k AS s, least(n, 1000 * k + 1000) AS e FROM p WHERE NOT (doc_id % 10 = 0 AND k = 1)) SELECT doc_id, bool_and(f) AND max(e) = any_value(n) AS contiguous, sum(e - s)::BIGINT AS covered FROM (SELECT *, s = coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f FROM c) GROUP BY doc_id")
def _(t):
    # Pages of 1000 characters; every tenth document has lost its second one, so its cover has a gap.
    p = t("documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int"))).alias("k"))
    p = p.where("NOT (doc_id % 10 = 0 AND k = 1)").select("doc_id", "n", (C("k") * 1000).alias("s"), F.least("n", C("k") * 1000 + 1000).alias("e"))
    p = p.withColumn("follows", C("s") == F.lag("e", 1, 0).over(W.partitionBy("doc_id").orderBy("s")))
    return p.groupBy("doc_id").agg((F.bool_and("follows") & (F.max("e") == F.first("n"))).alias("contiguous"), F.sum(C("e") - C("s")).cast("long").alias("covered"))


@query("f2_nfkc")
def _(t):
    return t("documents").select("doc_id", F.md5(qt.nfkc(C("text"))).alias("h"))


BARE = "regexp_replace(lower({0}), '[ \\n\\r\\t\\f\\v]+', '', 'g')"


@query("f19_quote_location", f"WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'q7q ' ELSE '' END || substr(text, n_chars // 3 + 1, 60) AS q FROM documents), p AS (SELECT doc_id, q, strpos({BARE.format('text')}, {BARE.format('q')}) AS pos FROM q WHERE {BARE.format('q')} <> '') SELECT doc_id, pos > 0 AS found, CASE WHEN pos > 0 THEN pos - 1 END AS chars_before, CASE WHEN pos > 0 THEN length({BARE.format('q')}) END AS chars FROM p")
def _(t):
    # The quote is a stretch of the text set anew: white space runs made one, letters raised. Every tenth begins otherwise, and isn't there.
    bare = lambda x: F.lower(F.regexp_replace(x, r"[ \n\r\t\f\x0B]+", ""))
    q = F.concat(F.when(C("doc_id") % 10 == 0, "q7q ").otherwise(""), F.substring(C("text"), F.floor(C("n_chars") / 3).cast("int") + 1, F.lit(60)))
    d = t("documents").where("text IS NOT NULL").select("doc_id", "text", q.alias("q")).where(bare(C("q")) != "")
    d = d.withColumn("s", qt.quote_span(F.upper(F.regexp_replace("q", r"[ \n\r\t\f\x0B]+", "  ")), C("text")))
    before, match = F.substring("text", F.lit(1), C("s.start")), F.substring(C("text"), C("s.start") + 1, C("s.end") - C("s.start"))
    return d.select("doc_id", C("s").isNotNull().alias("found"), F.length(bare(before)).cast("long").alias("chars_before"), F.length(bare(match)).cast("long").alias("chars"))


@query("f23_numbers")
def _(t):
    n = t("documents").select("doc_id", F.explode(qt.quantities(C("text"))).alias("n"))
    return n.groupBy("doc_id", "n.unit").agg(F.count("*").alias("n"), F.max(F.length("n.text")).alias("longest"))


@query("f24_unsupported_numbers")
def _(t):
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(C("text"), F.length(first) + 1, F.length("text"))
    return t("documents").select("doc_id", F.array_join(F.transform(qt.unsupported(first, F.array(rest)), lambda n: n["text"]), " ").alias("unsupported"))


@query("f26_cjk_gaps", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([㐀-鿿])[ \\t\\f\\v]+([㐀-鿿])', '\\1\\2', 'g'), '([㐀-鿿])[ \\t\\f\\v]+([㐀-鿿])', '\\1\\2', 'g')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(F.regexp_replace("text", r"(?<=[\x{3400}-\x{9FFF}])[^\S\r\n]+(?=[\x{3400}-\x{9FFF}])", "")).alias("h"))


@query("f46_width_folding", "SELECT doc_id, md5(translate(text, '，。：；！？（）', ',.:;!?()')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(F.translate("text", "，。：；！？（）", ",.:;!?()")).alias("h"))


@query("r16_plan_dedup", "SELECT conv_id, k, first_turn FROM (SELECT conv_id, md5(lower(trim(regexp_replace(text, '[ \\n\\r\\t\\f]+', ' ', 'g')))) AS k, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, k) <= 4")
def _(t):
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \n\r\t\f]+", " "))))
    g = t("conversations").groupBy("conv_id", key.alias("k")).agg(F.min("turn").alias("first_turn"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("first_turn", "k"))
    return g.withColumn("n", n).where("n <= 4").select("conv_id", "k", "first_turn")


@query("r20_retrieval_audit", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'no_relevance' WHEN sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) > 20000 THEN 'context_budget' ELSE 'selected' END AS reason FROM documents")
def _(t):
    d = ops.running_sum(t("documents").select("doc_id", "source", "n_chars"), ["source"], F.floor(C("n_chars") / 50), [C("n_chars"), C("doc_id")], C("n_chars"), "used")
    return d.select("doc_id", F.when(C("n_chars") == 0, "no_relevance").when(C("used") > 20000, "context_budget").otherwise("selected").alias("reason"))


@query("r21_source_diversity", "SELECT lang, count(DISTINCT source) AS sources, round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 9) AS relevant FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    d = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.round(F.avg(F.coalesce((C("quality") == 1).cast("int"), F.lit(0))), 9).alias("relevant"))
