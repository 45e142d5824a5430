"""Evaluation: agreement, confusion, intervals, retrieval metrics, gates, ledgers; and queue states as of the event log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.registry import query

C = F.col


@query("a17_confusion_matrix", "SELECT coalesce(toxic::VARCHAR, 'unavailable') AS gold, CASE WHEN n_chars > 2000 THEN '1' ELSE '0' END AS pred, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(t):
    x = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    return x.groupBy(F.coalesce(C("toxic").cast("string"), F.lit("unavailable")).alias("gold"), F.when(C("n_chars") > 2000, "1").otherwise("0").alias("pred")).agg(F.count("*").alias("n"))


@query("a18_judge_agreement", "SELECT source, count(*) AS total, count(*) FILTER (toxic = quality)::BIGINT AS matched, round(avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0 END), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def _(t):
    same = C("toxic") == C("quality")
    return t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("total"), F.count_if(same).alias("matched"), F.round(F.avg(same.cast("int")), 6).alias("rate"))


@query("a21_binary_f1", "WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def _(t):
    p, g = C("n_chars") > 1000, C("quality") == 1
    c = t("documents").select("doc_id", "source", "n_chars").join(t("labels"), "doc_id").groupBy("source").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    zero = F.lit(0)
    return c.select("source", F.round(2 * C("tp") / F.nullif(2 * C("tp") + C("fp") + C("fn"), zero), 6).alias("f1"), F.round(C("tp") / F.nullif(C("tp") + C("fn"), zero), 6).alias("recall"))


@query("a22_wilson_interval", "WITH r AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END)::DOUBLE AS p FROM events GROUP BY 1) SELECT event_type, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM r")
def _(t):
    r = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((C("value") > 10).cast("int")).alias("p"))
    z2 = 1.96 * 1.96
    half = 1.96 * F.sqrt(C("p") * (1 - C("p")) / C("n") + z2 / (4.0 * C("n") * C("n")))
    mid = C("p") + z2 / (2 * C("n"))
    return r.select("event_type", F.round((mid - half) / (1 + z2 / C("n")), 6).alias("lo"), F.round((mid + half) / (1 + z2 / C("n")), 6).alias("hi"))


@query("a28_baseline_deltas", "WITH m AS (SELECT source, avg(n_chars) FILTER (doc_id % 2 = 0) AS base, avg(n_chars) FILTER (doc_id % 2 = 1) AS cand FROM documents GROUP BY 1) SELECT source, round(cand - base, 6) AS delta, cand < base AS regressed FROM m")
def _(t):
    m = t("documents").groupBy("source").agg(F.avg(F.when(C("doc_id") % 2 == 0, C("n_chars"))).alias("base"), F.avg(F.when(C("doc_id") % 2 == 1, C("n_chars"))).alias("cand"))
    return m.select("source", F.round(C("cand") - C("base"), 6).alias("delta"), (C("cand") < C("base")).alias("regressed"))


@query("a29_threshold_gates", "WITH m AS (SELECT event_type, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1), g(metric, op, bound) AS (VALUES ('mean', '>=', 5.0), ('most', '<=', 1000.0)) SELECT event_type, metric, CASE WHEN v IS NULL THEN 'incomplete' WHEN (op = '>=' AND v >= bound) OR (op = '<=' AND v <= bound) THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT event_type, metric, op, bound, CASE metric WHEN 'mean' THEN mean ELSE most END AS v FROM m, g)")
def _(t):
    e = t("events")
    long = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most")).select("event_type", F.expr("stack(2, 'mean', mean, 'most', most) AS (metric, v)"))
    gates = e.sparkSession.createDataFrame([("mean", ">=", 5.0), ("most", "<=", 1000.0)], "metric string, op string, bound double")
    ok = ((C("op") == ">=") & (C("v") >= C("bound"))) | ((C("op") == "<=") & (C("v") <= C("bound")))
    return long.join(F.broadcast(gates), "metric").select("event_type", "metric", F.when(C("v").isNull(), "incomplete").when(ok, "pass").otherwise("fail").alias("verdict"))


METRICS = "WITH r AS (SELECT q.vec_id AS q, v.vec_id AS id, q.label = v.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS k FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"


@query("e1_ir_metrics", METRICS + " SELECT q, max(CASE WHEN rel AND k <= 10 THEN 1 ELSE 0 END)::INTEGER AS hit10, round(coalesce(max(CASE WHEN rel AND k <= 10 THEN 1.0 / k END), 0), 6) AS mrr10, round(sum(CASE WHEN rel AND k <= 10 THEN 1 / log2(k + 1) ELSE 0 END) / sum(CASE WHEN k <= 10 THEN 1 / log2(k + 1) END), 6) AS ndcg10 FROM r GROUP BY q")
def _(t):
    from tessera.operators.retrieval import dense

    v = t("embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector"))
    r = dense(v, v.where("id % 100 = 0").select(C("id").alias("query_id"), "vector"), 11)
    label = t("embeddings").select("vec_id", "label")
    r = r.where("query_id <> id").join(label.select(C("vec_id").alias("id"), C("label").alias("lv")), "id").join(label.select(C("vec_id").alias("query_id"), C("label").alias("lq")), "query_id")
    r = r.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("k <= 10").withColumn("rel", C("lv") == C("lq"))
    gain = 1 / F.log2(C("k") + 1)
    return r.groupBy(C("query_id").alias("q")).agg(F.max(C("rel").cast("int")).alias("hit10"), F.round(F.coalesce(F.max(F.when(C("rel"), 1 / C("k"))), F.lit(0.0)), 6).alias("mrr10"), F.round(F.sum(F.when(C("rel"), gain).otherwise(0)) / F.sum(gain), 6).alias("ndcg10"))


@query("e6_judge_arbitration", "SELECT doc_id, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'conflict' WHEN quality = toxic THEN 'agreed' ELSE 'arbitrated' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    x = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return x.select("doc_id", F.when(C("quality").isNull() | C("toxic").isNull(), "conflict").when(C("quality") == C("toxic"), "agreed").otherwise("arbitrated").alias("state"))


@query("e14_spending_ledger", "SELECT event_id, round(sum(value) OVER w, 4) AS spent, sum(value) OVER w <= 500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t("events").select("event_id", F.round(F.sum("value").over(w), 4).alias("spent"), (F.sum("value").over(w) <= 500).alias("within"))


@query("e15_integrity_violations", "SELECT 'duplicate_text' AS rule, count(*) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'length_mismatch', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(t):
    d = t("documents")
    dup = d.groupBy("text").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_text").alias("rule"), "n")
    length = d.where(F.length("text") != C("n_chars")).agg(F.count("*").alias("n")).select(F.lit("length_mismatch").alias("rule"), "n")
    orphan = t("labels").join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("label_without_document").alias("rule"), "n")
    return dup.unionByName(length).unionByName(orphan)


@query("st8_status_rollup", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 3 THEN 'failed' WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'needs_review' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'publishing' ELSE 'completed' END AS status FROM events GROUP BY 1")
def _(t):
    n = lambda kind: F.count_if(C("event_type") == kind)
    return t("events").groupBy("user_id").agg(F.when(n("error") > 3, "failed").when(n("signup") > 0, "needs_review").when(n("click") > 0, "publishing").otherwise("completed").alias("status"))


@query("x_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(C("w.start").alias("start_at"), "event_type", "n", "total")


@query("x_session_windows", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", C("w.start").alias("start_at"), "n")
