"""The operators as queries over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embeddings, filter_audit, language_model, line_dedup, mixing, pii, quality, secrets, simhash, toxicity, vector_codes, warc
from tessera.llm.shared import crc_bucket, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits")
    ids = F.array_join(F.array_sort(F.transform("hits.items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("hits")).alias("contaminated"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), out="n_removed")
    return out.select("doc_id", "text", "n_removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    scored = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark, f"warc-{uuid.uuid4().hex}")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score(docs, crc_bucket(F.col("doc_id"), 7) != 2)
    return out.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *quality.MEASURES, "base_failed", "kept", "n_removed")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontamination, op3_secrets, op4_mixing, op5_line_dedup, op6_toxicity, op7_warc, op8_embedding_dedup, op9_simhash, op10_lm, op11_quality, op12_vector_codes, op13_filter_audit)}


DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dg AS (SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win))),
occ AS (SELECT dg.rid, dg.p, dg.m, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.m = win.m),
h AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM occ) GROUP BY rid),
i AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
f AS (SELECT x, max(page_id) AS r FROM p GROUP BY x),
s AS (SELECT page_id, r, x, sha1(x) AS h FROM p JOIN f USING (x)),
bits AS (SELECT page_id, r, x, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ((instr('0123456789abcdef', h[1 + (5 * k) // 4]) - 1) * 16 + (CASE WHEN (5 * k) // 4 + 2 <= 40 THEN instr('0123456789abcdef', h[2 + (5 * k) // 4]) - 1 ELSE 0 END)) >> (3 - (5 * k) % 4) & 31)::INTEGER, 1)), '') AS digest FROM s)
SELECT page_id, octet_length(encode(x))::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to FROM bits
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id
"""


QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT rid, host, t, x, list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda s: s <> '') AS lw FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS x FROM d)),
n AS (SELECT rid, host, t, x, len(lw) AS k, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS y FROM l WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM n GROUP BY rid),
g AS (SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM g) WHERE m > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY rid),
lim AS (SELECT host, greatest(5.0::DOUBLE, count(DISTINCT t) * 0.01::DOUBLE) AS most FROM d GROUP BY host),
bad AS (SELECT host, y FROM (SELECT host, y, count(DISTINCT t) AS m FROM n GROUP BY host, y) JOIN lim USING (host) WHERE m > most),
gone AS (SELECT rid, sum(k) AS n FROM n SEMI JOIN bad USING (host, y) GROUP BY rid),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept FROM o
"""

FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM t LEFT JOIN b USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i + 1]), '') AS filter_order, s AS step, 'ABCDE'[o[s] + 1] AS f, (1 << o[s])::INT AS bit, coalesce(list_sum(list_transform(o[1:s - 1], lambda i: 1 << i)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN fails & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

CODES = ["""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT rid, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS y FROM v, (SELECT unnest(range(16)) AS p)),
e0 AS (SELECT p, rid - 1 AS e, y FROM s WHERE rid <= 64)"""]
for _r in range(3):
    CODES.append(f"""a{_r} AS (SELECT rid, s.p, min({{'d': list_sum(list_transform(list_zip(s.y, b.y), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT, 'e': b.e}}) AS m FROM s JOIN e{_r} b ON s.p = b.p GROUP BY rid, s.p)""")
    if _r < 2:
        CODES.append(f"""t{_r} AS (SELECT p, e, i, sum(z) AS z, count(*) AS n FROM (SELECT s.p, m.e AS e, unnest(range(1, len(y) + 1)) AS i, unnest(y) AS z FROM s JOIN a{_r} USING (rid, p)) GROUP BY p, e, i),
n{_r} AS (SELECT p, e, list(((z - ((z % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM t{_r} GROUP BY p, e),
e{_r + 1} AS (SELECT p, e, coalesce(n{_r}.y, e{_r}.y) AS y FROM e{_r} LEFT JOIN n{_r} USING (p, e))""")
VECTOR_CODES = ",\n".join(CODES) + """,
r AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM e2) AS codebooks_sha256 FROM r JOIN v USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION, "op7_warc": WARC, "op8_embedding_dedup": EMBEDDINGS, "op11_quality": QUALITY, "op12_vector_codes": VECTOR_CODES, "op13_filter_audit": FILTER_AUDIT}
