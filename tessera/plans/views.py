"""Reading views, line classes, zones, JSON scans and streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import formulas, glyphs
from tessera.functions import json_views as jv
from tessera.operators import relational as ops
from tessera.operators import zoning
from tessera.registry import query
from tessera.sources import json_files

C = F.col


def collapsed_bold(x: Column) -> Column:
    """Words that stand three times in a row once, in lines where two words or more do."""
    pattern = r"(?<!\S)(\S+)(?: \1){2}(?!\S)"
    return F.array_join(F.transform(F.split(x, "\n"), lambda line: F.when(F.regexp_count(line, F.lit(pattern)) >= 2, F.regexp_replace(line, pattern, "$1")).otherwise(line)), "\n")


@query("f27_fake_bold")
def _(t):
    # Every fifth text with its first words tripled, as an extractor gives bold print.
    bold = F.regexp_replace("text", r"^(\S+) (\S+)", "$1 $1 $1 $2 $2 $2")
    d = t("documents").select("doc_id", F.when(C("doc_id") % 5 == 0, bold).otherwise(C("text")).alias("x"))
    return d.select("doc_id", F.md5(collapsed_bold(C("x"))).alias("h"))


@query("f30_titles", "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda s: trim(s)), lambda s: length(s) BETWEEN 8 AND 200 AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '^(https?://|[0-9 .-]+$)')) AS u FROM documents) SELECT doc_id, coalesce(u[1], 'untitled') AS title, len(u) AS usable FROM l")
def _(t):
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 5), lambda s: F.trim(s))
    usable = F.filter(lines, lambda s: F.length(s).between(8, 200) & s.rlike("[A-Za-z]") & ~s.rlike("^(https?://|[0-9 .-]+$)"))
    return t("documents").select("doc_id", usable.alias("u")).select("doc_id", F.coalesce(F.try_element_at("u", F.lit(1)), F.lit("untitled")).alias("title"), F.size("u").cast("long").alias("usable"))


#: Line classes in order of precedence, each with its pattern.
CLASSES = (
    ("license", r"(?i)\b(licen[cs]ed?|copyright)\b"),
    ("references", r"(?i)^\s*(references|bibliography)\b"),
    ("number", r"^[0-9 .,-]+$"),
    ("bullet", r"^\s*([*|-]|[0-9]+[.)])\s"),
    ("caption", r"(?i)^\s*(fig(ure)?|table)\b"),
    ("sentence", r"[.!?]\s*$"),
    ("blank", r"^\s*$"),
)
LINES = "SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p.replace(chr(92) + 's', '[ ' + chr(92) + 't]')}') THEN '{c}'" for c, p in CLASSES) + " ELSE 'text' END"


def _lines(t):
    kind = None
    for c, p in CLASSES:
        test = C("x").rlike(p.replace(r"\s", r"[ \t]"))
        kind = F.when(test, c) if kind is None else kind.when(test, c)
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    return lines.select("doc_id", (C("p") + 1).cast("long").alias("i"), "x", kind.otherwise("text").alias("kind"))


@query("f31_line_classes", f"SELECT doc_id, i, {CLASS_SQL} AS kind FROM ({LINES})")
def _(t):
    return _lines(t).select("doc_id", "i", "kind")


@query("c7_zones", f"WITH k AS (SELECT doc_id, i, {CLASS_SQL} AS kind FROM ({LINES})), s AS (SELECT *, last_value(CASE WHEN kind IN ('references', 'license') THEN kind WHEN kind = 'blank' THEN 'body' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS state FROM k) SELECT doc_id, CASE WHEN kind IN ('sentence', 'text') AND coalesce(state, 'body') <> 'body' THEN 'after_' || state ELSE kind END AS zone, count(*) AS lines, min(i) AS first_line FROM s GROUP BY 1, 2")
def _(t):
    # A section's state holds for the lines behind its head until a blank line.
    mark = F.when(C("kind").isin("references", "license"), C("kind")).when(C("kind") == "blank", "body")
    state = F.last(mark, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    s = _lines(t).withColumn("state", F.coalesce(state, F.lit("body")))
    zone = F.when(C("kind").isin("sentence", "text") & (C("state") != "body"), F.concat(F.lit("after_"), "state")).otherwise(C("kind"))
    return s.groupBy("doc_id", zone.alias("zone")).agg(F.count("*").alias("lines"), F.min("i").alias("first_line"))


def paged_lines(t):
    """The documents' lines on pages of twenty below a running head, with the parts of a paper around them."""
    d = t("documents").select("doc_id", "source", "lang", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("x"))
    front = F.array(F.concat(F.lit("Notes on "), "source"), F.concat(F.lit("Department of "), "lang"), F.lit("Abstract"), F.coalesce(F.get("x", F.lit(0)), F.lit("-")), F.concat(F.lit("Keywords: "), "lang"), F.lit("1 Introduction"))
    entry = F.concat(F.lit("[1] A. Author, "), "source", F.lit(", on things that texts are made of. 2019. "))
    back = F.when(C("doc_id") % 3 == 0, F.array(F.lit("References"), entry, F.lit("pp. 1-2"), F.lit("Appendix A"), F.lit("Table 1: n = 2"))).otherwise(F.array(F.lit("References"), F.lit("none")))
    d = d.select("doc_id", "source", F.posexplode(F.concat(front, "x", back)).alias("p", "text"))
    rows = d.select(C("doc_id").alias("doc"), F.expr("cast(p div 20 + 1 as int)").alias("page"), (C("p") % 20 + 1).alias("i"), F.trim("text").alias("text"), "source")
    heads = rows.select("doc", "page", "source").distinct().select("doc", "page", F.lit(0).alias("i"), F.concat(F.lit("Reports of "), "source", F.lit(", page "), C("page").cast("string")).alias("text"))
    return rows.drop("source").unionByName(heads)


@query("c7_block_kinds")
def _(t):
    z = zoning.zones(paged_lines(t))
    return z.groupBy(C("doc").alias("doc_id"), "kind").agg(F.count("*").alias("lines"), F.min(F.struct("page", "i")).alias("f")).select("doc_id", "kind", "lines", C("f.page").alias("page"), C("f.i").alias("i"))


@query("e4_zoning_metrics", f"WITH k AS (SELECT {CLASS_SQL} AS kind, CASE WHEN length(x) = 0 THEN 'blank' WHEN contains(lower(x), 'licens') THEN 'license' WHEN right(x, 1) IN ('.', '!', '?') THEN 'sentence' ELSE 'text' END AS gold FROM ({LINES})) SELECT c, count(*) FILTER (kind = c AND gold = c) AS tp, count(*) FILTER (kind = c AND gold <> c) AS fp, count(*) FILTER (kind <> c AND gold = c) AS fn, round(2 * count(*) FILTER (kind = c AND gold = c) / nullif(count(*) FILTER (kind = c) + count(*) FILTER (gold = c), 0), 9) AS f1 FROM k, (SELECT unnest(['blank', 'license', 'sentence', 'text']) AS c) GROUP BY c")
def _(t):
    gold = F.when(F.length("x") == 0, "blank").when(F.contains(F.lower("x"), F.lit("licens")), "license").when(F.right("x", F.lit(1)).isin(".", "!", "?"), "sentence").otherwise("text")
    pairs = _lines(t).groupBy("kind", gold.alias("gold")).agg(F.count("*").alias("n"))
    rows = pairs.select("kind", "gold", "n", F.explode(F.array(*map(F.lit, ("blank", "license", "sentence", "text")))).alias("c"))
    total = lambda cond: F.sum(F.when(cond, C("n")).otherwise(0))
    k, g = C("kind") == C("c"), C("gold") == C("c")
    return rows.groupBy("c").agg(total(k & g).alias("tp"), total(k & ~g).alias("fp"), total(~k & g).alias("fn"), F.round(2 * total(k & g) / F.nullif(total(k) + total(g), F.lit(0)), 9).alias("f1"))


@query("c11_line_projection", f"WITH a AS ({LINES}), b AS (SELECT doc_id, i, lower(x) AS y FROM a WHERE NOT (doc_id % 9 = 0 AND i = 2)), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, y FROM b), n AS (SELECT a.doc_id, count(*) AS n, (SELECT count(*) FROM r WHERE r.doc_id = a.doc_id) AS m FROM a GROUP BY 1) SELECT n.doc_id, n.n = m AS projects, CASE WHEN n.n = m THEN sum(length(y)) END::BIGINT AS chars FROM n LEFT JOIN r ON r.doc_id = n.doc_id AND r.i BETWEEN 2 AND 5 GROUP BY n.doc_id, n.n, m")
def _(t):
    # Lines 2 to 5 of a text, projected by number onto its decoded form, where both have as many lines; every ninth has lost one.
    a = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    b = a.where("NOT (doc_id % 9 = 0 AND p = 1)").select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("p")).alias("i"), F.lower("x").alias("y"))
    m = b.groupBy("doc_id").agg(F.count("*").alias("m"), F.sum(F.when(C("i").between(2, 5), F.length("y"))).alias("chars"))
    n = t("documents").select("doc_id", F.size(F.split("text", "\n")).alias("n")).join(m, "doc_id", "left")
    same = F.coalesce(C("n") == C("m"), F.lit(False))
    return n.select("doc_id", same.alias("projects"), F.when(same, C("chars")).alias("chars"))


@query("f35_interning", "SELECT md5(html) AS id, count(*) AS refs, max(length(html)) AS n FROM pages WHERE length(html) >= 80 GROUP BY 1")
def _(t):
    # Strings of 80 characters or more become references into a table, and come back by them.
    p = t("pages").select("page_id", F.when(F.length("html") >= 80, F.md5("html")).alias("id"), F.when(F.length("html") < 80, C("html")).alias("own"))
    strings = t("pages").where("length(html) >= 80").select(F.md5("html").alias("id"), "html").dropDuplicates(["id"])
    back = p.where("id IS NOT NULL").join(strings, "id")
    return back.groupBy("id").agg(F.count("*").alias("refs"), F.max(F.length("html")).alias("n"))


@query("f35_interned_json", "SELECT page_id, (length(html) >= 80)::INT + (length(url) >= 80 AND url <> html)::INT AS strings, true AS exact FROM pages")
def _(t):
    # Nested JSON of each page, its long strings in a table, and put back.
    whole = F.to_json(F.struct("page_id", F.struct("html", F.array("html", "url").alias("again")).alias("body"), F.struct(C("url").alias("$text")).alias("link")))
    p = t("pages").select("page_id", whole.alias("x")).select("page_id", "x", jv.interned(C("x")).alias("i"))
    return p.select("page_id", F.size("i.strings").alias("strings"), (jv.restored(C("i.view"), C("i.strings")) == jv.canonical(C("x"))).alias("exact"))


GLYPHS = "regexp_replace({0}, '[\\s]+', '', 'g')"
BAD = f"(len({GLYPHS}) >= 8 AND len(list_distinct(string_split({GLYPHS}, ''))) >= 4 AND len(regexp_replace({GLYPHS}, '[^\\x{{{{5B00}}}}-\\x{{{{5B7F}}}}]|[{glyphs.COMMON}]', '', 'g')) >= greatest(4, len({GLYPHS}) / 2))"


@query("f28_garbled_glyphs", f"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x{{20}}-\\x{{7E}}\\n]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, CASE WHEN doc_id % 3 = 0 THEN translate(t, '{glyphs.PLAIN[1:].replace("'", "''")}', '{glyphs.SHIFTED[1:]}') ELSE t END AS x FROM d),
p AS (SELECT doc_id, t, x, regexp_extract_all(x, '[\\x{{5A00}}-\\x{{5BFF}}\\s]+|[^\\x{{5A00}}-\\x{{5BFF}}\\s]+') AS p FROM g),
r AS (SELECT doc_id, t, x, array_to_string(list_transform(p, lambda r: CASE WHEN {BAD.format("r")} THEN translate(r, '{glyphs.SHIFTED}', '{glyphs.PLAIN.replace("'", "''")}') ELSE r END), '') AS y, len(list_filter(p, lambda r: {BAD.format("r")})) > 0 AS garbled FROM p)
SELECT doc_id, garbled, y = t AS restored, md5(y) AS h FROM r
""")
def _(t):
    # Printable text of all documents, every third one as a font's offset leaves it.
    clean = F.regexp_replace("text", r"[^\x{20}-\x{7E}\n]", "")
    broken = F.when(C("doc_id") % 3 == 0, F.translate(clean, glyphs.PLAIN[1:], glyphs.SHIFTED[1:])).otherwise(clean)
    d = t("documents").select("doc_id", clean.alias("t"), broken.alias("x"))
    d = d.select("doc_id", "t", glyphs.is_garbled(C("x")).alias("garbled"), glyphs.restored(C("x")).alias("y"))
    return d.select("doc_id", "garbled", (C("y") == C("t")).alias("restored"), F.md5("y").alias("h"))


@query("f41_formulas", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_extendedprice AS p, l_partkey % 5 AS k FROM lineitem),
v AS (SELECT *, CASE k WHEN 0 THEN (q + 2.5::DOUBLE) * -d / (p - 1::DOUBLE) WHEN 1 THEN CASE WHEN d = 0 THEN NULL ELSE q - p / d / 2::DOUBLE END WHEN 2 THEN CASE WHEN abs(p * p * q) > 1e12 THEN NULL ELSE -(-q + p * p * q) END END AS x FROM l)
SELECT l_orderkey, l_linenumber, k, count(*) AS n, max(round(CASE WHEN abs(x) > 1e6 THEN x / 1e6::DOUBLE WHEN abs(x) < 1 THEN x * 1e6::DOUBLE ELSE x END, 4) + 0) AS greatest, min(CASE WHEN x IS NULL THEN CASE k WHEN 1 THEN 'zero' WHEN 2 THEN 'range' WHEN 3 THEN 'undeclared' ELSE 'unsupported' END END) AS why FROM v GROUP BY ALL
""")
def _(t):
    # Five formulas of each line's own numbers: good ones, one divided by a discount that may be 0, one that may grow too large, and two to refuse.
    k = (C("l_partkey") % 5).alias("k")
    text = F.element_at(F.array(*map(F.lit, ("(q + 2.5) * -d / (p - 1)", "q - p / d / 2", "-(-q + p * p * q) ", "q + d + rate * p", "q ** d + p"))), (C("k") + 1).cast("int"))
    names = F.when(C("k") == 2, F.create_map(F.lit("q"), C("l_quantity"), F.lit("p"), C("l_extendedprice"))).otherwise(F.create_map(F.lit("q"), C("l_quantity"), F.lit("d"), C("l_discount"), F.lit("p"), C("l_extendedprice")))
    e = t("lineitem").withColumn("k", k).select("l_orderkey", "l_linenumber", "k", formulas.evaluated(text, names).alias("e"))
    return e.groupBy("l_orderkey", "l_linenumber", "k").agg(F.count("*").alias("n"), F.max(F.round(F.when(F.abs("e.value") > 1e6, C("e.value") / 1e6).when(F.abs("e.value") < 1, C("e.value") * 1e6).otherwise(C("e.value")), 4) + F.lit(0.0)).alias("greatest"), F.min("e.why").alias("why"))


@query("f36_reading_view", """
WITH k AS (SELECT l_orderkey, l_suppkey, count(DISTINCT l_tax) > 1 AS clash FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey, bool_or(clash) AS conflict, count(*) AS sources FROM k GROUP BY 1)
SELECT l_orderkey, conflict, CASE WHEN NOT conflict THEN count(*) END AS bundles, CASE WHEN NOT conflict THEN count(DISTINCT l_partkey) END AS documents, CASE WHEN NOT conflict THEN any_value(sources) END AS sources, CASE WHEN NOT conflict THEN true END AS exact FROM lineitem JOIN o USING (l_orderkey) GROUP BY l_orderkey, conflict
""")
def _(t):
    # An order as a package: each line a bundle with its part as document and its supplier, whose entry holds the line's tax, as source.
    key = lambda c: F.concat(F.lit("k"), C(c).cast("string")).alias("id")
    bundle = F.struct("l_linenumber", F.array(F.struct(key("l_partkey"))).alias("documents"), F.array(F.struct(key("l_suppkey"), "l_tax")).alias("sources"))
    package = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(bundle).alias("claim_bundles"))).alias("x"))
    p = package.select("l_orderkey", "x", jv.compacted(C("x"), "claim_bundles", ["documents", "sources"]).alias("c"))
    p = p.select("l_orderkey", "x", "c.view", C("c.conflict").isNotNull().alias("conflict"))
    size = lambda path: F.size(F.json_object_keys(F.get_json_object("view", path))).cast("long")
    same = jv.expanded(C("view"), "claim_bundles") == jv.canonical(C("x"))
    return p.select("l_orderkey", "conflict", F.json_array_length(F.get_json_object("view", "$.claim_bundles")).cast("long").alias("bundles"), F.when(C("view").isNotNull(), size("$.tables.documents")).alias("documents"), F.when(C("view").isNotNull(), size("$.tables.sources")).alias("sources"), same.alias("exact"))


@query("f37_field_stripping", "SELECT o_orderkey, json_object('id', o_orderkey, 'place', json_object('status', o_orderstatus, 'lines', json_array(json_object('n', 1), json_array(json_object('status', o_orderstatus)))), 'location', json_object('review', o_orderpriority))::VARCHAR AS kept FROM orders")
def _(t):
    # Administrative fields go at any depth, in lists of lists too; a location is data and stays whole.
    whole = F.format_string('{"id":%d,"admin":"me","place":{"status":"%s","review":"%s","lines":[{"n":1,"admin":[1]},[{"review":{},"status":"%s"}]]},"location":{"review":"%s"}}', "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderstatus", "o_orderpriority")
    return t("orders").select("o_orderkey", jv.stripped(whole, ["admin", "review"], ["location"]).alias("kept"))


@query("f38_lease_age", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, ts + INTERVAL 30 SECOND AS lease_until, epoch(now) - epoch(ts) <= greatest(5, 3 * 600) AS online FROM events, n")
def _(t):
    now = t("events").agg(F.max("ts").alias("now"))  # one row
    age = C("now").cast("timestamp").cast("double") - C("ts").cast("timestamp").cast("double")
    return t("events").crossJoin(F.broadcast(now)).select("event_id", (C("ts") + F.expr("INTERVAL 30 SECOND")).alias("lease_until"), (age <= max(5, 3 * 600)).alias("online"))


@query("f42_box_rescale", "SELECT l_orderkey, l_linenumber, l_quantity / 50 * 612 AS x0, l_tax * 792 AS y0, l_quantity <= 50 AND l_tax < l_discount AS valid FROM lineitem")
def _(t):
    box = F.array(C("l_quantity") / 50 * 612, C("l_tax") * 792)
    return t("lineitem").select("l_orderkey", "l_linenumber", box[0].alias("x0"), box[1].alias("y0"), ((C("l_quantity") <= 50) & (C("l_tax") < C("l_discount"))).alias("valid"))


@query("f43_flattened_content", "SELECT l_orderkey, string_agg(l_returnflag || ' ' || l_linestatus || ' ' || l_partkey, ' ' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey::VARCHAR) AS content FROM lineitem GROUP BY 1")
def _(t):
    # An order's few lines as content of all shapes: text, lists, objects with text or content, numbers.
    line = F.format_string('{"type":"x","content":["%s",{"text":["%s",[]]},[{"content":%d},null]]}', "l_returnflag", "l_linestatus", "l_partkey")
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", C("l_partkey").cast("string").alias("p"), line.alias("line")))).alias("x"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["line"]), ","), F.lit("]"))
    return g.select("l_orderkey", jv.flattened(whole, ["text", "content"]).alias("content"))


@query("f45_review_fingerprint", "SELECT o_orderkey, sha256(json_object('id', o_orderkey, 'priority', o_orderpriority, 'status', o_orderstatus)::VARCHAR) AS h FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.sha2(F.to_json(F.struct(C("o_orderkey").alias("id"), C("o_orderpriority").alias("priority"), C("o_orderstatus").alias("status"))), 256).alias("h"))


@query("f47_reserved_paths", "WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'con' WHEN 1 THEN '..' WHEN 2 THEN 'run-' || page_id ELSE 'a b:' END AS part FROM pages) SELECT page_id, regexp_full_match(part, '[A-Za-z0-9][A-Za-z0-9._-]*') AND lower(part) NOT IN ('con', 'prn', 'aux', 'nul') AND part NOT IN ('.', '..') AS allowed FROM p")
def _(t):
    k = C("page_id") % 4
    part = F.when(k == 0, "con").when(k == 1, "..").when(k == 2, F.concat(F.lit("run-"), C("page_id").cast("string"))).otherwise("a b:")
    return t("pages").select("page_id", part.alias("p")).select("page_id", (C("p").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.lower("p").isin("con", "prn", "aux", "nul") & ~C("p").isin(".", "..")).alias("allowed"))


@query("f48_override_merge", "SELECT event_id, json_object('k', CASE WHEN event_type = 'error' THEN -1 ELSE json_extract(props, '$.k')::BIGINT END, 'deep', json_object('a', json_object('x', 1, 'y', event_type), 'b', json_array(3)), 'type', event_type)::VARCHAR AS merged FROM events")
def _(t):
    base = F.concat(F.regexp_replace("props", "[}]$", ""), F.lit(',"deep":{"a":{"x":1,"y":2},"b":[1,2]}}'))
    k = F.when(C("event_type") == "error", F.lit('"k":-1,')).otherwise(F.lit(""))
    over = F.concat(F.lit("{"), k, F.format_string('"deep":{"b":[3],"a":{"y":"%s"}},"type":"%s"}', "event_type", "event_type"))
    return t("events").select("event_id", jv.merged(base, over).alias("merged"))


def _shared(spark) -> str:
    """A fresh folder below the one that driver and executors share."""
    ops.settled(spark.range(1))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("sc4_sc5_json_scan", "SELECT 'event_type=' || event_type AS run, count(*) AS records, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, 0 AS missing FROM events GROUP BY 1")
def _(t):
    # The events as JSON files in a folder for each type, scanned again with a column that no file has.
    spark, e = t("events").sparkSession, t("events")
    folder = _shared(spark)
    e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).write.partitionBy("event_type").json(folder)
    rows = json_files.records(spark, folder, "event_id long, k long, note string")
    per = json_files.catalogue(rows).select("run", "records")
    return rows.groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("run")).agg(F.sum("k").alias("k"), F.count("note").cast("int").alias("missing")).join(per, "run").select("run", "records", "k", "missing")


def _streamed(t, transform, keys: list[str]):
    """What a stream of the events, transformed and appended to a table until all is read, leaves there."""
    spark, e = t("events").sparkSession, t("events")
    path = t("events").inputFiles()[0]
    folder = _shared(spark)
    source = spark.readStream.schema(e.schema).option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])
    run = transform(source).writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/log").select(*keys)


@query("st9_event_log", "SELECT event_id, event_type FROM events WHERE event_id > 500 QUALIFY row_number() OVER (ORDER BY event_id) <= 200")
def _(t):
    # An append-only log, read forward from a cursor.
    log = _streamed(t, lambda s: s.select("event_id", "event_type"), ["event_id", "event_type"])
    return log.where("event_id > 500").orderBy("event_id").limit(200)


@query("st10_idempotent_commands", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return _streamed(t, lambda s: s.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), ["user_id", "event_type"])


@query("st7_outbox", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def _(t):
    # Every batch goes to a folder of its own number, so that a batch that comes again replaces what it wrote.
    spark, e, folder = t("events").sparkSession, t("events"), _shared(t("events").sparkSession)
    path = e.inputFiles()[0]
    rows = spark.readStream.schema(e.schema).option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])

    def project(batch, number):
        batch.dropDuplicates(["event_id"]).select("event_id", "value").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    rows.where("event_type = 'purchase'").writeStream.foreachBatch(project).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").dropDuplicates(["event_id"]).select("event_id", "value")
