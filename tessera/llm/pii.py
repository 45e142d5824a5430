"""Personal data by candidate gradient boosting, in DataFrame functions only.

Certain spans come from the formats of e-mail addresses, IP addresses, payment cards and phone numbers with their checks.
Beside them high-recall generators propose overlapping candidates (obfuscated addresses, IPv6, digit groups without a
plus or with other separators). A candidate is described by binned features of its format and context, never by the checks.

No label says which candidates are personal data. What is known to be is a certain span, so each of them is written anew
the way people disguise or shorten such data, half of them behind an announcing word: these are the positive rows. Negative ones are the
corpus's own candidates off the certain spans that no word announces, or whose digits fail the check. The rest has no label.
Over all documents the rows are counted per combination of features: a table whose size the bins bound. On half of
the documents boosted trees learn which combinations the positive rows have; on the other half a threshold per kind is
calibrated so that the lower bound of its precision holds. Candidates above it that pass their kind's check once they are written
plainly, and cross no certain span, are added; of overlapping ones the likeliest stays.

Null text: as the empty text, no spans. Candidates are counted over all rows, repeated ones too. No candidates at all, or
no certain spans: nothing is added. Offsets are code points. Other columns are not used.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.patterns import crosses, kind_spans, spans, written
from tessera.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")

# Possessive runs, each begun where no run can have begun before: a long run that leads to no match costs no second look.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
GENERATORS = {
    "email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}|@) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++", r"(?i)@|[(\[{]at[)\]}]"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?<![0-9])[0-9]++(?:\[?\.\]?[0-9]++){3}", r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]\[?\.\]?[0-9]"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])", r"[0-9]{4}[ .-]?[0-9]{4}"),
    "phone": (r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[ .-]\(?[0-9]{2,4}\)?){2,5}(?![0-9])", r"[0-9]\)?[ .-]\(?[0-9]"),
}
# Words that announce each kind of data, the first of them used for made rows.
CUES = {
    "email": "mail|email|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|mastercard|karte|kreditkarte|carte|tarjeta",
    "phone": "tel|phone|telephone|call|fax|mobile|telefon|handy|téléphone|teléfono",
}
#: Feature name and number of values; the code of a combination is their mixed-radix number.
BINS = (("kind", 4), ("digits", 6), ("separators", 4), ("brackets", 2), ("cue", 2), ("before", 3), ("after", 3), ("first", 4))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The digits, from the right and every second doubled, sum to a multiple of ten."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0)))) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    pattern, gate = BASE[kind]
    return F.filter(spans(text, pattern, text.rlike(gate)), lambda x: VALID[kind](x["m"]))


def binned(n: Column, *bounds: int) -> Column:
    out = F.lit(len(bounds))
    for k, b in reversed(list(enumerate(bounds))):
        out = F.when(n <= b, k).otherwise(out)
    return out


def edge(c: Column) -> Column:
    """0: white space or none, 1: punctuation, 2: a letter or digit."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(1)


def announced(kind: int, pre: Column) -> Column:
    return pre.rlike(rf"(?iu)(?<!\p{{L}})(?:{CUES[KINDS[kind]]})(?!\p{{L}})")


def code_of(kind: int, m: Column, pre: Column, post: Column) -> Column:
    values = (
        F.lit(kind),
        binned(F.length(digits(m)), 6, 8, 11, 14, 16),
        binned(F.length(F.regexp_replace(m, r"[^ .:@-]", "")), 0, 1, 3),
        m.rlike(r"[()\[\]{}]").cast("int"),
        announced(kind, pre).cast("int"),
        edge(F.right(pre, F.lit(1))),
        edge(F.left(post, F.lit(1))),
        F.when(m.startswith("+"), 0).when(m.startswith("("), 1).when(m.rlike("^[0-9]"), 2).otherwise(3),
    )
    out = F.lit(0)
    for (_, n), v in zip(BINS, values, strict=True):
        out = out * n + v
    return out.cast("int")


def passes(kind: int, m: Column) -> Column:
    """Whether a candidate, once written plainly, is one of its kind."""
    d = digits(m)
    return [
        lambda: m.rlike(r"(?i)(?:\.|dot[)\]])\s*[a-z]{2,}$"),
        lambda: m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | F.regexp_replace(m, r"[\[\]]", "").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        lambda: F.length(d).between(12, 19) & luhn(d),
        lambda: F.length(d).between(9, 15),
    ][kind]()


def disguised(kind: int, m: Column, pick: Column) -> Column:
    """A certain span written otherwise; pick, a number from 0 on, chooses the way."""
    octets = F.transform(F.split(m, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0"))
    six = F.concat(F.lit("2001:db8:0:0:0:0:"), octets[0], octets[1], F.lit(":"), octets[2], octets[3])
    fours = F.regexp_replace(digits(m), "([0-9]{4})(?=[0-9])", "$1.")
    ways = [
        [F.replace(F.replace(m, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), F.replace(m, F.lit("@"), F.lit("[at]"))],
        [F.replace(m, F.lit("."), F.lit("[.]")), six],
        [fours],
        [F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00")],
    ][kind]
    return F.when(pick % 2 == 0, ways[0]).otherwise(ways[-1])


def taught(kind: int, found: Column, key: Column) -> Column:
    """array<int>: the codes of the certain spans, each disguised, and announced or left in its context by turns."""

    def code(x: Column) -> Column:
        pick = F.pmod(F.xxhash64(key, x["s"], x["m"]), F.lit(4))
        pre = F.when(pick < 2, F.lit(CUES[KINDS[kind]].split("|")[0] + ": ")).otherwise(x["pre"])
        return code_of(kind, disguised(kind, x["m"], pick), pre, x["post"])

    return F.transform(found, code)


def candidates(text: Column) -> Column:
    """array<struct<s, e, k, code, cue, ok>> of all generators."""

    def of(k: int) -> Column:
        pattern, gate = GENERATORS[KINDS[k]]
        cells = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), code_of(k, x["m"], x["pre"], x["post"]).alias("code"), announced(k, x["pre"]).alias("cue"), passes(k, x["m"]).alias("ok"))
        return F.transform(spans(text, pattern, text.rlike(gate)), cells)

    return F.concat(*[of(k) for k in range(len(KINDS))])


def unpacked(code: Column) -> list[Column]:
    out, rest = [], code
    for name, n in reversed(BINS):
        out.append((rest % n).cast("double").alias(name))
        rest = F.floor(rest / n)
    return out[::-1]


def wilson(hits: int, n: int, z: float = 1.96) -> float:
    """The lower bound of a rate."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def selected_codes(counts: DataFrame, precision: float, trees: int, depth: int, seed: int) -> dict[int, float]:
    """Feature combinations above their kind's calibrated threshold with their probability, from counts (code, label, fold, n)."""
    wide = counts.groupBy("code").pivot("fold", [0, 1]).agg(F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("p"), F.sum("n").alias("n")).na.fill(0)
    names = [b for b, _ in BINS]
    rows = wide.select("code", *[F.col(c).cast("long").alias(c) for c in ("0_p", "0_n", "1_p", "1_n")], *unpacked(F.col("code")))
    rows = stored(VectorAssembler(inputCols=names, outputCol="features").transform(rows).coalesce(1), "combinations")
    train = rows.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("0_p").cast("double").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("0_n") - F.col("0_p")).cast("double").alias("w")))).alias("x")).select("features", "x.label", "x.w").where("w > 0")
    labels = {r["label"] for r in train.select("label").distinct().collect()}
    if 1.0 not in labels:
        return {}
    if labels == {1.0}:
        scored = rows.select("code", "kind", "1_p", "1_n", F.lit(1.0).alias("p")).collect()
    else:
        model = GBTClassifier(weightCol="w", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(train)
        scored = model.transform(rows).select("code", "kind", "1_p", "1_n", vector_to_array("probability")[1].alias("p")).collect()
    out = {}
    for k in range(len(KINDS)):
        own = sorted((r for r in scored if r["kind"] == k), key=lambda r: (-r["p"], r["code"]))
        hits = n = best = 0
        for i, r in enumerate(own):
            hits, n = hits + r["1_p"], n + r["1_n"]
            if n and wilson(hits, n) >= precision and (i + 1 == len(own) or own[i + 1]["p"] < r["p"]):
                best = i + 1
        out |= {r["code"]: r["p"] for r in own[:best]}
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.8, trees: int = 12, depth: int = 4, seed: int = 5) -> DataFrame:
    """One row per row of docs: id, email, ip, card, phone (certain spans, struct s, e, m, ...), sure (all of them) and added (struct s, k, e)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], candidates(F.col("text")).alias("found"))
    rows = rows.withColumn("sure", F.concat(*[kind_spans(k, F.col(kind)) for k, kind in enumerate(KINDS)]))
    rows = rows.withColumn("found", F.filter("found", lambda c: ~crosses(c, F.col("sure"))))
    rows = rows.withColumn("taught", F.concat(*[taught(k, F.col(kind), F.xxhash64("id")) for k, kind in enumerate(KINDS)]))
    rows = stored(rows, "personal-data")
    negative = F.transform(F.filter("found", lambda c: ~c["cue"] | ~c["ok"]), lambda c: F.struct(c["code"].alias("code"), F.lit(0).alias("label")))
    labelled = F.concat(F.transform("taught", lambda c: F.struct(c.alias("code"), F.lit(1).alias("label"))), negative)
    each = rows.select(F.pmod(F.xxhash64("id"), F.lit(2)).alias("fold"), F.explode(labelled).alias("c"))
    counts = each.groupBy("c.code", "c.label", "fold").agg(F.count("*").alias("n"))
    codes = selected_codes(counts, precision, trees, depth, seed)
    score = F.create_map(*[F.lit(x) for c in codes.items() for x in c]) if codes else F.lit(None).cast("map<int,double>")
    scored = F.transform(F.filter("found", lambda c: c["ok"]), lambda c: F.struct((-score[c["code"]]).alias("p"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    best = F.array_sort(F.filter(scored, lambda c: c["p"].isNotNull()))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    take = lambda acc, c: F.when(crosses(c, acc), acc).otherwise(F.concat(acc, F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))))
    return rows.select("id", *KINDS, "sure", F.aggregate(best, none, take).alias("added"))


def pii_report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii's rows."""
    base = written(KINDS, F.col("sure"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        written(KINDS, F.concat("sure", "added")).alias("spans"),
    )


def redact(found: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text) with every span of a document replaced by its kind in brackets; overlapping spans count as the first one."""
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)
    both = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(found.select("id", F.array_sort(F.concat("sure", "added")).alias("all")), "id")
    keep = lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), name(x["k"])).alias("out"), x["e"].alias("at")))
    done = F.aggregate("all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), keep)
    return both.select("id", done.alias("r"), "text").select("id", F.concat("r.out", F.substring(F.col("text"), F.col("r.at") + 1, F.length("text"))).alias("text"))
