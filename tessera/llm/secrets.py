"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Certain spans come from assignments, access keys and long hex strings. Beside them generators propose further candidates:
`key` (known prefixes, private keys, web tokens, long mixed-case strings in quotes), `auth` (values of authorization headers,
passwords in URLs) and `token` (unassigned random-looking strings: mixed case with digits, or hex of 20 to 31 characters). Every
candidate's value is hashed, and the corpus is asked in how many distinct repositories and by how many distinct owners it stands:
a value that stays with one owner in few repositories looks live, one that many have is a copied example. Candidates that look
live are added, all others are not; certain spans stay, and are counted as live or copied by the same rule. A private key's
value is its body, without header, END line and line breaks (a header with no body stands for itself); a certain span inside
a key doesn't hide it, while other candidates cross no certain span and no earlier candidate.

Where a table names no repositories, each distinct text is one: copies of a text are not many uses of its secrets. A null
owner counts as one of its own. Null text: as the empty text. Repeated rows count once, as their text and owner are the same. Rows with
equal id and text get equal results. Offsets are code points. Other columns are not used. Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.patterns import crosses, kind_spans, spans, written
from tessera.llm.shared import dealt_join, stored

KINDS = ("assign", "access", "hex", "key", "auth", "token")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {
    "assign": (ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]"),
    "access": (r"AKIA[A-Z0-9]{12,}", r"AKIA"),
    "hex": (r"[0-9a-f]{32,}+", r"[0-9a-f]{32}"),
}
# The prefixes of common access tokens.
PREFIXED = r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|xox[abpr]-|sk-|sk_live_|rk_live_|AIza|ya29\.|npm_|pypi-)[A-Za-z0-9_-]{16,}"
HEADER = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
# A private key: up to its END line with no other dashes of five between, or the base64 behind its header.
PRIVATE = rf"{HEADER}(?:[^-]*+(?:-{{1,4}}+(?!-)[^-]*+)*+-----END [A-Z ]{{0,24}}PRIVATE KEY-----|(?:(?:\s|\\[nrt])*+[A-Za-z0-9+/]{{16,}}+=*+)*+)"
WEB_TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
QUOTED = r"(?<=[\"'=])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+(?=[\"'=\s]|$)"
HEADER_VALUE = r"(?i:authorization)[\"']?\s*[:=]\s*[\"']?(?i:bearer|basic|token)\s+[A-Za-z0-9+/._~-]{8,}+=*"
IN_URL = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"'<>]++:[^\s/@\"'<>]{6,}+@"
MIXED = r"(?<![A-Za-z0-9+/=_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_.@-])"
SHORT_HEX = r"(?<![A-Za-z0-9+/=_.@-])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{20,31}+(?![A-Za-z0-9+/=_@-])"
GENERATORS = {
    "key": (f"{PREFIXED}|{PRIVATE}|{WEB_TOKEN}|{QUOTED}", r"gh[pousr]_|github_pat_|glpat-|xox|sk[-_]|rk_live|AIza|ya29|npm_|pypi-|PRIVATE KEY|eyJ|[\"'=][A-Za-z0-9+/_-]{24}"),
    "auth": (f"{HEADER_VALUE}|{IN_URL}", r"(?i)authorization|://[^\s/:@]+:"),
    "token": (f"{MIXED}|{SHORT_HEX}", r"[A-Za-z0-9+/_-]{20}"),
}


def base_spans(text: Column, kind: str) -> Column:
    pattern, gate = BASE[kind]
    found = spans(text, pattern, text.rlike(gate))
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 1)) >= 8) if kind == "assign" else found


def random_looking(m: Column) -> Column:
    """Many different characters, and several digits: no word, name or path has both."""
    return (F.size(F.array_distinct(F.split(m, ""))) >= 10) & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 3)


def secret_value(kind: str, m: Column) -> Column:
    """What of a span is the secret itself."""
    body = F.regexp_replace(m, r"-----[^-]*+-----|\\[nrt]|\s", "")
    url = F.regexp_replace(m, r"^.*?://[^:]*+:|@$", "")
    return {
        "assign": lambda: F.regexp_extract(m, f"^{ASSIGN}$", 1),
        "key": lambda: F.when(m.startswith("-----BEGIN") & (body != ""), body).otherwise(m),
        "auth": lambda: F.when(m.endswith("@"), url).otherwise(F.regexp_extract(m, r"(\S+)$", 1)),
    }.get(kind, lambda: m)()


def further(text: Column, kind: str) -> Column:
    pattern, gate = GENERATORS[kind]
    found = spans(text, pattern, text.rlike(gate))
    return F.filter(found, lambda x: random_looking(x["m"])) if kind == "token" else found


def valued(kind: str, found: Column) -> Column:
    """array<struct<s, k, e, h>>: spans with the hash of their value."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.sha2(secret_value(kind, x["m"]), 256).alias("h")))


def ownership(values: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(h, repos, owners, uses, live) for each value hash of values (h, repo, owner).

    Pairs are made distinct first, with partial sums, so that a value which a third of all documents hold leaves as many rows
    as it has owners and repositories, and not as it has documents.
    """
    pairs = values.groupBy("h", "repo", "owner").agg(F.count("*").alias("uses"))
    nulls = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    repos = pairs.groupBy("h", nulls("repo").alias("repo")).agg(F.sum("uses").alias("uses")).groupBy("h").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    owners = pairs.groupBy("h", nulls("owner").alias("owner")).agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("owners"))
    return repos.join(owners, "h").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_owners: int = 1, max_repos: int = 8) -> DataFrame:
    """One row per row of docs: id, assign, access, hex (certain spans), sure (all of them as s, k, e), added, n_live, n_copied.

    n_live counts candidates, certain or not, whose value has `max_owners` owners and `max_repos` repositories at most; n_copied
    counts the others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.col(repo_col).cast("string") if repo_col else F.md5(text)).alias("repo"), F.col(owner_col).alias("owner"), text.alias("text"))
    rows = rows.select("id", "repo", "owner", F.monotonically_increasing_id().alias("row"), *[base_spans(F.col("text"), k).alias(k) for k in BASE], *[further(F.col("text"), k).alias(k) for k in GENERATORS])
    rows = rows.withColumn("sure", F.concat(*[kind_spans(k, F.col(kind)) for k, kind in enumerate(BASE)]))
    within = lambda x: F.exists("sure", lambda o: (o["s"] <= x["s"]) & (x["e"] <= o["e"]))
    free = lambda x: ~crosses(x, F.col("sure"))
    rows = rows.withColumn("key", F.filter("key", lambda x: F.when(x["m"].startswith("-----BEGIN"), ~within(x)).otherwise(free(x))))
    rows = rows.withColumn("auth", F.filter("auth", lambda x: free(x) & ~crosses(x, F.col("key"))))
    rows = rows.withColumn("token", F.filter("token", lambda x: free(x) & ~crosses(x, F.col("key")) & ~crosses(x, F.col("auth"))))
    rows = stored(rows.withColumn("all", F.concat(*[valued(k, F.col(k)) for k in KINDS])).drop(*GENERATORS), "secrets")
    each = rows.select("row", "repo", "owner", F.explode("all").alias("c")).select("row", "repo", "owner", "c.*")
    known = dealt_join(each, ownership(each.select("h", "repo", "owner"), max_owners, max_repos), ["h"], "uses", ["row", "s", "k"])
    known = known.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when((F.col("k") >= len(BASE)) & F.col("live"), F.struct("s", "k", "e")))).alias("added"),
        F.countDistinct(F.when(F.col("live"), F.struct("s", "k", "e"))).alias("n_live"),
        F.countDistinct(F.when(~F.col("live"), F.struct("s", "k", "e"))).alias("n_copied"),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    out = rows.join(known, "row", "left")
    return out.select("id", *BASE, "sure", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def secret_report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets' rows."""
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(KINDS, F.col("sure")), 256).alias("base_sha256"),
        written(KINDS, F.concat("sure", "added")).alias("spans"),
        "n_live",
        "n_copied",
    )
