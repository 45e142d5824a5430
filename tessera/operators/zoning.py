"""Lines of paged documents in zones, without geometry: margins, front matter, abstract, keywords, headings, captions, references, other, paragraphs.

Lines are (doc, page, i, text): page from 1, i from 0 within the page, text trimmed and not empty. All states are windows over a document's lines in
order: margins are what repeats at the edges of pages, but for its digits; front matter is what stands before an abstract on the first page with an
affiliation and no prose; references begin at their heading if an entry follows, and end at an appendix; an abstract goes on until another section begins.
A document is read by one task at a time and in order, as a state over its lines means. Null texts are no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words of section heads, affiliations, captions and code.
ABSTRACT, CJK_ABSTRACT = ("abstract",), (r"摘\s*要",)
KEYWORDS, CJK_KEYWORDS = ("keyword", "keywords", "key words"), (r"关\s*键\s*词",)
REFERENCES = ("参考文献", "references", "bibliography")
APPENDICES, CJK_APPENDIX = ("appendix", "appendices"), "附录"
SECTIONS = ("introduction", "conclusion", "conclusions", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "limitations")
AFFILIATIONS, CJK_AFFILIATIONS = ("university", "institute", "laboratory", "department", "school"), ("大学", "学院", "研究所", "实验室", "邮编")
CODE = ("def ", "class ", "import ", "return ", "for .+ in ", "SELECT ", "```")
SYMBOLS = r"[0-9=+*/\\<>|{}_^%∑∫≈≤≥]"

EDGE, FRONT, SENTENCE_END = 2, 24, r"[。！？.!?]$"


def _any(words) -> str:
    return "|".join(words)


def head_of(text: Column, words) -> Column:
    """Whether a line is one of the words, or begins with one and a colon."""
    return text.rlike(rf"(?i)^(?:{_any(words)})(?:\s*[:：]|\s*$)")


def is_appendix(text: Column) -> Column:
    return text.rlike(rf"^(?:(?i:{_any(APPENDICES)})\b|{CJK_APPENDIX}|[A-H](?:\.[0-9]+)*\s+[A-Z])")


def is_heading(text: Column) -> Column:
    """A short line without an end mark that is numbered, or a section's usual name, or an appendix."""
    numbered = text.rlike(r"^(?:[0-9]+(?:\.[0-9]+)*[.、]?\s+[^0-9]|[一二三四五六七八九十]+、)")
    return (F.length(text) < 100) & ~text.rlike(SENTENCE_END) & (numbered | F.lower(text).isin(*SECTIONS) | is_appendix(text))


def is_structured(text: Column) -> Column:
    """Tables, equations, code and columns: many symbols, wide gaps, or how code begins."""
    bare = F.regexp_replace(text, r"\s+", "")
    return (10 * F.regexp_count(bare, F.lit(SYMBOLS)) > 3 * F.length(bare)) | text.rlike(r"[=∑∫\t]|\s{3,}") | text.rlike(rf"^(?:{_any(CODE)})")


def is_entry(text: Column) -> Column:
    """Whether joined lines begin like a reference: a number in brackets or names, and a year further on."""
    begins = text.rlike(r"^(?:\[[0-9]+\]\s*[A-Z\x{3400}-\x{9FFF}]|[A-Z][A-Za-z’'-]+[ ,.]+[A-Z]|[\x{3400}-\x{9FFF}]{2,}[，,、])")
    return begins & text.rlike(r"\b(?:19|20)[0-9]{2}[a-z]?[.。 ]") & (F.length(text) > 25)


def margins(lines: DataFrame) -> DataFrame:
    """lines with margin: header or footer for what repeats on two pages there, or is a page number alone; else null."""
    n = F.count("*").over(Window.partitionBy("doc", "page"))
    edge = F.when(F.col("i") < EDGE, "header").when(F.col("i") >= n - EDGE, "footer")
    lines = lines.withColumn("edge", edge).withColumn("sig", F.regexp_replace(F.regexp_replace(F.lower("text"), r"\s+", ""), "[0-9]+", "#"))
    same = Window.partitionBy("doc", "edge", "sig")
    often = (F.min("page").over(same) < F.max("page").over(same)) & (F.length("text") < 200)
    number = F.col("text").rlike(r"^[-–—]?\s*[0-9]{1,5}\s*[-–—]?$")
    return lines.withColumn("margin", F.when(F.col("edge").isNotNull() & (often | number), F.col("edge"))).drop("edge", "sig")


def zones(lines: DataFrame) -> DataFrame:
    """(doc, page, i, text, kind) of lines (doc, page, i, text)."""
    t = F.col("text")
    order = Window.partitionBy("doc").orderBy("page", "i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = margins(lines.where(t.isNotNull() & (t != "")))
    x = x.withColumn("abs", head_of(t, ABSTRACT + CJK_ABSTRACT)).withColumn("key", head_of(t, KEYWORDS + CJK_KEYWORDS)).withColumn("head", is_heading(t))

    # Front matter: regions of the first page, each up to and with an abstract, keywords or introduction.
    ends = F.col("abs") | F.col("key") | t.rlike(r"(?i)^(?:1\s+)?(?:引言|introduction)\s*$")
    x = x.withColumn("region", F.when(F.col("page") == 1, F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))))
    region = Window.partitionBy("doc", "region")
    body = F.col("margin").isNull() & ~ends
    paged = F.col("region").isNotNull()
    count = lambda c: F.sum((body & c).cast("int")).over(region)
    belongs = t.rlike(rf"(?i)\b(?:{_any(AFFILIATIONS)})\b|{_any(CJK_AFFILIATIONS)}|@")
    front = paged & body & F.max(F.col("abs")).over(region) & (count(F.lit(True)) <= FRONT) & (count(belongs) > 0) & (count(t.rlike(SENTENCE_END)) == 0)
    x = x.withColumn("front", F.coalesce(front, F.lit(False))).drop("region")

    # References: on at their heading if the four lines behind it, margins left out, are an entry; off at a heading of an appendix.
    heads = t.rlike(rf"(?i)^(?:[0-9]+[.、]?\s*)?(?:{_any(REFERENCES)})\s*$")
    near = F.collect_list(F.struct(F.col("margin").isNull().alias("ok"), t.alias("t"))).over(order.rowsBetween(1, 8))
    four = F.array_join(F.slice(F.transform(F.filter(near, lambda r: r["ok"]), lambda r: r["t"]), 1, 4), " ")
    skip = F.col("margin").isNotNull() | F.col("front")
    stops = is_appendix(t) & F.col("head") & ~t.rlike(r"[,，]|\b(?:19|20)[0-9]{2}\b")
    mark = F.when(skip, F.lit(None).cast("int")).when(heads, F.when(is_entry(four), 1).otherwise(0)).when(stops, 0)
    x = x.withColumn("heads", heads).withColumn("mark", mark)
    x = x.withColumn("refs", F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.lit(0)) == 1)

    caption = t.rlike(r"(?i)^(?:[图表]\s*[0-9]|(?:figure|table)\s+[0-9]+[.: ])")
    own = F.when(F.col("refs"), "references").when(F.col("abs"), "abstract").when(F.col("key"), "keywords").when(F.col("head"), "heading").when(caption, "caption").when(is_structured(t), "other")
    x = x.withColumn("own", own)
    turn = F.when(F.col("margin").isNotNull(), F.lit(None).cast("int")).when(F.col("front"), 0).when(F.col("own") == "references", F.when(F.col("heads"), 0)).when(F.col("own") == "abstract", 1).when(F.col("own").isin("keywords", "heading", "caption") | F.col("heads"), 0)
    x = x.withColumn("turn", turn)
    inside = F.coalesce(F.last("turn", ignorenulls=True).over(upto), F.lit(0)) == 1
    kind = F.coalesce("margin", F.when(F.col("front"), "front_matter"), "own", F.when(inside, "abstract"), F.lit("paragraph"))
    return x.select("doc", "page", "i", "text", kind.alias("kind"))
