"""Zones of lines against one pass over each document, line after line."""

import random
import re
from collections import defaultdict

from tessera.operators import zoning
from tessera.plans import views

DATA = "/root/testdata/sf0.001"
ABSTRACT = re.compile(r"^(摘\s*要|abstract)(\s*[:：]|\s*$)", re.I)
KEYWORDS = re.compile(r"^(关\s*键\s*词|keywords?|key words)(\s*[:：]|\s*$)", re.I)
REFERENCES = re.compile(r"^(\d+[.、]?\s*)?(参考文献|references|bibliography)\s*$", re.I)
APPENDIX = re.compile(r"^((?i:appendix|appendices)\b|附录|[A-H](\.\d+)*\s+[A-Z])")
NAMES = re.compile(r"(introduction|conclusions?|acknowledge?ments?|limitations)", re.I)
BELONGS = re.compile(r"大学|学院|研究所|实验室|邮编|@|\b(university|institute|laboratory|department|school)\b", re.I)


def heading(x):
    return len(x) < 100 and not re.search("[。！？.!?]$", x) and bool(re.match(r"\d+(\.\d+)*[.、]?\s+\D|[一二三四五六七八九十]+、", x) or NAMES.fullmatch(x) or APPENDIX.match(x))


def structured(x):
    bare = "".join(x.split())
    return sum(c.isdigit() or c in "=+*/\\<>|{}_^%∑∫≈≤≥" for c in bare) * 10 > 3 * len(bare) or bool(re.search(r"[=∑∫\t]|\s{3,}", x)) or bool(re.match(r"(def |class |import |return |for .+ in |SELECT |```)", x))


def entry(x):
    return bool(re.match(r"(\[\d+\]\s*[A-Z㐀-鿿]|[A-Z][A-Za-z’'-]+[ ,.]+[A-Z]|[㐀-鿿]{2,}[，,、])", x) and re.search(r"\b(19|20)\d{2}[a-z]?[.。 ]", x) and len(x) > 25)


def plain_zones(lines):
    """lines (page, i, text) of a document in order -> their kinds."""
    pages = defaultdict(list)
    for page, _, x in lines:
        pages[page].append(x)
    edge = lambda page, k: "header" if k < 2 else "footer" if k >= len(pages[page]) - 2 else None
    seen = defaultdict(set)
    signature = lambda x: re.sub(r"\d+", "#", "".join(x.lower().split()))
    for page, rows in pages.items():
        for k, x in enumerate(rows):
            seen[edge(page, k), signature(x)].add(page)
    kinds = []
    for page, rows in pages.items():
        for k, x in enumerate(rows):
            e = edge(page, k)
            kinds.append(e if e and (len(seen[e, signature(x)]) > 1 and len(x) < 200 or re.fullmatch(r"[-–—]?\s*\d{1,5}\s*[-–—]?", x)) else None)
    prefix = []
    for k, (page, _, x) in enumerate(lines):
        if page > 1:
            break
        if ABSTRACT.match(x) and not KEYWORDS.match(x):
            texts = [lines[j][2] for j in prefix]
            if len(prefix) <= 24 and any(map(BELONGS.search, texts)) and not any(re.search("[。！？.!?]$", t) for t in texts):
                for j in prefix:
                    kinds[j] = "front_matter"
        if ABSTRACT.match(x) or KEYWORDS.match(x) or re.match(r"(1\s+)?(引言|introduction)\s*$", x, re.I):
            prefix = []
        elif kinds[k] is None:
            prefix.append(k)
    abstract = references = False
    for k, (_, _, x) in enumerate(lines):
        if kinds[k]:
            abstract = abstract and kinds[k] != "front_matter"
            continue
        if REFERENCES.match(x):
            after = [lines[j][2] for j in range(k + 1, min(k + 9, len(lines))) if kinds[j] not in ("header", "footer")]
            references, abstract = entry(" ".join(after[:4])), False
        if references and APPENDIX.match(x) and heading(x) and not re.search(r"[,，]|\b(19|20)\d{2}\b", x):
            references = False
        kinds[k] = "references" if references else "abstract" if ABSTRACT.match(x) else "keywords" if KEYWORDS.match(x) else "heading" if heading(x) else "caption" if re.match(r"([图表]\s*\d|(figure|table)\s+\d+[.: ])", x, re.I) else "other" if structured(x) else "abstract" if abstract else "paragraph"
        if not references and kinds[k] != "other" and (ABSTRACT.match(x) or kinds[k] in ("keywords", "heading", "caption")):
            abstract = kinds[k] == "abstract"
    return kinds


def check(got, rows):
    docs = defaultdict(list)
    for doc, page, i, text in sorted(rows, key=lambda r: r[:3]):
        if text:
            docs[doc].append((page, i, text))
    found = {(r["doc"], r["page"], r["i"]): r["kind"] for r in got}
    seen = set()
    for doc, lines in docs.items():
        kinds = plain_zones(lines)
        seen |= set(kinds)
        assert [found.pop((doc, p, i)) for p, i, _ in lines] == kinds, doc
    assert not found
    return seen


def test_zones_of_random_lines(spark):
    rng = random.Random(3)
    some = ["Abstract", "摘 要：", "Keywords: a", "Key words", "References", "3. References", "参考文献", "Appendix B", "A.1 Proofs", "附录", "1 Introduction", "Introduction", "2.1 Methods", "二、方法", "Limitations", "Figure 2: x", "Table 3 shows", "图 4", "x = y", "def f(x):", "SELECT a", "a   b   c", "12 34 56", "- 7 -", "9", "Running head 3", "University of X", "me@x.org", "A plain sentence.", "plain words go on", "[1] A. Author, a long title of a paper. 2019. x", "Smith, J. and others, a title 2020a. more", "[2] B no year here at all, none", "Appendix C, 2020"]
    rows = [(d, p, i, rng.choice(some)) for d in range(150) for p in range(1, rng.randint(2, 4)) for i in range(rng.randint(1, 14))] + [(7, 9, 0, None), (7, 9, 1, "")]
    seen = check(zoning.zones(spark.createDataFrame(rows, "doc int, page int, i int, text string")).collect(), rows)
    assert seen == {"header", "footer", "front_matter", "abstract", "keywords", "heading", "caption", "references", "other", "paragraph"}


def test_zones_of_the_whole_table(spark):
    lines = views.paged_lines(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"))
    seen = check(zoning.zones(lines).collect(), [tuple(r) for r in lines.select("doc", "page", "i", "text").collect()])
    assert {"header", "front_matter", "abstract", "keywords", "heading", "references", "other", "paragraph"} <= seen
