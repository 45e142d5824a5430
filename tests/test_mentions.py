"""Named comparisons against a plain search for every title at every place."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.operators import mentions

CUE = re.compile(r"\b(compare|comparison|contrast|versus|vs|differences?|respectively|separately)\b|比较|对比|区别|差异|分别(说明|介绍|解释)")
NOT = re.compile(r"\b(no|not|without|don't)\b|不要|无需|不必|不比较|不对比")


def plain(question, titles):
    norm = lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold()
    if question is None or not CUE.search(norm(question)) or NOT.search(norm(question)):
        return None
    q, owners = norm(question), {}
    for source, title in titles:
        if title is not None and source is not None and len(norm(title)) >= 4:
            owners.setdefault(norm(title), set()).add(source)
    found = []
    for title, ids in owners.items():
        for p in range(len(q) - len(title) + 1):
            word = lambda c: re.fullmatch("[a-z0-9_]", c) is not None
            inside = p > 0 and word(q[p - 1]) and word(title[0]) or p + len(title) < len(q) and word(q[p + len(title)]) and word(title[-1])
            if q.startswith(title, p) and not inside:
                found.append((p, p + len(title), ids))
    found.sort(key=lambda f: f[:2])
    if any(len(ids) > 1 for *_, ids in found) or any(a[1] > b[0] for a, b in zip(found, found[1:], strict=False)):
        return None
    out = list(dict.fromkeys(next(iter(ids)) for *_, ids in found))
    return out if len(out) > 1 else None


def test_named_comparisons(spark):
    titles = [("s1", "Alpha Model"), ("s2", "Beta-Net 2"), ("s3", "Alpha"), ("s4", "深度学习综述"), ("s5", "神经网络基础"), ("s6", "Shared Title"), ("s7", "shared  TITLE"), ("s8", "abc"), ("s9", None), (None, "Nobody Here"), ("s2", "beta two"), ("s10", "(Bracketed)")]
    rng = random.Random(4)
    parts = ["Alpha Model", "beta-net 2", "Alpha", "alphabet", "Beta-Net 22", "深度学习综述", "神经网络基础", "Shared Title", "abc", "Nobody Here", "BETA TWO", "(bracketed)", "ＡＬＰＨＡ", "Model"]
    questions = [f"{rng.choice(['Compare', 'compare', 'what is', '比较', 'do not compare', 'Without contrast:'])} {rng.choice(parts)} {rng.choice(['with', 'and', '和', 'vs.', ''])} {rng.choice(parts)}{rng.choice(['', '?', ' respectively', ' and ' + rng.choice(parts)])}" for _ in range(400)]
    questions += ["比较深度学习综述和神经网络基础", "vs", "", "compare xAlpha Model with Beta-Net 2", "Compare Alpha, Beta-Net 2, Alpha"]
    df = spark.createDataFrame([*enumerate(questions), (9000, None)], "question int, text string")
    got = {r["question"]: list(r["sources"]) for r in mentions.compared_sources(df, spark.createDataFrame(titles, "source string, title string")).collect()}
    want = {k: plain(q, titles) for k, q in enumerate(questions)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 40


def test_long_titles_that_begin_alike(spark):
    # Titles of one word said up to 1,500 times: each begins with all shorter ones, and what is kept of a place doesn't grow with the text behind it.
    titles = [("s1", "Alpha Model"), ("s2", "Beta-Net 2"), *((f"t{k}", "the " * k + "the") for k in range(100, 1500, 200)), ("s3", "alpha model of the")]
    questions = ["compare " + "the " * 1450 + "with Alpha Model", "compare Alpha Model, Beta-Net 2 and the the the", "compare alpha model of the Beta-Net 2", "compare " + "the " * 101 + "and alpha model", "compare Beta-Net 2" + " the" * 301]
    df = spark.createDataFrame([*enumerate(questions)], "question int, text string")
    known = spark.createDataFrame(titles, "source string, title string")
    got = {r["question"]: list(r["sources"]) for r in mentions.compared_sources(df, known).collect()}
    want = {k: plain(q, titles) for k, q in enumerate(questions)}
    assert got == {k: v for k, v in want.items() if v} == {1: ["s1", "s2"], 3: ["t100", "s1"]}
    assert mentions.decisive(known).count() == 5
    width = mentions.found(df, mentions.decisive(known)).count()
    assert 0 < width < mentions.mentions(df, known).count() / 2


def test_titles_that_merely_begin_alike_do_not_meet(spark):
    # 600 variants of a long title, asked for two at a time: by their first words alone they would meet 360,000 times and more.
    title = lambda k: "one long title that all of these begin with and that goes on for more than thirty two words as it says the same over and over until it comes to its own number at the very end which is " + str(k)
    known = spark.createDataFrame([(f"s{k}", title(k)) for k in range(600)], "source string, title string")
    df = spark.createDataFrame([(k, f"compare {title(k)} with {title((7 * k + 1) % 600)}") for k in range(600)], "question int, text string")
    marks = mentions.marked(mentions.known_titles(known))
    assert df.select(F.sum(F.size(mentions.places(mentions.merge_key("text"), marks)))).first()[0] < 1300
    got = {r["question"]: list(r["sources"]) for r in mentions.compared_sources(df, known).collect()}
    assert got == {k: [f"s{k}", f"s{(7 * k + 1) % 600}"] for k in range(600)}
