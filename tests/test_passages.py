"""Chunkers, quote location and number audits against plain statements of their rules."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import passages as ps
from tessera.functions import quotes as qt

DATA = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(3)
    parts = ["word ", "a.b ", "end. ", "stop! ", "\n\n", "x" * 700, "“quote.” ", "数。", "\n"]
    return ["", " ", "x" * 13_000, "." * 7000, "😀. " * 900] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(30)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id int, text string")


def test_passages_cover_the_text_and_end_at_the_first_boundary(rows):
    heads = F.array(F.lit(5), F.lit(900), F.lit(10**6))
    for r in rows.select("text", ps.passage_ranges(F.col("text")).alias("p"), ps.passage_ranges(F.col("text"), heads).alias("h")).collect():
        x = r["text"]
        assert "".join(x[a:b] for a, b, _ in r["p"]) == x == "".join(x[a:b] for a, b, _ in r["h"])
        assert all(not a < h < b for a, b, _ in r["h"] for h in (5, 900))
        for a, b, hard in r["p"]:
            ends = [m.end() for m in re.finditer(ps.ENDS, x) if m.end() >= min(a + 2400, len(x))]
            first = ends[0] if ends and ends[0] <= a + 6000 else None
            assert b == (first or min(a + 6000, len(x))) and hard == (first is None and b < len(x))


def test_other_ranges(spark, rows):
    for r in rows.select("text", ps.sentence_list(F.col("text")).alias("s"), ps.paragraph_ranges(F.col("text")).alias("p")).collect():
        x = r["text"]
        assert "".join("".join(r["s"]).split()) == "".join(x.split())
        assert all(a < b <= c for (a, b), (c, _) in zip(r["p"], r["p"][1:])) and all(b - a <= 1200 or "\n" not in x[a:b] for a, b in r["p"])
    similar = {}
    for r in ps.similar_ranges(rows).orderBy("start").collect():
        similar.setdefault(r["id"], []).append((r["start"], r["end"]))
    for k, x in enumerate(texts()):
        assert "".join(x[a:b] for a, b in similar.get(k, [])) == x and all(b - a <= 6000 for a, b in similar.get(k, []))
    few = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two. Three."), (4, "ab\n12\ncd\nef")], "id int, text string").orderBy("id")
    got = few.select(F.size(ps.passage_ranges(F.col("text"))), ps.paragraph_ranges(F.col("text")), ps.sentence_list(F.col("text"), 9)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1] and [tuple(x) for x in got[3][1]] == [(0, 2), (6, 11)] and got[2][2] == ["One. Two.", "Three."]


def test_similar_ranges_part_where_neighbours_differ(spark):
    cats, dogs = "cats purr and cats sleep all day long in the sun. ", "dogs bark while dogs run through some muddy field. "
    text = cats * 33 + dogs * 40
    got = [tuple(r) for r in ps.similar_ranges(spark.createDataFrame([(1, text)], "id int, text string")).select("start", "end").orderBy("start").collect()]
    cut_at = len(cats) * 33
    assert got[0][0] == 0 and abs(got[0][1] - cut_at) <= 450


def test_similar_ranges_stay_in_their_row(spark):
    few = spark.createDataFrame([(1, "One. " * 300), (1, "Two words. " * 200), (2, ""), (3, None)], "id int, text string")
    out = ps.similar_ranges(few)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    # Texts with one id aren't mixed up, and texts without a unit have no range.
    got = [tuple(r) for r in out.select("id", F.length("text").alias("n"), "start", "end").orderBy("n", "start").collect()]
    assert {g[:2] for g in got} == {(1, 1500), (1, 2200)} and [g[2] for g in got if g[2] == 0] == [0, 0] and {g[1] for g in got if g[3] == g[1]} == {1500, 2200}


def test_quotes(spark):
    cases = [
        ("ＲＡＧ “works”", 'x rag\n"works" y', False, (2, 13)),
        ("retrieval", "re-\ntrieval", False, (0, 11)),
        ("pseudo-documents", "a pseudo-\ndocuments", False, (2, 19)),
        ("RAG", "rag", True, None),
        ("ﬁt", "fit", True, (0, 3)),
        ("office find", "the oﬃce ﬁnd it", False, (4, 12)),
        ("", "x", False, None),
        ("7-8", "78", False, None),
        ("b c", "😀 a b\nc", False, (4, 7)),
        ("z", "a", False, None),
        (None, "x", False, None),
        ("y", None, False, None),
        ("a.[b]^c\\d&&e", "xa.[b]^c\\d&&e", False, (1, 13)),
        ("it's", "it’s", False, (0, 4)),
        ("5′", "5'", True, None),
        ("STRASSE", "die Straße", False, (4, 10)),
        ("Maß", "a MASS b", False, (2, 6)),
    ]
    for strict in (False, True):
        some = [c for c in cases if c[2] == strict]
        df = spark.createDataFrame([(k, q, x) for k, (q, x, _, _) in enumerate(some)], "k int, q string, x string")
        got = {r["k"]: r["s"] and tuple(r["s"]) for r in df.select("k", qt.quote_span(F.col("q"), F.col("x"), strict).alias("s")).collect()}
        assert [got[k] for k in range(len(some))] == [c[3] for c in some]


def test_numbers(spark):
    def shown(x, spelt=False):
        return [(r["text"], r["unit"]) for r in spark.range(1).select(F.explode(qt.quantities(F.lit(x), spelt)).alias("n")).select("n.*").collect()]

    def unsupported(statement, quotes):
        given = F.array(*map(F.lit, quotes)) if quotes else F.array().cast("array<string>")
        return [r["text"] for r in spark.range(1).select(F.explode(qt.unsupported(F.lit(statement), given)).alias("n")).select("n.*").collect()]

    assert shown("gte-3000 in Table 2 [3, 4] (2024) has 1,024 of 5-10 % and .5") == [("1,024", ""), ("5", ""), ("10", "percent"), (".5", "")]
    assert shown("seven runs, Section two, twenty-one", spelt=True) == [("seven", "")]
    assert shown("-3 to +4, v2.1, 3 个百分点, Smith et al., 2019 and 2019") == [("-3", ""), ("+4", ""), ("3", "points"), ("2019", "")]
    assert unsupported("from 80 to 92, up 15% or 12", ["scores 80 and 92"]) == []
    assert unsupported("0.5 is 50 % but 7", ["0.5 there"]) == ["7"]
    assert unsupported("2.5", ["2.50"]) == [] and unsupported("", []) == [] and unsupported("three is 3", ["three"]) == []


def plain_left_over(stated, known):
    """Every ordered pair of supported numbers, one after the other."""
    have = {Fraction(v) for v in known}
    stands = [Fraction(v) in have or bool(unit) and Fraction(v) / 100 in have for _, v, unit in stated]
    held = [Fraction(v) for (_, v, _), ok in zip(stated, stands, strict=True) if ok]

    def shown(x, text):
        scale = 10 ** len(text.partition(".")[2])
        return Fraction(int(abs(x) * scale + Fraction(1, 2)) * (1 if x >= 0 else -1), scale)

    out = []
    for (text, v, unit), ok in zip(stated, stands, strict=True):
        made = []
        for i, a in enumerate(held):
            for j, b in enumerate(held):
                if i != j:
                    made += [a - b, a + b] + ([a / b] if b else []) + ([(a - b) / b * 100] if b and unit == "percent" else []) + ([(a - b) * 100] if unit == "points" and 0 <= a <= 1 and 0 <= b <= 1 else [])
        if not ok and not any(shown(x, text) == Fraction(v) for x in made):
            out.append(text)
    return out


def test_unsupported_numbers_against_all_pairs(spark):
    rng = random.Random(7)
    number = lambda: rng.choice([str(rng.randint(0, 20)), f"{rng.randint(0, 3)}.{rng.randint(0, 99)}", f"-{rng.randint(1, 9)}", f"0.{rng.randint(1, 9)}", f"{rng.randint(1, 10**30)}"]) + rng.choice(["", "", " %", " 百分点"])
    rows = [(k, " and ".join(number() for _ in range(rng.randint(0, 6))), [" or ".join(number() for _ in range(rng.randint(0, 6))) for _ in range(2)]) for k in range(400)]
    rows += [(900 + k, f"{x} is " + x, [x + " there"]) for k, x in enumerate(["123456789012345678901234567890", "1,000.50", "seven"])]
    df = spark.createDataFrame([*rows, (990, None, ["1"]), (991, "5", None)], "k int, s string, q array<string>")
    got = df.select("k", qt.quantities(F.col("s")).alias("n"), F.flatten(F.transform("q", lambda q: qt.quantities(q, spelt=True))).alias("known"), qt.unsupported(F.col("s"), F.col("q")).alias("u")).collect()
    for r in got:
        if r["k"] < 990:
            assert [u["text"] for u in r["u"]] == plain_left_over([tuple(n) for n in r["n"]], [n["value"] for n in r["known"]]), r["k"]
    assert sum(bool(r["u"]) for r in got) > 50 and {r["k"]: r["u"] for r in got}[990] is None and [u["text"] for u in {r["k"]: r["u"] for r in got}[991]] == ["5"]


def test_long_numbers_support_one_another_only_digit_by_digit(spark):
    def unsupported(statement, quote):
        return [r["text"] for r in spark.range(1).select(F.explode(qt.unsupported(F.lit(statement), F.array(F.lit(quote)))).alias("n")).select("n.*").collect()]

    long = "123456789012345678901234567890"
    assert unsupported(f"is {long} here", f"is {'9' * 30} here") == [long]
    assert unsupported(f"is {long} here", "is -1 here") == [long]
    assert unsupported(f"is {long}.0 here", f"is {long} here") == []
    assert unsupported(f"{long} and 1 make 123456789012345678901234567891", f"{long}, 1") == []


def test_unsupported_numbers_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(first) + 1, F.length("text"))
    rows = docs.select("doc_id", qt.quantities(first).alias("n"), qt.quantities(rest, spelt=True).alias("known")).collect()
    want = {r["doc_id"]: " ".join(plain_left_over([tuple(n) for n in r["n"]], [n["value"] for n in r["known"]])) for r in rows}
    assert {r["doc_id"]: r["unsupported"] for r in registry.queries()["f24_unsupported_numbers"](spark, DATA).collect()} == want and any(want.values())


def test_queries_without_sql_cover_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("c2_lossless_passages", "c5_structure_ranges", "c6_similarity_ranges"):
        out = registry.queries()[name](spark, DATA).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
        assert out.join(docs, "doc_id").where(F.col("n") != F.length("text")).isEmpty()
        assert out.count() == docs.where("length(text) > 0").count()
    for name in ("c3_paragraph_chunks", "c4_sentences", "f2_nfkc", "f23_numbers", "f24_unsupported_numbers"):
        assert registry.queries()[name](spark, DATA).count() > 0


def test_letters_written_together_in_any_way(spark):
    # Every spelling of a row of letters with or without ligatures is found by every other one.
    forms = {"als ß sch": ["als ß sch", "alß s sch", "ALSSSSCH", "als sß ch", "als ss sch"], "offit": ["offit", "oﬀit", "ofﬁt", "oﬃt"], "masst": ["masst", "maßt", "masﬆ"]}
    rows = [(a, b) for same in forms.values() for a in same for b in same] + [("maßt", "Mas-\nst")] + [("ssssssssss", "x" + t + "y") for t in ("ßßßßß", "sßßßßs", "ßsßsßss", "ßßßß")]
    df = spark.createDataFrame([(k, q, f"ab {x} cd" if x[0] != "x" else x) for k, (q, x) in enumerate(rows)], "k int, q string, x string")
    got = {r["k"]: r["s"] is not None for r in df.select("k", qt.quote_span(F.col("q"), F.col("x")).alias("s")).collect()}
    assert [rows[k] for k, ok in got.items() if not ok] == [("ssssssssss", "xßßßßy")]
    strict = df.where("k >= 25 and k < 41").select(qt.quote_span(F.col("q"), F.col("x"), strict=True).isNotNull().alias("ok")).collect()
    assert all(r["ok"] for r in strict)
