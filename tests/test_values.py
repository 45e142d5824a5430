"""Clusters from their head, formulas, glyph repair, JSON views and lease sessions against plain loops."""

import ast
import json
import random
import time
import unicodedata
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import formulas, glyphs, quotes, text
from tessera.functions import json_views as jv
from tessera.operators import clusters
from tessera.streaming import queue


def plain_heads(values: list[int], gap: int) -> dict[int, int]:
    out, head = {}, None
    for x in sorted(values):
        head = x if head is None or x - head > gap else head
        out[x] = head
    return out


@pytest.mark.parametrize("gap", [0, 1, 7, 100])
def test_clusters_from_their_head(spark, gap):
    rng = random.Random(gap)
    rows = [(k, rng.randint(-300, 300) if k < 3 else j * (gap + rng.randint(0, 1))) for k in range(5) for j in range(150)] + [(9, 5), (9, 5)]
    df = spark.createDataFrame([*rows, (None, 1), (1, None)], "k int, x long").repartition(3)
    want = {k: plain_heads([x for i, x in rows if i == k], gap) for k in {k for k, _ in rows}}
    got = clusters.head_clusters(df, "k", "x", gap)
    assert got.columns == ["k", "x", "head"] and sorted(map(tuple, got.collect())) == sorted((k, x, want[k][x]) for k, x in rows)
    assert clusters.head_clusters(df.where("false"), "k", "x", gap).count() == 0


def test_pointers_pass_over_many_empty_buckets(spark):
    xs = [0, 3, 10, 11, 50_000, 50_001, 1_000_000_000, 1_000_000_020]
    df = spark.createDataFrame([(1, x) for x in xs], "key int, x long")
    got = {r["x"]: r["to"] for r in clusters._pointers(df, 5, 5, coarse=4).collect()}
    assert got == {x: min((y for y in xs if y > x + 5), default=None) for x in xs}


def plain_value(text: str, names: dict) -> float | str:
    """The value by Python's own parser, or why there is none."""
    used = set()

    class Refused(Exception):
        pass

    def check(v):
        if not abs(v) <= 1e12:
            raise Refused("range")
        return v

    def of(n):
        match n:
            case ast.Constant(value=bool() | str() | None):
                raise Refused("unsupported")
            case ast.Constant(value=v):
                return check(float(v))
            case ast.Name(id=name):
                if name not in names:
                    raise Refused("undeclared")
                used.add(name)
                return check(names[name])
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return check(of(x))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return check(-of(x))
            case ast.BinOp(left=a, op=op, right=b):
                a, b = of(a), of(b)
                if isinstance(op, ast.Div) and b == 0:
                    raise Refused("zero")
                return check(a + b if isinstance(op, ast.Add) else a - b if isinstance(op, ast.Sub) else a * b if isinstance(op, ast.Mult) else a / b)
        raise Refused("unsupported")

    try:
        tree = ast.parse(text.strip(), mode="eval").body
        if any(isinstance(n, (ast.Pow, ast.FloorDiv, ast.Call, ast.Tuple, ast.Mod)) for n in ast.walk(tree)):
            return "unsupported"
        v = of(tree)
    except (SyntaxError, ValueError):
        return "unsupported"
    except Refused as e:
        return e.args[0]
    return v if used == set(names) else "unused"


def test_formulas_against_pythons_parser(spark):
    rng = random.Random(3)

    def formula(depth: int) -> str:
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["a", "b", "2", "0.5", "1e3", ".25", "7.", "0", "3e11", "zz"] if rng.random() < 0.2 else ["a", "b", "1", "2.5"])
        if kind < 0.4:
            return rng.choice("+-") + rng.choice(["", " "]) + formula(depth - 1)
        if kind < 0.6:
            return f"({formula(depth - 1)})"
        return f"{formula(depth - 1)} {rng.choice('+-*/')}{rng.choice(['', ' '])}{formula(depth - 1)}"

    texts = [formula(rng.randint(0, 4)) for _ in range(250)]
    texts += ["", " ", "a b", "a**b", "a//b", "(a", "a)", "a + ", "* a", "a + b!", "f(a)", "a, b", "()", "--a+-+b", "a/(b-b)", "a/0*zz+b", "a*b*1e12*1e12", "((((a))))+b", "a\tb"]
    names = {"a": 3.0, "b": -2.5}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string")
    made = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    got = {r["k"]: r["e"] for r in df.select("k", formulas.evaluated(F.col("t"), made).alias("e")).collect()}
    for k, t in enumerate(texts):
        want = plain_value(t, names)
        assert (got[k]["why"] or got[k]["value"]) == want or got[k]["value"] == want, (t, want, got[k])
    assert got[-1]["why"] == "unsupported"


def test_glyphs(spark):
    shift = lambda t: "".join(chr(0x5B00 + ord(c)) if 0x21 <= ord(c) <= 0x7E else c for c in t)
    clean = ["plain text", "子孔孕字存孙孝孟季孤孩孫 孔子", "普通中文 abc", "", "婀婁婂 ordinary"]
    broken = ["Retrieval augmented generation 2024!", "see (Smith et al.)", "x" * 3 + "abcdefgh"]
    rows = [(k, t, t) for k, t in enumerate(clean)] + [(10 + k, t, shift(t)) for k, t in enumerate(broken)] + [(20, "office flow affixed", "oﬃce"), (21, None, None)]
    lig = "".join(chr(0x5B00 + ord(c)) for c in "o") + chr(0x5B0E) + "".join(chr(0x5B00 + ord(c)) for c in "ce-and-more")
    rows.append((22, "office-and-more", lig))
    got = {r["k"]: r for r in spark.createDataFrame(rows, "k int, t string, x string").select("k", "t", "x", glyphs.is_garbled(F.col("x")).alias("g"), glyphs.restored(F.col("x")).alias("y")).collect()}
    assert all(got[k]["y"] == t and not got[k]["g"] for k, t, x in rows if k < 10)
    assert all(got[k]["y"] == t and got[k]["g"] for k, t, x in rows if 10 <= k < 20 or k == 22)
    assert got[21]["y"] is None and got[20]["y"] == "oﬃce"
    mixed = "中文 " + shift("garbled citation here") + " 中文 good"
    assert spark.range(1).select(glyphs.restored(F.lit(mixed))).first()[0] == "中文 garbled citation here 中文 good"


def anything(rng: random.Random, depth: int):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([None, True, 1, -2.5, "", "é", "x" * rng.choice([79, 80, 81]), "y" * 200, 10**20, {"$text": 0}, {"$text": "z" * 90}, {"$text": [1]}])
    if kind < 0.65:
        return [anything(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "admin", "location", "$text", "text"]): anything(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_json_views(spark):
    rng = random.Random(9)
    values = [anything(rng, 4) for _ in range(150)]
    rows = [(k, json.dumps(v), json.dumps(rng.choice(values))) for k, v in enumerate(values)] + [(900, None, "{}"), (901, "{bad", "{}")]
    df = spark.createDataFrame(rows, "k int, x string, o string").withColumn("i", jv.interned(F.col("x")))
    df = df.select("k", "x", "o", "i", jv.restored(F.col("i.view"), F.col("i.strings")).alias("back"), jv.stripped(F.col("x"), ["admin"], ["location"]).alias("s"), jv.merged(F.col("x"), F.col("o")).alias("m"), jv.flattened(F.col("x"), ["text", "a"]).alias("f"))

    def strip(v):
        if isinstance(v, list):
            return [strip(e) for e in v]
        return {k: e if k == "location" else strip(e) for k, e in v.items() if k != "admin"} if isinstance(v, dict) else v

    def merge(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in [*a, *b]}
        return b

    def long(v):
        return [v] if isinstance(v, str) and len(v) >= 80 else [s for e in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in long(e)]

    for r in df.collect():
        if r["k"] >= 900:
            assert r["i"] is None and r["back"] is None and r["s"] is None and r["m"] is None
            continue
        v, o = json.loads(r["x"]), json.loads(r["o"])
        assert json.loads(r["back"]) == v and list(r["i"]["strings"]) == list(dict.fromkeys(long(v))) and not long(json.loads(r["i"]["view"]))
        assert json.loads(r["s"]) == strip(v) and json.loads(r["m"]) == merge(v, o)
    one = spark.range(1).select(jv.flattened(F.lit('[{"text":["a",{"a":[1.5,null,true,""]}]},{"b":"no"},"c"]'), ["text", "a"])).first()[0]
    assert one == "a 1.5 c"


def test_compact_views_of_packages(spark):
    rng = random.Random(6)
    entry = lambda t: {"id": f"{t}{rng.randint(0, 3)}"}
    packages = []
    for k in range(60):
        payload = {f"{t}{i}": {"id": f"{t}{i}", "v": [i, "é", None]} for t in "ds" for i in range(4)}
        bundle = lambda: {"n": rng.randint(0, 9), "documents": [payload[entry("d")["id"]] for _ in range(rng.randint(0, 3))], **({"sources": [payload[entry("s")["id"]]]} if rng.random() < 0.7 else {}), "other": [{"id": "d0"}]}  # noqa: B023,E731
        p = {"task": k, "bundles": [bundle() for _ in range(rng.randint(0, 4))], "end": True}
        if k % 5 == 0 and p["bundles"]:
            p["bundles"].append({"documents": [{"id": "d1", "v": 0}, {"id": "d1", "v": 1}]})
        packages.append(p)
    packages += [{}, {"bundles": None}, {"bundles": [{"documents": [{"no": "id"}]}]}]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(packages)] + [(900, None), (901, "[")], "k int, x string")
    df = df.select("k", "x", jv.compacted(F.col("x"), "bundles", ["documents", "sources"]).alias("c")).select("k", "x", "c", jv.expanded(F.col("c.view"), "bundles").alias("back"))
    for r in df.collect():
        if r["k"] >= 900:
            assert r["c"] is None
            continue
        p = packages[r["k"]]
        seen, clash = {}, None
        for b in p.get("bundles") or []:
            for t in ("documents", "sources"):
                for e in b.get(t, []):
                    if "id" in e and seen.setdefault((t, e["id"]), e) != e and clash is None:
                        clash = f"{t} {e['id']}"
        assert r["c"]["conflict"] == clash and (r["c"]["view"] is None) == (clash is not None)
        if clash is None:
            assert json.loads(r["back"]) == {**p, "bundles": p.get("bundles") or []} or json.loads(r["back"]) == p
            assert {t: set(v) for t, v in json.loads(r["c"]["view"])["tables"].items()} == {t: {i for u, i in seen if u == t} for t in ("documents", "sources")}


def test_lease_sessions_of_a_stream(spark, tmp_path):
    rng, zero = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc)
    beats = sorted((zero + timedelta(seconds=rng.random() * 90_000), rng.randint(0, 3), rng.choice([60, 900, 4000])) for _ in range(300))
    want = []
    for key in range(4):
        runs = []
        for ts, k, lease in beats:
            if k == key:
                if not runs or ts > runs[-1][2]:
                    runs.append([key, ts, ts + timedelta(seconds=lease), 0])
                runs[-1][2] = max(runs[-1][2], ts + timedelta(seconds=lease))
                runs[-1][3] += 1
        want += map(tuple, runs)
    schema = "ts timestamp, k int, lease int"
    for part in (beats[:100], beats[100:210], beats[210:], [(zero + timedelta(days=9), 99, 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs = queue.lease_sessions(stream, "k", F.col("lease"), "0 seconds")
        runs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("k < 99").select("k", "start", "end", "beats").collect()
    utc = lambda t: t.astimezone(timezone.utc).replace(tzinfo=timezone.utc)
    assert sorted((r["k"], utc(r["start"]), utc(r["end"]), r["beats"]) for r in got) == sorted(want)
    seconds = spark.createDataFrame([(0,), (3,), (30,), (900,)], "s int").select(queue.renewal_interval(F.col("s"))).collect()
    assert [round(r[0], 3) for r in seconds] == [0.333, 1.0, 10.0, 30.0]


def test_helpers_see_a_few_rows_at_a_time():
    seen = []

    def f(a, b):
        seen.append(len(a))
        return pa.array([x + y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    for n in (0, 1, 64, 150):
        assert text.sliced(f)(pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64())).to_pylist() == [2 * k for k in range(n)]
    assert seen == [0, 1, 64, 64, 64, 22]


def test_normal_forms(spark):
    texts = ["ＡＢＣ ﬁ", "é", "Ärger déjà", "深度", "", None, "½ ª", "각"] * 20
    df = spark.createDataFrame([*enumerate(texts)], "k int, x string")
    got = {r["k"]: r["y"] for r in df.select("k", quotes.nfkc(F.col("x")).alias("y")).collect()}
    assert got == {k: x and unicodedata.normalize("NFKC", x) for k, x in enumerate(texts)}


def test_a_formula_is_read_once_for_the_rows_of_a_batch(monkeypatch):
    seen, read = [], formulas.tokens
    monkeypatch.setattr(formulas, "tokens", lambda f: seen.append(f) or read(f))
    maps = pa.array([[("a", float(k))] for k in range(5000)], pa.map_(pa.string(), pa.float64()))
    got = formulas.each(pa.array(["1 / a", "a + b"] * 2500), maps, 1e12).to_pylist()
    assert sorted(seen) == ["1 / a", "a + b"]
    assert got[0] == {"value": None, "why": "zero"} and got[1] == {"value": None, "why": "undeclared"} and got[4] == {"value": 0.25, "why": None}


def test_a_runs_glyphs_are_found_once():
    assert str(glyphs.garbled(F.col("x"))).lower().count("regexp_replace") == 2


def test_numbers_behind_a_very_long_word(spark):
    # No place within a word of letters is tried on its own, so that its cost grows with its length and not with the square of it.
    began = time.monotonic()
    for spelt in (False, True):
        row = spark.range(1).select(quotes.quantities(F.concat(F.repeat(F.lit("word"), 100_000), F.lit(" 12% of 7one twenty")), spelt).alias("n")).first()
        assert [n["text"] for n in row["n"]] == ["12", *(["twenty"] if spelt else [])]
    assert time.monotonic() - began < 20
