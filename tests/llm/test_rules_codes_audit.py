"""Quality rules, vector codes and the filter audit against plain loops: nulls, empties, ties, repeats, clashing columns, and their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.llm import filter_audit, quality, queries, vector_codes

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, hits string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents() -> list[tuple]:
    """Boilerplate of two hosts, copies, repeats, null and empty texts, a null id, a null host, very long words and texts, and white space of all kinds."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        own = [line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
        mine = ["Home | About #%d" % i, "All  rights RESERVED 20%02d\r" % i, "x\ty " * 30] if i % 3 else ["Only here " * 4]
        rows.append((i, "\n".join(rng.sample(own + mine, len(own + mine))), "ab"[i % 2] if i % 7 else None))
    rows += [(5, rows[5][1], rows[5][2]), (70, rows[5][1], "a"), (71, rows[5][1], "b"), (None, rows[5][1], "a"), (72, rows[5][1], "")]
    rows += [(80, None, "a"), (81, "", "a"), (None, None, None), (82, "\n \n\t", "b"), (83, "w" * 100_000, "b"), (84, " ".join(f"w{k}" for k in range(20_000)), "a")]
    rows += [(85, "one two three one two three", "a"), (86, "THE SAME\n" * 90, "a"), (87, "a\x0bb\x0cc " * 40, "b"), (88, "Ünï $ code % & | <x> é" * 20, "b")]
    return [(*r, "x", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC).repartition(5)


def plain_quality(rows, least_docs=5, share=0.01):
    normal = lambda x: " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), x))))
    texts, having = defaultdict(set), defaultdict(set)
    for _, t, host, *_ in rows:
        texts[host].add(t or "")
        for x in (t or "").split("\n"):
            having[host, normal(x)].add(t or "")
    bad = {k for k, v in having.items() if len(v) > max(least_docs, share * len(texts[k[0]]))}
    out = []
    for i, t, host, *_ in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for p in range(len(w) - 2):
            at[tuple(w[p : p + 3])].append(p)
        rep = len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)})
        removed = sum(len(WORD.findall(x)) for x in lines if (host, normal(x)) in bad)
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, removed, failed, not failed and len(w) - removed >= 0.5 * len(w)))
    return out, bad, normal


def test_quality_against_plain_loops(docs):
    want, bad, _ = plain_quality(documents())
    got = [tuple(r) for r in quality.quality(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bad and any(w[6] and w[8] for w in want) and any(not w[7] and not w[8] for w in want)
    assert quality.quality(docs.where("1 = 0")).count() == 0


def test_quality_limits_are_parameters(docs):
    for least_docs, share in ((0, 0.5), (30, 0.0)):
        want, *_ = plain_quality(documents(), least_docs, share)
        assert sorted(map(tuple, quality.quality(docs, least_docs=least_docs, share=share).collect()), key=str) == sorted(want, key=str)


def test_many_frequent_lines_are_met_by_salted_keys(docs, monkeypatch):
    want, *_ = plain_quality(documents())
    plain = quality.met
    monkeypatch.setattr(quality, "met", lambda *a: plain(*a, small=0))
    assert sorted(map(tuple, quality.quality(docs).collect()), key=str) == sorted(want, key=str)


def test_cleaned_texts_lose_frequent_lines_only(docs):
    rows = documents()
    want, bad, normal = plain_quality(rows)
    keep = [(*r[:1], "\n".join(x for x in (r[1] or "").split("\n") if not (WORD.search(x) and (r[2], normal(x)) in bad)), *r[2:]) for r, w in zip(rows, want, strict=True) if w[8]]
    out = quality.cleaned(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(keep, key=str)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * x)) if abs(x) < 1e15 else 256 * int(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        code = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(kept, code, strict=True) if c[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    error, per = [min(sum(d for d, _ in f), 2**63 - 1) for f in found], Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        per[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min(per[label], 2**63 - 1), digest) for (i, _, label), f, e in zip(kept, found, error, strict=True)]


VEC = "vec_id long, embedding array<double>, label int, v string"


@pytest.mark.parametrize(("n", "dim", "scale"), [(150, 64, 0.3), (90, 50, 0.02), (20, 16, 3.0), (100, 48, 2e7), (80, 32, 1e12), (70, 384, 0.1)])
def test_vector_codes_against_plain_loops(spark, n, dim, scale):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, scale, dim)], [None, 1, 1, 2][i % 4]) for i in rng.permutation(n).tolist()]
    rows += [rows[0], (None, rows[1][1], 1), (n + 1, None, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [1.0, None], 2), (n + 4, [float("inf")], 2), (n + 5, [], 9), (n + 6, [0.5] * 3, None), (n + 7, [0.0] * dim, None)]
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x") for r in rows], VEC).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(rows), key=str)


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, 1, "x")], VEC)
    assert vector_codes.vector_codes(empty).count() == 0
    assert [r["code"] for r in vector_codes.vector_codes(spark.createDataFrame([(1, [], 1, "x")], VEC)).collect()] == ["00" * 16]


@pytest.mark.parametrize("n", [1, 2, 4, 8, 32])
def test_coefficients_come_by_sequency_and_keep_scaled_distances(n):
    rows = vector_codes.hadamard(np.eye(n, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(n))
    a, b = np.random.default_rng(n).integers(-99, 99, (2, 7, n))
    assert (vector_codes.squares(vector_codes.hadamard(a), vector_codes.hadamard(b)) == n * vector_codes.squares(a, b)).all()


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least: dict[str, int] = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failing = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failing.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {f[0] for f in failing}:
        mine = [f for f in failing if f[0] == part]
        shapley, steps = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] and bool(x[1] & set(order[: k - 1])) for x in mine)
                shapley[f] += len(gone)
                steps.append((part, order, k, len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return out


def test_filter_audit_against_plain_loops(spark, docs):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(90)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (999, 1, 1), (4, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, table)
    want = plain_audit(documents(), labels)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert all(any(w[4] and w[5] and w[1][w[2] - 1] == f for w in want) for f in "BCDE")
    assert filter_audit.filter_audit(docs, table.where("1 = 0")).where("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.filter_audit(docs.where("1 = 0"), table).count() == 0


@pytest.mark.parametrize("name", ["op11_quality", "op12_vector_codes", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_directories_with_zip64_records_and_extra_fields(tmp_path, monkeypatch):
    import zipfile

    import pyarrow.fs as pafs

    from tessera.llm import warc

    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # three members need the ZIP64 end record
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 8)  # sizes and offsets go to extra fields
    path = tmp_path / "a.zip"
    members = {"archive/data.warc.gz": b"x" * 5000, "é/index.cdx": b"0 10\n", "empty": b""}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in members.items():
            info = zipfile.ZipInfo(name)
            info.extra = b"\xfe\xca\x02\x00ab"  # a field of another kind before the ZIP64 one
            z.writestr(info, data)
        z.comment = b"a comment with PK\x05 in it"
    raw = path.read_bytes()
    assert warc.END64 in raw and warc.LOCATOR64 in raw
    fs, name = pafs.FileSystem.from_uri(f"file://{path}")
    with fs.open_input_file(name) as f:
        found = warc.directory(f)
        assert {k: raw[at : at + n] for k, (at, n) in found.items()} == members
