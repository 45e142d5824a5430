"""The contract of covered reports against one report after the other."""

import random
from collections import Counter, defaultdict

from tessera.operators import reports


def plain(question, status, parts, findings, supports, evidence):
    broken = set()
    spans = Counter(p[1] for p in parts)
    inside = lambda quote, text: quote is not None and text is not None and "".join(quote.split()).lower() in "".join(text.split()).lower() and bool(quote.strip())
    gaps = [bool((p[3] or "").strip()) for p in parts]
    if any(not inside(p[1], question) for p in parts):
        broken.add("part_span")
    if any(n > 1 for n in spans.values()):
        broken.add("part_repeated")
    if any(not (p[2] or []) and not g for p, g in zip(parts, gaps, strict=True)):
        broken.add("part_empty")
    if sorted(i for p in parts for i in p[2] or []) != list(range(len(findings))):
        broken.add("assignment")
    if status == "complete" and any(gaps):
        broken.add("complete_with_gap")
    if status != "complete" and not any(gaps):
        broken.add("partial_without_gap")
    quotes = defaultdict(set)
    for _, e, q in evidence:
        quotes[e].add(q)
    if any(len(q) > 1 for q in quotes.values()):
        broken.add("shared_evidence")
    if len({"".join(f[2].split()).lower() for f in findings}) < len(findings):
        broken.add("repeated_assertion")
    for i, bundle, _, ids in findings:
        mine = [s for s in supports if s[0] == i]
        if set(ids) != {s[1] for s in mine}:
            broken.add("unanchored")
        if any(not any(inside(q, whole) for b, e, whole in evidence if (b, e) == (bundle, s)) for _, s, q in mine):
            broken.add("unsupported")
    return sorted(broken)


def test_contract_of_random_reports(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(n))
    tables = defaultdict(list)
    want = {}
    for r in range(250):
        good = rng.random() < 0.5
        question = words(12)
        evidence = [("b0" if k % 2 else "b1", f"e{k if good or rng.random() < 0.8 else 0}", words(8)) for k in range(4)]
        findings, supports = [], []
        for i in range(rng.randint(0, 3)):
            b, e, q = rng.choice(evidence)
            bundle = b if good or rng.random() < 0.8 else "b9"
            ids = [e] if good or rng.random() < 0.8 else [e, "e9"]
            findings.append((i, bundle, f"{words(2)} {i if good else rng.randint(0, 1)}", ids))
            supports.append((i, e, q[2:14] if good or rng.random() < 0.8 else words(3)))
        parts = []
        free = list(range(len(findings)))
        for k in range(max(1, rng.randint(1, 3))):
            take = free if good and k == 0 else [] if good else rng.sample(range(4), rng.randint(0, 2))
            parts.append((k, question[k * 5 : k * 5 + 9] if good or rng.random() < 0.6 else words(1), take or rng.choice([[], None]), rng.choice(["", None, " "]) if take else rng.choice(["left open", ""]) if not good else "left open"))
        status = "partial" if any((p[3] or "").strip() for p in parts) else "complete"
        status = status if good or rng.random() < 0.8 else rng.choice(["complete", "partial"])
        want[r] = plain(question, status, parts, findings, supports, evidence)
        tables["reports"].append((r, question, status))
        for name, rows in (("parts", parts), ("findings", findings), ("supports", supports), ("evidence", evidence)):
            tables[name] += [(r, *x) for x in rows]
    kinds = {"reports": "report int, question string, status string", "parts": "report int, part int, span string, findings array<int>, gap string", "findings": "report int, finding int, bundle string, assertion string, evidence_ids array<string>", "supports": "report int, finding int, evidence string, quote string", "evidence": "report int, bundle string, evidence string, quote string"}
    frames = {n: spark.createDataFrame(tables[n], k) for n, k in kinds.items()}
    got = {r["report"]: list(r["broken"]) for r in reports.violations(**frames).collect()}
    assert got == want
    assert {c for w in want.values() for c in w} == {"part_span", "part_repeated", "part_empty", "assignment", "complete_with_gap", "partial_without_gap", "shared_evidence", "repeated_assertion", "unanchored", "unsupported"} and [] in want.values()
    assert reports.violations(**{n: f.where("false") for n, f in frames.items()}).count() == 0
