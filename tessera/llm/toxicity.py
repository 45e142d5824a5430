"""Toxicity as a weighted finite-state pattern grammar.

A text is read as clauses of words, and each word as a symbol: insult, threat, target, negation, reported speech or other. Five
transducers read the symbols, each a table from (state, symbol) to (state, mark) choices: insults and threats mark their own
symbol; negation marks what stands within three words behind it, reported speech what comes after its verb; the target
transducer may mark an insult or threat as directed if a target stands before it in the clause, or if it guesses one
that then has to follow, else the path is void. Their composition is one table over the product of the states, and a clause is
scored by its best path: for each arc that marks an insult or a directed threat, the word's weight times that of the composed arc.

The insult transducer's words are learned: whole words and stems of five letters or more that mark toxic documents of the
training rows by a likelihood-ratio test; a stem has to tell clearly more than any word or longer stem under it. A logistic curve
over the sums that a text's best paths gather on each composed arc, and over its length, makes the score; so the weights of
the composed arcs are learned too, with a ridge towards their fixed values, as some arcs are rare. The words of the other
transducers are fixed values below.

Null or empty text: no clause matches, a score all the same. Null ids never train. Without labelled rows of both kinds the
fixed insults, arcs and curve are used. Very long texts are read whole. Other columns are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import crc_bucket

# Function words and verbs of the grammar, in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum trash worthless pathetic disgusting loser clown".split()
THREATS = "kill hurt destroy beat burn shoot stab punish töten schlagen zerstören tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u they them he she du ihr euch dich vous tu toi votre usted ustedes tú vosotros".split()
NEGATIONS = "not never don't isn't aren't kein keine niemals jamais aucun nunca jamás".split()
REPORTS = "said says wrote claimed quoted called reported sagte schrieb behauptete disait écrivait dijo escribió".split()

TOKEN = re.compile(rb"[^\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[.!?;:\n]+")
STEMS = range(5, 9)
REACH, THREAT_WEIGHT = 3, 4.0
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "IHTNRo."
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)

#: Machine: (states, choices), choices(state, symbol) being (next state, mark) pairs. State 0 is the first.
MACHINES = {
    "insult": (1, lambda s, x: [(0, "i" if x == INSULT else "")]),
    "threat": (1, lambda s, x: [(0, "h" if x == THREAT else "")]),
    "negation": (REACH + 1, lambda s, x: [(REACH if x == NEGATION else max(s - 1, 0), "n" if s else "")]),
    "report": (2, lambda s, x: [(1 if x == REPORT else s, "r" if s else "")]),
    # 0: no target yet, 1: there is one, 2: one is owed.
    "target": (3, lambda s, x: [(1, "")] if x == TARGET else [(s, "")] if x not in (INSULT, THREAT) else [(1, "d")] if s == 1 else [(s, ""), (2, "d")]),
}
OWED = 2


def composed(names: tuple[str, ...]) -> dict[tuple[tuple, str], list[tuple[tuple, str]]]:
    """The product of the machines: (states, symbol) to (states, marks)."""
    out = {}
    for states in product(*(range(MACHINES[n][0]) for n in names)):
        for x in SYMBOLS:
            choices = [MACHINES[n][1](s, x) for n, s in zip(names, states, strict=True)]
            out[states, x] = [(tuple(s for s, _ in c), "".join(m for _, m in c)) for c in product(*choices)]
    return out


#: The arcs that count, with their fixed weights: directed ones weigh more, negated and reported ones less.
ARCS = {core + n + r + d: (1.5 if d else 1.0) * (0.2 if n else 1.0) * (0.3 if r else 1.0) for core in "ih" for n in ("", "n") for r in ("", "r") for d in ("", "d") if core == "i" or d}
NUMBER = {arc: k for k, arc in enumerate(ARCS)}


class Grammar(dict):
    """Maps tokens to (symbol, weight), remembered for as long as they are few, and scores texts by composed transducers."""

    def __init__(self, insults: dict[bytes, float], without: tuple[str, ...] = ()):
        super().__init__()
        self.insults = insults
        self.names = tuple(n for n in MACHINES if n not in without)
        self.table = composed(self.names)
        self.at = self.names.index("target") if "target" in self.names else None
        enc = lambda words, x: {w.encode(): x for w in words}
        self.symbols = enc(THREATS, THREAT) | enc(TARGETS, TARGET) | enc(NEGATIONS, NEGATION) | enc(REPORTS, REPORT)

    def __missing__(self, token: bytes) -> tuple[str, float]:
        if len(self) > 200_000:
            self.clear()
        x = self[token] = self.read(token)
        return x

    def read(self, token: bytes) -> tuple[str, float]:
        if token[0] in b".!?;:\n":
            return END, 0.0
        if token in self.insults:
            return INSULT, self.insults[token]
        if len(token) > STEMS[0]:
            word = token.decode(errors="replace")
            for n in reversed(STEMS):
                if len(word) > n and (w := self.insults.get(word[:n].encode() + b"*")):
                    return INSULT, w
        x = self.symbols.get(token, OTHER)
        return x, THREAT_WEIGHT if x == THREAT else 0.0

    def clause(self, tokens: list[tuple[str, float]], gathered: np.ndarray) -> None:
        """Adds the best path's sums by composed arc."""
        paths: dict[tuple, tuple[float, tuple]] = {(0,) * len(self.names): (0.0, ())}
        idle = 0
        for x, weight in tokens:
            if x == OTHER:
                idle += 1
                continue
            # Other words move the negation on, and do nothing beyond its reach.
            for y, w in [*[(OTHER, 0.0)] * min(idle, REACH), (x, weight)]:
                new: dict[tuple, tuple[float, tuple]] = {}
                for states, (total, hits) in paths.items():
                    for to, marks in self.table[states, y]:
                        arc = marks if marks in NUMBER else None
                        value = total + (w * ARCS[arc] if arc else 0.0)
                        if to not in new or value > new[to][0]:
                            new[to] = (value, (*hits, (NUMBER[arc], w)) if arc else hits)
                paths = new
            idle = 0
        done = [p for s, p in paths.items() if self.at is None or s[self.at] != OWED]
        for arc, w in max(done, key=lambda p: p[0])[1]:
            gathered[arc] += w

    def sums(self, text: bytes | None) -> np.ndarray:
        """What the clauses' best paths gather on each arc."""
        out = np.zeros(len(ARCS))
        tokens = list(map(self.__getitem__, TOKEN.findall((text or b"").lower())))
        done = -1
        for k, (x, _) in enumerate(tokens):
            if k > done and x in (INSULT, THREAT):
                start = k
                while start and tokens[start - 1][0] != END:
                    start -= 1
                done = k
                while done < len(tokens) and tokens[done][0] != END:
                    done += 1
                self.clause(tokens[start:done], out)
        return out


def features(text: bytes) -> set[bytes]:
    """Whole words, and stems of 5 to 8 characters with a mark behind."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        if w[0] in b".!?;:\n":
            continue
        out.add(w)
        if len(w) > STEMS[0]:
            u = w.decode(errors="replace")
            out.update(u[:n].encode() + b"*" for n in STEMS if len(u) > n)
    return out


def learn_insults(labelled: DataFrame, least_ratio: float = 24.0, least_share: float = 0.01, gain: float = 1.2) -> dict[bytes, float]:
    """The insult words and stems from labelled (text, toxic): features in `least_share` of the toxic rows at least that pass the test.

    What comes to the driver has a bound: a feature that passes is in a hundredth of the toxic rows or more, and at least
    ten times likelier there, so there are at most a hundred times as many as a toxic text has features.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(features(t or b""))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["f", "a", "b"])

    fixed = {w.encode(): 4.0 for w in INSULTS}
    n = {bool(r["toxic"]): r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return fixed
    each = labelled.select("text", "toxic").mapInArrow(count, "f binary, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    each = each.where(F.col("a") >= max(3.0, least_share * n1))
    p = (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))
    term = lambda k, m, q: F.when(k > 0, k * F.log(k / (m * q))).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = 2 * (term(a, F.lit(float(n1)), p) + term(b, F.lit(float(n0)), p) + term(n1 - a, F.lit(float(n1)), 1 - p) + term(n0 - b, F.lit(float(n0)), 1 - p))
    lift = F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))
    kept = each.withColumn("lift", lift).withColumn("ratio", ratio).where((F.col("ratio") >= least_ratio) & (F.col("lift") >= math.log(10.0)) & (F.length("f") >= 4))
    return fixed | telling([(bytes(r["f"]), r["lift"], r["ratio"]) for r in kept.select("f", "lift", "ratio").toLocalIterator()], gain)


def telling(found: list[tuple[bytes, float, float]], gain: float) -> dict[bytes, float]:
    """Words, and the stems whose ratio is `gain` times that of every word and longer stem under them."""
    out: dict[bytes, float] = {}
    best: dict[bytes, float] = {}
    length = lambda f: len(f.rstrip(b"*").decode(errors="replace"))
    for f, lift, ratio in sorted(found, key=lambda x: (x[0].endswith(b"*"), -length(x[0]), x[0])):
        stem = f.endswith(b"*")
        if stem and ratio < gain * best.get(f[:-1], 0.0):
            continue
        out[f] = float(lift)
        word = f.rstrip(b"*").decode(errors="replace")
        for n in range(STEMS[0], len(word) + (not stem)):
            key = word[:n].encode()
            best[key] = max(best.get(key, 0.0), ratio)
    return out


def gathered(docs: DataFrame, insults: dict[bytes, float], text_col: str = "text") -> Column:
    """array<double>: the curve's inputs, logarithms of the arcs' sums and of the length; chance matches grow with a text."""
    model = docs.sparkSession.sparkContext.broadcast(insults)

    @F.arrow_udf("array<double>")
    def inputs(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar = Grammar(model.value)
        for t in texts:
            rows = [np.append(np.log1p(grammar.sums(x)), math.log1p(len(x or b""))) for x in t.cast(pa.binary()).to_pylist()]
            yield pa.array(rows, pa.list_(pa.float64()))

    return inputs(F.col(text_col))


#: What the curve has without labels, and what its ridge draws the arcs' weights to.
FIXED_CURVE = np.array([*(1.5 * w for w in ARCS.values()), 0.0, -3.0])


class ToxicityModel:
    """insults: weights of words and stems; curve: a weight for each composed arc, one for the length, and the offset."""

    def __init__(self, insults: dict[bytes, float], curve: np.ndarray):
        self.insults, self.curve = insults, curve

    def score(self, docs: DataFrame, text_col: str = "text", without: tuple[str, ...] = ()) -> Column:
        """Scores in (0, 1); the machines named in `without` are left out of the composition."""
        model = docs.sparkSession.sparkContext.broadcast((self.insults, self.curve))

        @F.arrow_udf("double")
        def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            insults, curve = model.value
            grammar = Grammar(insults, without)
            for t in texts:
                x = np.array([[*np.log1p(grammar.sums(x)), math.log1p(len(x or b"")), 1.0] for x in t.cast(pa.binary()).to_pylist()]).reshape(-1, len(curve))
                yield pa.array(1 / (1 + np.exp(-np.clip(x @ curve, -40, 40))), pa.float64())

        return scores(F.col(text_col))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """Learns from the labelled rows of docs (doc_id, text) outside the held-out fold, at most about `max_rows` of them.

    The rows of the sample are chosen by a hash of the id; what comes to the driver is a row of 13 numbers for each of them.
    """
    y = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(crc_bucket(F.col("id"), folds) != held_out)
    y = y.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = max_rows / max(1, y.count())
    if share < 1:
        y = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 52)) < int(share * (1 << 52)))
    # The sample's ids are few by its bound, so they go to the texts and not the texts to them.
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(y), "id").select("text", "toxic")
    insults = learn_insults(rows)
    seen = rows.select("toxic", gathered(rows, insults).alias("x")).toArrow()
    label = seen.column("toxic").to_numpy().astype(float)
    if len(np.unique(label)) < 2:
        return ToxicityModel(insults, FIXED_CURVE)
    x = seen.column("x").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    return ToxicityModel(insults, logistic(np.column_stack([x, np.ones(len(x))]), label))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 200) -> np.ndarray:
    """The curve by damped Newton steps, with a ridge towards the fixed weights; the offset is free."""
    beta, keep = FIXED_CURVE.copy(), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - y) + keep @ (beta - FIXED_CURVE))
        beta = beta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta
