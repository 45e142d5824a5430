"""Arithmetic formulas as Columns: a tokeniser and two stacks, no eval.

A formula has decimal numbers, declared names, + - * / with their usual precedence, signs and parentheses. It is refused, with a reason, if it holds
anything else or isn't well formed (unsupported), uses an undeclared name (undeclared), doesn't use a declared one (unused), divides by zero (zero), or has a part that isn't
finite or passes `most` (range). What is not well formed comes first; else the first reason met from left to right.

A task reads each different formula of a batch once, and computes it for all rows of the batch that have it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NAME = "[A-Za-z_][A-Za-z0-9_]*"
MOST = 1e12  # fixed value: the safe range
RANK = {"u+": 3, "u-": 3, "*": 2, "/": 2, "+": 1, "-": 1, "(": 0}
WHY = (None, "unsupported", "undeclared", "zero", "range", "unused")
RESULT = StructType([StructField("value", DoubleType()), StructField("why", StringType())])


def tokens(formula: str) -> list[str] | None:
    """The formula's tokens, or null if it has characters that belong to none."""
    found = re.findall(rf"{NUMBER}|{NAME}|[-+*/()]", formula)
    return found if "".join(found) == re.sub(r"[ \t]+", "", formula) else None


def steps(found: list[str]) -> list[str] | None:
    """Operands and operators in the order in which they are met and applied; null if the formula isn't well formed."""
    out, ops, operand = [], [], True

    def reduce(least: int) -> None:
        while ops and RANK[ops[-1]] >= least:
            out.append(ops.pop())

    for t in found:
        if operand:
            if t in "+-":
                ops.append("u" + t)
            elif t == "(":
                ops.append(t)
            elif t in "*/)":
                return None
            else:
                out.append(t)
                operand = False
        elif t in "+-*/":
            reduce(RANK[t])
            ops.append(t)
            operand = True
        elif t == ")":
            reduce(1)
            if not ops:
                return None
            ops.pop()
        else:
            return None
    reduce(1)
    return None if operand or ops else out


class Parameters:
    """Maps of names to numbers, one for each row of a batch. A null map declares any name, as null; nulls count as 0."""

    def __init__(self, maps: pa.MapArray):
        at = maps.offsets.to_numpy()
        self.free = maps.is_null().to_numpy(zero_copy_only=False)
        self.at, self.size = at[:-1].astype(np.int64), np.where(self.free, 0, np.diff(at)).astype(np.int64)
        names = maps.keys.dictionary_encode()
        self.code = {n: k for k, n in enumerate(names.dictionary.to_pylist())}
        self.names, self.values = names.indices.to_numpy(), maps.items.fill_null(0.0).to_numpy()

    def of(self, rows: np.ndarray, used: set[str]) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each used name its values and where it is declared, and which rows declare others."""
        size = self.size[rows]
        mine = np.repeat(self.at[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, name = np.repeat(np.arange(len(rows)), size), self.names[mine]
        found = {}
        for u in used:
            value, known, here = np.zeros(len(rows)), self.free[rows].copy(), name == self.code.get(u, -1)
            value[row[here]], known[row[here]] = self.values[mine[here]], True
            found[u] = value, known
        others = np.zeros(len(rows), dtype=bool)
        others[row[~np.isin(name, [self.code[u] for u in used if u in self.code])]] = True
        return found, others


def computed(formula: str, parameters: Parameters, rows: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of the formula for the rows, and the places in WHY of the reasons against them."""
    found = tokens(formula)
    order = None if found is None else steps(found)
    if order is None:
        return np.zeros(len(rows)), np.ones(len(rows), dtype=np.int8)
    known, others = parameters.of(rows, set(found))
    why, stack = np.zeros(len(rows), dtype=np.int8), []

    def push(v: np.ndarray, refused: np.ndarray, reason: str) -> None:
        for bad, r in ((refused, reason), (np.isnan(v) | (np.abs(v) > most), "range")):
            why[bad & (why == 0)] = WHY.index(r)
        stack.append(v)

    none = np.zeros(len(rows), dtype=bool)
    with np.errstate(all="ignore"):
        for t in order:
            if t in RANK:
                one = stack.pop()
                if t in ("u+", "u-"):
                    push(-one if t == "u-" else one, none, "range")
                    continue
                two = stack.pop()
                zero = (one == 0) if t == "/" else none
                push(two + one if t == "+" else two - one if t == "-" else two * one if t == "*" else np.where(zero, 0.0, two / one), zero, "zero")
            elif re.fullmatch(NAME, t):
                push(known[t][0], ~known[t][1], "undeclared")
            else:
                push(np.full(len(rows), float(t)), none, "range")
    why[others & (why == 0)] = WHY.index("unused")
    return stack[0], why


def each(formulas: pa.Array, maps: pa.MapArray, most: float) -> pa.Array:
    coded, parameters = formulas.dictionary_encode(), Parameters(maps)
    code = coded.indices.fill_null(-1).to_numpy()
    value, why = np.zeros(len(code)), np.ones(len(code), dtype=np.int8)
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    for k, formula in enumerate(coded.dictionary.to_pylist()):
        rows = order[ends[k] : ends[k + 1]]
        value[rows], why[rows] = computed(formula, parameters, rows, most)
    reasons = pa.DictionaryArray.from_arrays(pa.array(why - 1, mask=why == 0), pa.array(WHY[1:])).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(value, mask=why != 0), reasons], ["value", "why"])


def evaluated(formula: Column, parameters: Column, most: float = MOST) -> Column:
    """struct<value double, why string>: the formula's value under parameters (a map of names to doubles), or the reason that it has none."""
    return F.arrow_udf(lambda f, p: each(f, p, most), RESULT)(formula, parameters.cast("map<string,double>"))
