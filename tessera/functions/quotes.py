"""Quotes found again in extracted text, and the numbers of a statement checked against its quotes, as Columns.

A quote isn't searched in a folded copy of the text: it becomes a regular expression that lets pass what layout may have
done between its characters, so the match's place in the text is the place itself. Numbers are what a tokeniser of one pattern
leaves when names, citations and references have been read as tokens of their own.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import sliced

# Characters that layout adds; the forms of quotes, dashes, ligatures and half-width marks; plain full-width forms are a rule.
INVISIBLE = "­​‌‍﻿"
INVISIBLE_STRICT = "­​﻿"
APOSTROPHES, QUOTES, DASHES = "‘’‚", "“”„", "‐‑‒–—―"
SCIENTIFIC = {"'": "′", '"': "″", "-": "−"}
LIGATURES = {"ffi": "ﬃ", "ffl": "ﬄ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "st": "ﬆﬅ"}
HALF_WIDTH, FULL_MARKS = "｡｢｣､･", "。「」、・"
PLAIN = "".join(map(chr, range(0x21, 0x7F)))
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)
FORMS = dict(zip(PLAIN + FULL_MARKS, WIDE + HALF_WIDTH, strict=True))


def variants(strict: bool) -> dict[str, str]:
    """The plain character and its other forms, for those that have any."""
    out = {"'": APOSTROPHES, '"': QUOTES, "-": DASHES}
    return out if strict else {k: v + SCIENTIFIC[k] for k, v in out.items()}


def ligatures(strict: bool) -> dict[str, str]:
    """Letters written together; without case, sharp s is the first of them, as it is far more frequent than a ligature behind an s."""
    return LIGATURES if strict else {"ss": "ßẞ"} | LIGATURES


def folded(x: Column, strict: bool = False) -> Column:
    """The text with one form for each character, without white space and what layout adds."""
    own = variants(strict)
    source = "".join(own.values()) + WIDE + HALF_WIDTH
    target = "".join(k * len(v) for k, v in own.items()) + PLAIN + FULL_MARKS
    for plain, forms in ligatures(strict).items():
        for form in forms:
            x = F.replace(x, F.lit(form), F.lit(plain))
    x = F.regexp_replace(F.translate(x, source, target), rf"[\s\p{{Z}}{INVISIBLE_STRICT if strict else INVISIBLE}]+", "")
    return x if strict else F.lower(x)


def spelt_out(folded_quote: str, strict: bool) -> str:
    """The expression for a folded quote. Letters in a row may be written together in several ways (s and sharp s, or sharp s and s); all are let pass."""
    noise = rf"[\s\p{{Z}}{INVISIBLE_STRICT if strict else INVISIBLE}]"
    broken = rf"(?:{noise}|(?<=\p{{L}})-(?=\s{noise}*+\p{{Ll}}))*+"
    own, together = variants(strict), ligatures(strict)

    def one(k: int, forms: str = "") -> str:
        c = folded_quote[k]
        if not forms:
            forms = c + FORMS.get(c, "") + own.get(c, "")
        # A hyphen of the quote itself may not be taken for one of the text's line breaks.
        gap = "" if k == 0 else f"{noise}*+" if c == "-" else broken
        return gap + "[" + re.sub(r"([\[\]\\^&-])", r"\\\1", forms) + "]"

    def across(k: int, i: int, j: int) -> list[tuple[int, int, str]]:
        """What may be written together between i and j with letters on both sides of k."""
        at = [(m, w) for w in together for m in range(max(i, k - len(w) + 1), k)]
        return [(m, m + len(w), together[w]) for m, w in at if m + len(w) <= j and folded_quote.startswith(w, m)]

    def ways(i: int, j: int) -> str:
        if j - i < 2:
            return one(i) if j > i else ""
        k = (i + j) // 2
        out = [ways(i, k) + ways(k, j), *(ways(i, m) + one(m, forms) + ways(n, j) for m, n, forms in across(k, i, j))]
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    size = len(folded_quote)
    cuts = [0, *(k for k in range(1, size) if not across(k, 0, size)), size]
    return "".join(ways(i, j) for i, j in zip(cuts, cuts[1:], strict=False))


def quote_pattern(quote: Column, strict: bool = False) -> Column:
    """A regular expression for the quote: every form of its characters, and between them white space and hyphens at line breaks."""

    @F.arrow_udf(T.StringType())
    def pattern(quotes: pa.Array) -> pa.Array:
        head = "" if strict else "(?iu)"
        return pa.array([head + spelt_out(q, strict) if q else None for q in quotes.to_pylist()], pa.string())

    return pattern(folded(quote, strict))


def quote_span(quote: Column, text: Column, strict: bool = False) -> Column:
    """struct<start, end> of the first place of the quote but for layout; null where there is none. `strict` keeps case and scientific marks."""
    pattern = quote_pattern(quote, strict)
    match = F.regexp_substr(text, pattern)
    start = F.length(F.split(text, pattern, 2)[0])
    return F.when(match.isNotNull(), F.struct(start.alias("start"), (start + F.length(match)).alias("end")))


@F.arrow_udf(T.StringType())
@sliced
def normal_form(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(x: Column) -> Column:
    """The one normal form that Spark has no function for."""
    return normal_form(x)


# Words that make a number a reference, those that may end in a full stop, spelt numbers from 0 on, units, and citations.
CJK_REFERENCES = "表 图 第 公式 式 章 节 页 附录 算法".split()
REFERENCES = "table tables section sections appendix algorithm".split()
STOPPED_REFERENCES = "fig figs figure figures eq eqs equation equations".split()
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
UNITS = {"percent": "%", "points": r"(?:个\s*)?百分点"}
CITED = r"\[\s*[0-9]+(?:\s*[,;-]\s*[0-9]+)*\s*\]"
YEAR = r"(?:19|20)[0-9]{2}[a-z]?"

# A number: digits, alone or in groups of three, with or without a fraction, or a fraction alone; a sign, unless it stands behind a digit or a percent.
GROUPS, DIGITS, FRACTION, SIGN = "[0-9]{1,3}(?:,[0-9]{3})+", "[0-9]+", r"\.[0-9]+", "(?:(?<![0-9%])[+-])?"
NUMBER = f"{SIGN}(?:(?:{GROUPS}|{DIGITS})(?:{FRACTION})?|{FRACTION})"
LABEL = rf"(?:{'|'.join(CJK_REFERENCES)}|\b(?:{'|'.join(REFERENCES)})|\b(?:{'|'.join(STOPPED_REFERENCES)})\.?)"
SPELT = rf"(?=[zotfsen])(?<![\w@-])(?:{'|'.join(SMALL)})(?![\w@-])"
#: The first characters of labels, seen before their list is tried.
LABELLED = r"(?=[aefst\x{4E00}-\x{9FFF}])"
#: A word of letters alone, in which nothing else can begin: read as one token, so that its places aren't tried one after the other.
WORD = r"[a-z]++(?![\w@./-])"
#: What is read as one token, so that no number is found in it: labels with their number, citations, years of citations, and names with digits or marks.
SKIPPED = (
    rf"{LABELLED}{LABEL}\s*\(?[a-z]?{DIGITS}(?:{FRACTION})*[a-z]?\)?",
    rf"{LABELLED}{LABEL}\s+(?:{'|'.join(SMALL)})\b",
    CITED,
    rf"\(\s*{YEAR}\s*\)",
    rf"(?=e)\bet\s+al\.,?\s*\(?\s*{YEAR}",
    rf"(?=[\w@])(?!{WORD})(?=[\w@./-]*[a-z@])[\w@]+(?:[./-][\w@]+)*",
)
QUANTITY = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "value", "unit")]))


def quantities(x: Column, spelt: bool = False) -> Column:
    """array<struct<text, value, unit>>: each number that isn't part of a name, citation, year or reference; words too if `spelt`. Values are decimal texts of any length."""
    wide = rf"[\x{{{ord(WIDE[0]):X}}}-\x{{{ord(WIDE[-1]):X}}}−–]"
    plain = F.when(x.rlike(wide), F.translate(x, WIDE + "−–", PLAIN + "--")).otherwise(x)
    units = rf"(?:\s*(?:{'|'.join(UNITS.values())}))?"
    counted = f"{SPELT}|(?:{NUMBER}){units}" if spelt else f"(?:{NUMBER}){units}"
    # A spelt number that what is before it forbids isn't read as a word: alone, it would look like a number.
    word = f"(?!(?:{'|'.join(SMALL)})(?![a-z])){WORD}" if spelt else WORD
    # A skipped token of words alone would hide a spelt number; the last of the patterns only takes words with digits or marks.
    tokens = F.regexp_extract_all(plain, F.lit(f"(?i)(?:{'|'.join(SKIPPED)})|{counted}|{word}"), F.lit(0))
    begins = "(?i)^[0-9.+zotfsen-]" if spelt else "^[0-9.+-]"
    tokens = F.filter(tokens, lambda t: t.rlike(begins) & t.rlike(f"(?i)^(?:{counted})$") & ~t.rlike(f"(?i)^(?:{'|'.join(SKIPPED)})$"))

    def read(t: Column) -> Column:
        text = F.regexp_extract(t, f"^(?:{NUMBER})", 0)
        word = F.array_position(F.array(*map(F.lit, SMALL)), F.lower(t)) - 1
        unit = F.when(t.endswith("%"), "percent").when(t.endswith("百分点"), "points").otherwise("")
        value = F.when(text != "", F.replace(text, F.lit(","), F.lit(""))).when(word >= 0, word.cast("string"))
        return F.struct(F.when(text == "", t).otherwise(text).alias("text"), value.alias("value"), unit.alias("unit"))

    return F.transform(tokens, read)


class Operands:
    """Supported numbers of a statement, in order, and whether two of them lead to another one; all exact."""

    def __init__(self, values: list[Fraction]):
        self.values = sorted(values)

    def within(self, low: Fraction, high: Fraction, ends: tuple[bool, bool], but: Fraction) -> bool:
        """Whether one lies between low and high, ends belonging to it or not, besides one occurrence of `but`."""
        if low > high:
            low, high, ends = high, low, ends[::-1]
        i = bisect_left(self.values, low) if ends[0] else bisect_right(self.values, low)
        j = bisect_right(self.values, high) if ends[1] else bisect_left(self.values, high)
        own = low < but < high or (but == low and ends[0]) or (but == high and ends[1])
        return j - i > own

    def lead_to(self, text: str, value: Fraction, unit: str) -> bool:
        """Whether a - b, a + b, a / b, the change from b to a in percent, or the points between two shares, rounded half away from zero to the places shown, is the number."""
        half = Fraction(1, 2 * 10 ** len(text.partition(".")[2]))
        low, high, ends = value - half, value + half, (value > 0, value < 0)
        for b in dict.fromkeys(self.values):
            spans = [(low + b, high + b, ends), (low - b, high - b, ends)]
            if b:
                flip = ends if b > 0 else ends[::-1]
                spans.append((min(low * b, high * b), max(low * b, high * b), flip))
                if unit == "percent":
                    at = sorted((b + low * b / 100, b + high * b / 100))
                    spans.append((*at, flip))
            if any(self.within(*s, b) for s in spans):
                return True
            if unit == "points" and 0 <= b <= 1:
                lo, hi = b + low / 100, b + high / 100
                inside = Operands([v for v in self.values if 0 <= v <= 1])
                if inside.within(lo, hi, ends, b):
                    return True
        return False


@F.arrow_udf(QUANTITY)
def left_over(stated: pa.Array, known: pa.Array) -> pa.Array:
    """The stated numbers that neither are known nor follow from two that are."""
    out = []
    for numbers, texts in zip(stated.to_pylist(), known.to_pylist(), strict=True):
        have = {Fraction(t) for t in texts or () if t is not None}
        read = [(n, Fraction(n["value"])) for n in numbers or ()]
        stands = [v in have or (n["unit"] != "" and v / 100 in have) for n, v in read]
        held = Operands([v for (_, v), ok in zip(read, stands, strict=True) if ok])
        out.append(None if numbers is None else [n for (n, v), ok in zip(read, stands, strict=True) if not ok and not held.lead_to(n["text"], v, n["unit"])])
    return pa.array(out, pa.list_(pa.struct([(c, pa.string()) for c in ("text", "value", "unit")])))


def unsupported(statement: Column, quotes: Column) -> Column:
    """array<struct<text, value, unit>>: the statement's numbers that neither stand in the quotes nor follow from two that do. Exact for numbers of any length."""
    known = F.transform(F.flatten(F.transform(quotes, lambda q: quantities(q, spelt=True))), lambda n: n["value"])
    return left_over(quantities(statement), known)
