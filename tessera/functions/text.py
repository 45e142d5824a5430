"""Scalar text functions as Columns: normal forms, tokens, slugs, redaction, hashes, JSON regions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sliced(f: Callable, rows: int = 64) -> Callable:
    """f of arrays, called for a few rows after the other, so that Python objects are there for no more than those."""

    def whole(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([f(*(c.slice(k, rows) for c in columns)) for k in range(0, max(1, len(columns[0])), rows)])

    return whole


class Places(dict):
    """A word's coordinate below `dim`, doubled, and one more if its sign is negative: by sha256, found once for a word while there are `most` of them or fewer."""

    def __init__(self, dim: int, most: int):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str | bytes) -> int:
        d = hashlib.sha256(word if isinstance(word, bytes) else word.encode()).digest()
        p = int.from_bytes(d[:4]) % self.dim * 2 + d[4] % 2
        if len(self) < self.most:
            self[word] = p
        return p


def hashes(dim: int, most: int = 200_000) -> Callable:
    """The place of a word (text, or its UTF-8), as `Places` has it."""
    return Places(dim, most).__getitem__


def collapsed(x: Column) -> Column:
    """White space runs become one space; ends trimmed; lower case with sharp s written out."""
    return F.replace(F.lower(F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))), F.lit("ß"), F.lit("ss"))


def identifiers(x: Column) -> Column:
    """Identifier-aware tokens: `gte-3000` gives gte3000, gte and 3000; plain words give themselves."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+(?:[-_][a-z0-9]+)*"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike("[-_]"), F.concat(F.array(F.regexp_replace(w, "[-_]", "")), F.split(w, "[-_]"))).otherwise(F.array(w))))


#: Bytes of a token stay, all others become spaces; and what begins with a whole token and goes on behind a hyphen or low line.
TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
COMPOUND = re.compile(rb"(?<![a-z0-9])[a-z0-9]++(?:[-_][a-z0-9]++)+")


def token_list(lower: bytes) -> list[bytes]:
    """The tokens of `identifiers`, in another order, from lower-cased UTF-8."""
    out = lower.translate(TOKEN_BYTES).split()
    if b"-" in lower or b"_" in lower:
        out += [w.replace(b"-", b"").replace(b"_", b"") for w in COMPOUND.findall(lower)]
    return out


def query_terms(x: Column, most: int = 12) -> Column:
    """Distinct lower-cased terms of three ASCII characters or more, the first `most` in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_-]{3,}"), F.lit(0))), 1, most)


def folded(text: Column) -> Column:
    """Lower case with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def share_held(terms: Column, text: Column) -> Column:
    """The share of terms that the text contains as it is; 0 for no terms. The text has to be a plain column: an expression would be evaluated for each term."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)).otherwise(F.lit(0.0))


def coverage(terms: Column, text: Column) -> Column:
    """The share of terms that the text contains, folded once; 0 for no terms."""
    return F.get(F.transform(F.array(folded(text)), lambda f: share_held(terms, f)), F.lit(0))


def slug(x: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def file_name(x: Column, most: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, r'[<>:"/\\|?*\n\r\t]+', "_")), 1, most)


def digit_mask(x: Column) -> Column:
    """Lower case without spaces, digit runs as #: equal for lines that differ in a number only."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), " ", ""), "[0-9]+", "#")


def redacted(x: Column, most: int = 4000) -> Column:
    """Credentials in URLs, headers and assignments replaced, then cut to `most` characters."""
    x = F.regexp_replace(x, r"(https?://)[^/@ ]+@", "$1[redacted]@")
    x = F.regexp_replace(x, r"(Bearer )[A-Za-z0-9._-]+", "$1[redacted]")
    x = F.regexp_replace(x, r"""((?i:token|password|passwd|api[_-]?key|access[_-]?key|secret|authorization)["']? *[=:] *["']?)[A-Za-z0-9_./+-]{8,}""", "$1[redacted]")
    return F.substring(F.regexp_replace(x, r"sk-[A-Za-z0-9_-]{8,}", "[redacted]"), 1, most)


def version_of(*values: Column, digest: Column) -> Column:
    """The first value that isn't blank, else the content's digest, else a fixed mark."""
    given = F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])
    return F.coalesce(given, F.concat(F.lit("content-sha256:"), digest), F.lit("legacy-unknown"))


def stable_id(uri: Column, version: Column) -> Column:
    return F.concat(F.lit("paper:"), F.substring(F.sha2(F.concat(uri, F.lit("\x00"), version), 256), 1, 20))


def hash_share(salt: str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of sha256(salt:key): the same row falls into the same sample anywhere."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def token_estimate(payload: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(payload) + 3) / 4)).cast("long")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Canonical URL: lower-case scheme and host, default port and fragment dropped, query kept; and its host."""
    head = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), "#.*$", "")
    head = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    return F.concat(head, rest), F.regexp_replace(head, "^[a-z0-9+.-]+://", "")


def symbol_share(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[A-Za-z0-9À-ÿ \n]", "")) / F.nullif(F.length(x), F.lit(0))
