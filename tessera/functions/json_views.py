"""Views of arbitrary JSON: fields stripped at any depth, content flattened to text, overrides merged, long strings interned and put back.

Null or malformed JSON gives null. Keys keep their order; what comes out is compact JSON with text as it is, numbers as Python reads them. Equal keys of an
object: the last one counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions.text import sliced

MARK = "$text"
COMPACT = StructType([StructField("view", StringType()), StructField("conflict", StringType())])
INTERNED = StructType([StructField("view", StringType()), StructField("strings", ArrayType(StringType()))])


#: Made once; `json.dumps` would make an encoder for each call.
dumps = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def each(f: Callable, *columns: pa.Array) -> list:
    """f of the parsed values of each row; null where one of them is null or isn't JSON."""
    out = []
    for texts in zip(*(c.to_pylist() for c in columns), strict=True):
        try:
            out.append(None if None in texts else f(*map(json.loads, texts)))
        except ValueError:
            out.append(None)
    return out


def stripped(x: Column, drop: list[str], keep: list[str] | None = None) -> Column:
    """Without the fields of the names in `drop`, at any depth; what is below a field of `keep` stays whole."""
    gone, whole = set(drop), set(keep or [])

    def strip(v):
        if isinstance(v, dict):
            return {k: e if k in whole else strip(e) for k, e in v.items() if k not in gone}
        return [strip(e) for e in v] if isinstance(v, list) else v

    return F.arrow_udf(sliced(lambda c: pa.array(each(lambda v: dumps(strip(v)), c), pa.string())), StringType())(x)


def flattened(x: Column, fields: list[str], between: str = " ") -> Column:
    """The text of content that is a string, a number, a list of contents, or an object with its content in the first of `fields` that it has."""

    def texts(v):
        if isinstance(v, dict):
            return next((texts(v[f]) for f in fields if f in v), [])
        if isinstance(v, list):
            return [t for e in v for t in texts(e)]
        return [] if v is None or isinstance(v, bool) else [v if isinstance(v, str) else dumps(v)]

    return F.arrow_udf(sliced(lambda c: pa.array(each(lambda v: between.join(t for t in texts(v) if t), c), pa.string())), StringType())(x)


def merged(base: Column, override: Column) -> Column:
    """base with the fields of override, objects field by field at any depth; lists and all other values are replaced."""

    def merge(b, o):
        if not (isinstance(b, dict) and isinstance(o, dict)):
            return o
        return {**b, **{k: merge(b[k], v) if k in b else v for k, v in o.items()}}

    return F.arrow_udf(sliced(lambda b, o: pa.array(each(lambda x, y: dumps(merge(x, y)), b, o), pa.string())), StringType())(base, override)


def interned(x: Column, least: int = 80) -> Column:
    """struct<view, strings>: strings of `least` characters or more, each once in strings, stand as {"$text": place} in the view.

    An object of the input that has that field alone is written with a list around its value, so that nothing is taken for a place that isn't one.
    """

    def cut(v, table: dict):
        if isinstance(v, str) and len(v) >= least:
            return {MARK: table.setdefault(v, len(table))}
        if isinstance(v, dict):
            own = {k: cut(e, table) for k, e in v.items()}
            return {MARK: [own[MARK]]} if list(v) == [MARK] else own
        return [cut(e, table) for e in v] if isinstance(v, list) else v

    def one(v):
        table: dict[str, int] = {}
        return {"view": dumps(cut(v, table)), "strings": list(table)}

    kind = pa.struct([("view", pa.string()), ("strings", pa.list_(pa.string()))])
    return F.arrow_udf(sliced(lambda c: pa.array(each(one, c), kind)), INTERNED)(x)


def restored(view: Column, strings: Column) -> Column:
    """What was interned."""

    def put(v, table: list):
        if isinstance(v, dict):
            if list(v) == [MARK]:
                return {MARK: put(v[MARK][0], table)} if isinstance(v[MARK], list) else table[v[MARK]]
            return {k: put(e, table) for k, e in v.items()}
        return [put(e, table) for e in v] if isinstance(v, list) else v

    def back(views: pa.Array, tables: pa.Array) -> pa.Array:
        rows = zip(views.to_pylist(), tables.to_pylist(), strict=True)
        return pa.array([None if v is None or t is None else dumps(put(json.loads(v), t)) for v, t in rows], pa.string())

    return F.arrow_udf(sliced(back), StringType())(view, strings)


def compacted(x: Column, bundles: str, tables: list[str], ident: str = "id") -> Column:
    """struct<view, conflict>: the lists `tables` of each of the package's `bundles` become lists of ids, and their entries stand once in tables of the package.

    One id with two different entries makes the view null and is named as the conflict, the first one met: which entry a bundle meant would be lost.
    Entries without an id, and bundles without a table, are left as they are.
    """

    def view(package):
        found: dict[str, dict] = {t: {} for t in tables}
        out = []
        for bundle in package.get(bundles) or []:
            new = dict(bundle)
            for t in tables:
                if isinstance(bundle.get(t), list) and all(isinstance(e, dict) and isinstance(e.get(ident), str) for e in bundle[t]):
                    for e in bundle[t]:
                        # An entry met for the first time is its own.
                        kept = found[t].setdefault(e[ident], e)
                        if kept is not e and dumps(kept) != dumps(e):
                            return {"view": None, "conflict": f"{t} {e[ident]}"}
                    new[t] = {"ids": [e[ident] for e in bundle[t]]}
            out.append(new)
        return {"view": dumps({**package, bundles: out, "tables": found}), "conflict": None}

    kind = pa.struct([("view", pa.string()), ("conflict", pa.string())])
    return F.arrow_udf(sliced(lambda c: pa.array(each(view, c), kind)), COMPACT)(x)


def expanded(view: Column, bundles: str) -> Column:
    """The package that was compacted."""

    def back(package):
        found = package.pop("tables")
        whole = lambda t, v: [found[t][i] for i in v["ids"]] if t in found and isinstance(v, dict) and list(v) == ["ids"] else v
        if bundles in package:
            package[bundles] = [{t: whole(t, v) for t, v in b.items()} for b in package[bundles]]
        return dumps(package)

    return F.arrow_udf(sliced(lambda c: pa.array(each(back, c), pa.string())), StringType())(view)


def canonical(x: Column) -> Column:
    """The JSON as these functions write it."""
    return F.arrow_udf(sliced(lambda c: pa.array(each(dumps, c), pa.string())), StringType())(x)
