"""Every registered query of the engine's own operators against its SQL, on tables large enough for halves, ties and long texts."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    cell = lambda x: "~" if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = plain([tuple(r[i] for i in at) for r in cur.fetchall()])
    assert want and plain(map(tuple, df.select(*cols).collect())) == want


def test_fusion_asks_every_question(spark, duck):
    got = {r["query_id"] for r in registry.queries()["r2_reciprocal_rank_fusion"](spark, DATA).select("query_id").distinct().collect()}
    assert got == {r[0] for r in duck.execute("SELECT item_id FROM benchmark").fetchall()}
