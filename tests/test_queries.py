"""Every query of the engine on small tables, against its SQL in DuckDB where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from siftwork.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(int(v)) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(zip(*[df[c].map(plain) for c in sorted(df.columns)], strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
