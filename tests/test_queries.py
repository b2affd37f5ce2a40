"""Every query against its SQL on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from gridloom.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in registry.oracle_sql():
        assert len(set(df.columns)) == len(df.columns)
        return
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    wanted = rows_of(want.columns, want.fetchall())
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=2e-5)), (a, b)
