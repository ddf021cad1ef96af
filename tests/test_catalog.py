"""Every registered query of the vector engine that has SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quiverlake.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows
    if name in catalog.oracle_sql():
        result = duck.sql(catalog.oracle_sql()[name])
        at = [list(result.columns).index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
