"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from loomtype.plans.queries import oracle_sql, queries  # noqa: E402
from loomtype.plans.registry import TABLES  # noqa: E402


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = queries()[name](spark, SF)
    got = duck.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(frame.columns)
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in frame.columns) for r in got.fetchall()), key=key)
    rows = sorted((tuple(plain(x) for x in r) for r in frame.collect()), key=key)
    assert rows and rows == expected
