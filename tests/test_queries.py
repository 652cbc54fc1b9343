"""Every registered library query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import checks, checks_oracle, oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | checks.QUERIES, oracle.SQL | checks_oracle.SQL
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def told(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(told(v) for v in row) for row in cur.fetchall())
    assert sorted(tuple(told(r[n]) for n in names) for r in got.collect()) == want
