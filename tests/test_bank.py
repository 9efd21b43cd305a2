"""Every query of the bank against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from metrigraph.plans import bank, estate_bank

QUERIES, ORACLES = bank.queries() | estate_bank.queries(), bank.oracle_sql() | estate_bank.oracle_sql()
#: Queries whose rows need more tables than the smallest scale has.
MAY_BE_EMPTY = {"metric_conflicts", "missing_evidence", "nq_conflicts_by_label"}

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = [tuple(map(canon, r)) for r in df.collect()]
    if name not in ORACLES:
        assert got or name in MAY_BE_EMPTY
        return
    cur = duck.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted(got) == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
