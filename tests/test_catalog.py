"""Every query with SQL gives the rows that DuckDB gives for it, value for value."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    return x.date() if isinstance(x, datetime.datetime) else x


def order(row):
    """Floats to six digits only: neighbours in the last digit may not change places."""
    return repr(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in row))


def equal(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=order)
    expected = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=order)
    assert rows and len(rows) == len(expected)
    bad = [(a, b) for a, b in zip(rows, expected) if not all(map(equal, a, b))]
    assert not bad, bad[:3]


def test_liveness_gaps_are_those_over_ten_seconds(spark):
    rows = registry.queries()["w15_liveness_gaps"](spark, SF).collect()
    assert rows and 10_000 < min(r.silent_ms for r in rows) < 3_600_000
