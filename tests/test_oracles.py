"""Every third query with an oracle at the smallest scale; check_oracles.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SLOW = ("K1_", "K10_", "I5_", "B5_")
NAMES = [n for n in sorted(entry.oracle_sql()) if not n.startswith(SLOW)][::3]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
