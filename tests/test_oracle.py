"""Registered queries against their SQL oracle (DuckDB) on the smallest tables."""
import sys

import duckdb
import pytest

sys.path.insert(0, "scripts")
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ts", "label", "value", "delta"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle_{name} AS {E.oracle_sql()[name]}")  # an oracle must work as a view
    res = con.execute(f"SELECT * FROM oracle_{name}")
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert digest(s_rows, df.columns)[0] == digest(d_rows, d_cols)[0]
