"""The driver contract, and every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from spanward.session import TABLES

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def test_contract(spark, data):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 70
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cur = db.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, cur.fetchall())
