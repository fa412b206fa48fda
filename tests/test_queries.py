"""Every registered query beside its reference SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from threadlake.plans.bindings import TABLES
from tools.check_queries import rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry(spark).columns == ["name", "is_dm", "ai_enabled", "messages", "ai_answers",
                                    "peak_daily_speakers"]


@pytest.mark.parametrize("key", sorted(queries()))
def test_query(spark, duck, key):
    df = queries()[key](spark, SF)
    got = rows_of(df.collect(), df.columns)
    if key not in oracle_sql():
        assert got
        return
    cur = duck.execute(oracle_sql()[key])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(cur.fetchall(), columns)
