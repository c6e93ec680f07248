"""Every registered core query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from tidewell.queries.registry import all_queries, all_sql
from tidewell.verify import rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    got = df.collect()
    if name in all_sql():
        cur = duck.execute(all_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(got, df.columns) == rows_of(cur.fetchall(), cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["pan", "cal_day"]
    assert set(e.oracle_sql()) <= set(e.queries())
