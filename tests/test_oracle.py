"""Every named job against its SQL twin on the smallest supplied tables."""

import pytest
from check_oracle import compare, duck

from ledgerloom.plans import load_queries

FOLDER = "/root/testdata/sf0.001"
JOBS = load_queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in JOBS.items() if q.sql])
def test_same_as_sql(spark, con, name):
    q = JOBS[name]
    got, want = q(spark, FOLDER).toPandas(), con.execute(q.oracle()).df()
    assert compare(got, want) == "ok"


@pytest.mark.parametrize("name", [n for n, q in JOBS.items() if not q.sql])
def test_without_sql_has_rows(spark, name):
    df = JOBS[name](spark, FOLDER)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
