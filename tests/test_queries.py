"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from hirelake.plans import oracle_sql, queries
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, db, name):
    got = queries()[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    assert compare(got, db.execute(SQL[name]).df()) is None


def test_entry_runs(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert rows and rows[0]["posted_last_7_days"] >= rows[-1]["posted_last_7_days"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
