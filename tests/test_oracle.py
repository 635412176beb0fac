"""Every registered query against its SQL oracle, all values, on the smallest tables."""

import re

import pytest
from comparing import connect, oracle_rows, spark_rows

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


# Queries on training data have tests of their own.
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan
    columns, rows = spark_rows(df)
    oracle_columns, expected = oracle_rows(con, entry.oracle_sql()[name])
    assert columns == oracle_columns
    assert sum(rows.values()) == sum(expected.values())
    assert rows == expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
