"""Every registered query runs on the smallest tables and, where a check exists, gives its rows."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
JOBS, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(JOBS)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, SF, JOBS[name], CHECKS.get(name))
    assert problem is None
