"""Every query of the catalogue against its SQL; those without SQL must run and have a stable schema."""

import pytest
from compare import difference, duck

from assayframe.plans import catalogue

ORACLES = catalogue.oracle_sql()
WITHOUT_SQL = sorted(set(catalogue.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert difference(catalogue.queries()[name](spark, small), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    assert df.columns == catalogue.queries()[name](spark, small).columns
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_no_overall_score():
    for name in catalogue.queries():
        assert "overall" not in name
