"""Every registered query of the library against its SQL."""

import pytest

import __spark_entry__ as entry
from tabpact.plans.queries import oracle_sql, queries
from tests.compare import difference, oracle


@pytest.fixture(scope="module")
def duck(sf):
    return oracle(sf)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, duck, name):
    assert difference(queries()[name](spark, sf), duck, oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 15 and df.columns[0] == "#"
