import pytest

from epochal.plans import catalogue
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    oracle.check(spark, con, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_repeats(spark, name):
    """Queries that draw at random give the same rows each time."""
    first, second = (catalogue.QUERIES[name](spark, oracle.DATA).collect() for _ in range(2))
    assert first and sorted(map(repr, first)) == sorted(map(repr, second))
