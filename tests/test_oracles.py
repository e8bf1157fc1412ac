import pytest

from foliant.catalogue import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
