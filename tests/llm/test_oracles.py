import pytest

from foliant.llm.queries import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) is None
