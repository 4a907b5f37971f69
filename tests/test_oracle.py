import pytest
from oracle import agree

from siftframe.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
