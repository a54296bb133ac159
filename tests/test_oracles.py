import pytest
from helpers import assert_same

from terrashift import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert_same(plans.QUERIES[name](spark, data), duck, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
