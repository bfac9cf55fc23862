"""Every core query runs over the whole tables; those with SQL give the rows of the SQL."""

import pytest

from sutraloom.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    oracle.check(spark, con, data, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data).cache()
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    df.unpersist()


def test_entry_points(spark, data):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
