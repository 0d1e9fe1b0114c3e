"""Every core query against its SQL on the smallest tables."""

import pytest

from siftline.plans import registry

from .comparing import connected, rows_of, rows_of_sql

#: Queries that train models: run once elsewhere.
SLOW = {"gbt_rf_score", "partial_dependence", "cross_validation", "patch_diffs", "patch_verification"}


@pytest.fixture(scope="module")
def duck(tiny):
    return connected(tiny)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, tiny, name):
    assert rows_of(registry.queries()[name](spark, tiny)) == rows_of_sql(duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, tiny, name):
    df = registry.queries()[name](spark, tiny)
    assert df.columns and df.count() >= 0 and "void" not in dict(df.dtypes).values()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
