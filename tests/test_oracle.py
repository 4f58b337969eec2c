"""Every registered query with a SQL twin gives exactly the rows of the twin."""

import oracle
import pytest
from bioscore.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    assert not oracle.differences(registry.QUERIES[name](spark, sf_dir), duck,
                                  registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as driver
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 10
