"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from linesmith import registry

from .conftest import SF, table_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, spark, duck):
    got = table_of(registry.QUERIES[name](spark, SF).toPandas())
    assert got == table_of(duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_has_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0
