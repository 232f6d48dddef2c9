"""Corpus queries against their SQL on small tables, whole."""

import pytest
from conftest import DATA, same_form

from vecspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, oracle, name, sf):
    got = same_form(registry.QUERIES[name](spark, f"{DATA}/{sf}").toPandas())
    assert got[1]
    assert got == oracle(sf, registry.SQL[name])
