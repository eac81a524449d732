"""Queries of the training-data operators with a twin in SQL give the twin's rows."""

import pytest
from conftest import SMALL

from candlewright.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLES[name]).df())


def test_every_operator_has_its_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(registry.QUERIES) | {"pipeline"} <= names
