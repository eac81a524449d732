"""Every registered query with a twin in SQL gives the twin's rows."""

import pytest
from conftest import SMALL

from candlewright import registry


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLES if not n.startswith("stream_")))
def test_query_equals_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLES if n.startswith("stream_")))
def test_stream_equals_batch(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(registry.ORACLES) <= set(__spark_entry__.queries())
