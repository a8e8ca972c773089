"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import ORACLES, QUERIES

from .helpers import SF, duck, rows_of


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    ours, sql = QUERIES[name](spark, SF).toPandas(), duck().execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows_of(ours) == rows_of(sql)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
