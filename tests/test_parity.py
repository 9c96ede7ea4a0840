"""Every query with a SQL statement gives the same columns, kinds and values in Spark and DuckDB."""

from __future__ import annotations

import pytest
from compare import compare

from gravitas.plans import catalog

ORACLES = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    assert compare(QUERIES[name](spark, sf), duck, ORACLES[name]) == ""


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
