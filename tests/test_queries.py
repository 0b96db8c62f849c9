"""Every query with SQL gives the same rows on Spark and on DuckDB; the others run and are compared elsewhere."""

from __future__ import annotations

import pytest
from framewell.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
