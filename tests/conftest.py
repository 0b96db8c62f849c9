from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", sys.path[0])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data) -> list[str]:
    """Rows as comparable text, columns by name; whole floats and integers are told apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted("\t".join(show(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def agree(spark, oracle):
    """Run a query on Spark and its SQL on DuckDB and compare columns and values."""

    def check(query, sql):
        mine, theirs = query(spark, DATA), oracle.sql(sql)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())

    return check
