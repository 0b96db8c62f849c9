"""Keyed tables and page indexes."""

from __future__ import annotations

import os
import random

import pytest
from framewell.operators.tables import Conflict, Folder, KeyedTable, PageIndex, latest
from pyspark.sql import functions as F

SCHEMA = "id long, name string, score double"


def rows_of(df) -> dict:  # noqa: ANN001
    return {r.id: (r.name, r.score) for r in df.collect()}


def files(path) -> set:  # noqa: ANN001
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path) -> None:
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 16)
    with pytest.raises(LookupError):
        table.read()
    want = {i: (f"n{i}", float(i)) for i in range(200)} | {None: ("none", 0.0)}
    table.upsert(spark.createDataFrame([(k, *v) for k, v in want.items()], SCHEMA))
    assert rows_of(table.read()) == want
    before, used = files(tmp_path), table.version()["at"]
    new = {7: ("seven", 7.5), 1000: ("more", 1.0), None: ("still none", 2.0)}
    changed = table.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA))["at"]
    assert rows_of(table.read()) == want | new
    moved = {b for b in changed if changed[b] != used.get(b)}
    assert 1 <= len(moved) <= 3 and len(files(tmp_path) - before) == len(moved), "a file for each touched bucket"
    assert rows_of(table.read(1)) == want, "readers of the old version see the old rows"
    table.delete(spark.createDataFrame([(7,), (5000,)], "id long"))
    assert rows_of(table.read()) == {k: v for k, v in (want | new).items() if k != 7}
    assert rows_of(KeyedTable(spark, str(tmp_path / "t"), ["id"]).read()) == rows_of(table.read()) and KeyedTable(spark, str(tmp_path / "t"), ["id"]).buckets == 16


def test_random_changes(spark, tmp_path) -> None:
    rng, want = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    for step in range(6):
        new = {rng.randrange(30): (f"s{step}", rng.random()) for _ in range(8)}
        want |= new
        table.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA))
    assert rows_of(table.read()) == want
    table.vacuum(1)
    assert rows_of(table.read()) == want and len(table.versions.names()) <= 2


def test_a_change_broken_off_has_no_effect(spark, tmp_path, monkeypatch) -> None:
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    table.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    new = spark.createDataFrame([(1, "b", 2.0), (2, "c", 3.0)], SCHEMA)
    fails = new.withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(fails, [F.col("score")])
    monkeypatch.setattr(Folder, "create", lambda self, name, text: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        table.upsert(new)  # its files are written, its version isn't
    monkeypatch.undo()
    assert rows_of(table.read()) == {1: ("a", 1.0)} and table.version()["number"] == 1
    table.upsert(new)
    assert rows_of(table.read()) == {1: ("b", 2.0), 2: ("c", 3.0)}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch) -> None:
    path = str(tmp_path / "t")
    one, two = (KeyedTable(spark, path, ["id"], 4) for _ in range(2))
    one.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    seen = one.version()
    two.upsert(spark.createDataFrame([(1, "two", 2.0)], SCHEMA))
    monkeypatch.setattr(one, "version", lambda: seen)
    with pytest.raises(Conflict):
        one.upsert(spark.createDataFrame([(1, "one", 3.0)], SCHEMA))
    assert rows_of(two.read()) == {1: ("two", 2.0)}


def test_rows_of_one_key(spark, tmp_path) -> None:
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    twice = spark.createDataFrame([(1, "old", 1.0), (1, "new", 2.0)], SCHEMA)
    with pytest.raises(ValueError, match="twice"):
        table.upsert(twice)
    table.upsert(twice, [F.desc("score")])
    assert rows_of(table.read()) == {1: ("new", 2.0)}
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert rows_of(table.read()) == {1: ("new", 2.0)}
    with pytest.raises(ValueError, match="key"):
        KeyedTable(spark, str(tmp_path / "t"), ["name"])


def test_state_of_a_log(spark) -> None:
    log = spark.createDataFrame([(1, 1, "queued", None), (1, 2, "running", 0.1), (1, 4, None, 0.9), (1, 3, "failed", None), (2, 1, None, None)], "job long, at long, status string, progress double")
    assert sorted(map(tuple, latest(log, ["job"], ["at"]).collect())) == [(1, 4, "failed", 0.9), (2, 1, None, None)]


def test_deep_pages_read_their_partitions(spark, tmp_path) -> None:
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, rng.choice("abc"), float(rng.randint(0, 50))) for i in range(2000)], SCHEMA)
    order = [F.desc("score"), F.col("id")]
    index = PageIndex.build(rows, order, str(tmp_path / "p"), 20)
    every = [tuple(r) for r in rows.orderBy(*order).collect()]
    assert index.total() == 2000
    for offset, limit in ((0, 10), (995, 10), (1990, 50), (2000, 5), (150, 400), (0, 0)):
        assert [tuple(r) for r in index.page(order, limit, offset).collect()] == every[offset : offset + limit], (offset, limit)
    deep = index.page(order, 10, 1500)
    assert len(deep.inputFiles()) <= 2 and spark.read.parquet(*deep.inputFiles()).count() < 400, "not the 1500 rows before"
    empty = PageIndex.build(rows.limit(0), order, str(tmp_path / "e"), 4)
    assert empty.total() == 0 and empty.page(order, 5).collect() == []
