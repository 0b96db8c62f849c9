"""The stage graph, and that the reframing chain reads each given table at most twice."""

from __future__ import annotations

import os
import re
import time

import pytest
from framewell.operators.store import CLEANUP, StageGraph
from framewell.queries.frames import QUERIES
from pyspark.sql import functions as F

from tests.conftest import DATA


def graph_of(spark, df, settings=None):  # noqa: ANN001, ANN201
    graph = StageGraph(spark, settings).input("rows", df)
    graph.stage("double", lambda r: r.withColumn("x", F.col("x") * 2), "rows")
    graph.stage("plus", lambda d: d.withColumn("x", F.col("x") + 1), "double")
    graph.stage("minus", lambda d: d.withColumn("x", F.col("x") - 1), "double")
    return graph.stage("both", lambda a, b: a.unionByName(b), "plus", "minus")


def test_shared_stages_are_written_once_and_reused(spark, tmp_path) -> None:
    spark.range(5).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    graph = graph_of(spark, read())
    assert sorted(r.x for r in graph.results("both")[0].collect()) == sorted([2 * i + d for i in range(5) for d in (1, -1)])
    assert (graph.written, graph.reused) == (["double"], []), "only what has several users is written"
    again = graph_of(spark, read())
    assert again.results("both", "plus")[0].count() == 10
    assert (again.written, again.reused) == (["plus"], ["double"])
    assert graph_of(spark, read(), "other").fingerprint("both") != graph.fingerprint("both")
    spark.range(7).select(F.col("id").alias("x")).write.mode("overwrite").parquet(str(tmp_path / "t"))
    new = graph_of(spark, read())
    assert new.results("both")[0].count() == 14 and new.written == ["double"], "other files, other results"
    alone = graph_of(spark, read())
    assert alone.results("plus")[0].count() == 7 and alone.written == []


def test_broken_stage_leaves_nothing(spark) -> None:
    fails = F.udf(lambda x: 1 // 0, "int")
    graph = StageGraph(spark).input("rows", spark.range(3), keep=True).stage("bad", lambda r: r.withColumn("y", fails("id")), "rows")
    graph.stage("a", lambda b: b, "bad").stage("b", lambda b: b, "bad")
    with pytest.raises(Exception, match="division"):
        graph.results("a", "b")
    assert graph.written == ["rows"] and graph._stored("bad") is None


def test_a_written_stage_leaves_no_shuffle_files(spark) -> None:
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    graph = StageGraph(spark).input("rows", spark.range(1000).withColumn("x", F.rand(int(time.time()))))
    graph.stage("sums", lambda r: r.groupBy((F.col("id") % 7).alias("k")).agg(F.sum("x").alias("x")).repartition(3, "x"), "rows")
    graph.stage("a", lambda s: s, "sums").stage("b", lambda s: s, "sums")
    a, _ = graph.results("a", "b")
    assert graph.written == ["sums"] and spark.conf.get(CLEANUP, "false") == "false"
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert files() - before == set() and a.count() == 7


def test_a_kept_stage_is_written_for_its_only_user(spark) -> None:
    graph = StageGraph(spark).input("rows", spark.range(int(time.time()) % 1000 + 1)).stage("one", lambda r: r.withColumn("y", F.col("id") + 1), "rows", keep=True)
    graph.stage("two", lambda r: r.filter("y > 1"), "one")
    assert graph.results("one")[0].count() > 0 and graph.written == []
    assert graph.results("two")[0].filter("y < 2").count() == 0 and graph.written == ["one"]


def test_graph_refuses_unknown_and_double_names(spark) -> None:
    graph = StageGraph(spark).input("rows", spark.range(1))
    with pytest.raises(KeyError, match="nothing"):
        graph.stage("x", lambda r: r, "nothing")
    with pytest.raises(ValueError, match="already"):
        graph.input("rows", spark.range(1))


@pytest.mark.parametrize("name", ["reframe_crops", "reframe_metrics", "shot_type", "composition_plan"])
def test_given_tables_are_read_at_most_twice(spark, monkeypatch, name: str) -> None:
    plans = []
    write = StageGraph._write

    def noted(self, stage, df):  # noqa: ANN001, ANN202
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, stage, df)

    monkeypatch.setattr(StageGraph, "_write", noted)
    monkeypatch.setattr(StageGraph, "_stored", lambda self, stage: None)
    plans.append(QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    scans = re.findall(rf"FileScan parquet.*?{DATA}/(\w+)\.parquet", "\n".join(plans))
    assert scans and max(map(scans.count, scans)) <= 2, scans
