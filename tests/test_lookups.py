"""Two-level look-ups against a plain search, and how they spread a long video."""

from __future__ import annotations

import random

from framewell.operators.joins import as_of, look_up
from pyspark.sql import functions as F

LEFT, RIGHT = "k long, t double, name string", "k long, t double, v long, w string"


def plain(left: list, right: list) -> list[tuple]:
    """For each left row the last ``v``, the first ``v`` and the last ``w`` around its time."""
    out = []
    for k, t, name in left:
        mine = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None]
        back = max(((r[1], r[2]) for r in mine if r[1] <= t and r[2] is not None), default=(None, None))
        on = min(((r[1], r[2]) for r in mine if r[1] >= t and r[2] is not None), default=(None, None))
        word = max(((r[1], -1 if r[2] is None else r[2], r[3]) for r in mine if r[1] <= t and r[3] is not None), default=(None,) * 3)
        out.append((k, t, name, back[1], on[1], word[2]))
    return sorted(out, key=str)


def test_random_cases_with_and_without_buckets(spark) -> None:
    rng = random.Random(2)
    left, right = [], []
    for case in range(300):  # each case is a key of its own
        span = rng.choice([3, 40, 1000])
        time = lambda: rng.choice([None, float(rng.randint(-span, span))] if rng.random() < 0.05 else [float(rng.randint(-span, span)), rng.uniform(-span, span)])  # noqa: B023, E731
        left += [(case if rng.random() > 0.02 else None, time(), f"n{i}") for i in range(rng.randint(0, 12))]
        right += [(case, time(), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for _ in range(rng.randint(0, 9))]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    wanted = {"last_v": ("v", "backward"), "next_v": ("v", "forward"), "last_w": ("w", "backward")}
    for bucket in (None, 10.0, 0.5, 5000.0):
        got = look_up(a, b, ["k"], "t", wanted, bucket=bucket)
        assert got.columns == [*a.columns, *wanted]
        assert sorted(map(tuple, got.collect()), key=str) == plain(left, right), bucket


def test_as_of_agrees_with_its_plain_plan(spark) -> None:
    rng = random.Random(8)
    a = spark.createDataFrame([(i % 5, rng.uniform(0, 100), "x") for i in range(200)], LEFT)
    b = spark.createDataFrame([(i % 5, rng.uniform(0, 100), i, "y") for i in range(80)], RIGHT)
    for direction in ("backward", "forward"):
        one, two = (sorted(map(tuple, as_of(a, b, ["k"], "t", ["v"], direction=direction, bucket=x).collect()), key=str) for x in (None, 7.0))
        assert one == two and len(one) == 200


def test_a_long_video_spreads_over_tasks(spark) -> None:
    """One key with a third of all rows: no sort sees more than its share of them."""
    a = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 1.0).alias("t"), F.lit("n").alias("name"))
    b = spark.range(1, 2).select(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("t"), F.lit(7).cast("long").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = look_up(a, b, ["k"], "t", {"v": ("v", "backward")}, bucket=300.0)
        rows = found.withColumn("task", F.spark_partition_id()).filter("k = 0").groupBy("task").agg(F.count("*").alias("n"), F.count("v").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert sum(r.n for r in rows) == sum(r.v for r in rows) == 10_000, "the one row at the start reaches all later buckets"
    assert len(rows) == 16 and max(r.n for r in rows) < 2_000
