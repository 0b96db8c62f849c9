"""Runs and interval islands by window functions, and first-row de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_ids(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str = "run") -> DataFrame:
    """``name``: number of the run of equal ``value`` that a row belongs to; nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 0).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def interval_islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str | Column], gap: float, name: str = "island") -> DataFrame:
    """``name``: number of the island of intervals whose start is at most ``gap`` after the largest end so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - reach > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def split_runs(df: DataFrame, keys: list[str], order: list[str | Column], cut: Column, name: str = "part") -> DataFrame:
    """``name``: number of ``cut`` rows so far, a key's first row not counted."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when((F.row_number().over(w) > 1) & cut, 1).otherwise(0)
    return df.withColumn("_new", flag).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_rows(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_rows(df: DataFrame, keys: list[str], order: list[str | Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their place from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)
