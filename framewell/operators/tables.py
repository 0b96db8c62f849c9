"""Tables on shared storage that are changed by key and read by page.

:class:`KeyedTable` deals its rows into buckets by a hash of the key. A change rewrites the buckets that it touches to new files
and then adds a version file, which says where each bucket is; readers take the last version, so they see the table before or
after a change and never between. :class:`PageIndex` keeps a total order in range partitions with their row counts, so a page
reads the partitions that it lies in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has changed the table in the meantime."""


class Folder:
    """Small text files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.path)
        return sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if it was there. It appears whole: it is written beside its place and then renamed."""
        draft, target = self._path(f"{self.path}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self.system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        made = not self.system.exists(target) and self.system.rename(draft, target)
        if not made:
            self.system.delete(draft, False)
        return made

    def delete(self, name: str) -> None:
        self.system.delete(self._path(f"{self.path}/{name}"), True)


class KeyedTable:
    """A table at ``path`` with one row for each ``key``. ``buckets`` counts when the table is made; later its own number holds."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key = spark, path, key
        self.versions = Folder(spark, f"{path}/versions")
        names = [n for n in self.versions.names() if not n.startswith(".")]
        first = json.loads(self.versions.read(names[0])) if names else {"key": key, "buckets": buckets}
        if first["key"] != key:
            raise ValueError(f"the table's key is {first['key']}")
        self.buckets = first["buckets"]

    def version(self) -> dict:
        """The last version: its number, the schema, and for each bucket that has rows the folder of its files."""
        names = [n for n in self.versions.names() if not n.startswith(".")]
        return json.loads(self.versions.read(names[-1])) if names else {"number": 0, "schema": None, "at": {}}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, version: dict, some: list[int] | None = None) -> DataFrame | None:
        at = [folder for b, folder in version["at"].items() if some is None or int(b) in some]
        if version["schema"] is None:
            return None
        schema = T.StructType.fromJson(version["schema"])
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in at])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one by its number."""
        version = self.version() if number is None else json.loads(self.versions.read(f"{number:012d}.json"))
        found = self._read(version)
        if found is None:
            raise LookupError(f"{self.path} has no version yet")
        return found

    def upsert(self, rows: DataFrame, newest: list[Column] | None = None) -> dict:
        """Put ``rows`` in place of those with the same key and add the others. See :meth:`_change`.

        Of several rows of one key in ``rows`` the first by ``newest`` counts; without an order that is an error.
        """
        if newest is not None:
            first = F.row_number().over(Window.partitionBy(*self.key).orderBy(*newest))
            rows = rows.withColumn("_first", first).filter("_first = 1").drop("_first")
        elif not rows.groupBy(*self.key).count().filter("count > 1").isEmpty():
            raise ValueError("a key is there twice; give an order")

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            same = [old[k].eqNullSafe(new[k]) for k in self.key]
            return old.join(new, same, "left_anti").unionByName(new)

        return self._change(rows, merged)

    def delete(self, keys: DataFrame) -> dict:
        """Remove the rows with these keys."""
        return self._change(keys.select(*self.key).distinct(), lambda old, new: old.join(new, [old[k].eqNullSafe(new[k]) for k in self.key], "left_anti"))

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """Rewrite the buckets of ``rows`` and switch to a new version, which is returned. Other buckets' files stay as they are.

        What a broken change leaves is in no version. If another change came first, :class:`Conflict` is raised and this one has
        had no effect.
        """
        before = self.version()
        rows = rows.withColumn("_bucket", self._bucket())
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most the number of buckets
        old = self._read(before, touched)
        new = rows.drop("_bucket")
        schema = before["schema"] or json.loads(new.schema.json())
        made = merge(new.limit(0) if old is None else old, new).select(*[f["name"] for f in schema["fields"]]).withColumn("_bucket", self._bucket())
        folder = f"data/{uuid.uuid4().hex}"
        made.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {n.partition("=")[2] for n in Folder(self.spark, f"{self.path}/{folder}").names() if n.startswith("_bucket=")}
        at = {b: f for b, f in before["at"].items() if int(b) not in touched} | {b: f"{folder}/_bucket={b}" for b in there}
        version = {"number": before["number"] + 1, "key": self.key, "buckets": self.buckets, "schema": schema, "at": at}
        if not self.versions.create(f"{version['number']:012d}.json", json.dumps(version)):
            raise Conflict(f"version {version['number']} of {self.path} has been written by another change")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data that the last ``keep`` versions don't use, and older versions. Not for use while a change runs."""
        names = [n for n in self.versions.names() if not n.startswith(".")]
        used = {f.split("/")[1] for n in names[-keep:] for f in json.loads(self.versions.read(n))["at"].values()}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [n for n in data.names() if n not in used]
        for n in names[:-keep]:
            self.versions.delete(n)
        for n in gone:
            data.delete(n)
        return gone


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The state that a log of changes leaves: for each key and column the last value that is not null, by ``order``.

    A change names the columns that it sets and leaves the others null, so a later change keeps what an earlier one has set.
    """
    rest = [c for c in log.columns if c not in key]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))).getField("_v").alias(c) for c in rest]
    return log.groupBy(*key).agg(*last).select(*log.columns)


class PageIndex:
    """Rows in a total order, in range partitions at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def build(df: DataFrame, order: list[Column], path: str, partitions: int = 64) -> PageIndex:
        """Write ``df`` sorted by ``order`` and count the rows of each partition."""
        spark = df.sparkSession
        ranged = df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
        ranged.sortWithinPartitions(*order).write.partitionBy("_part").parquet(f"{path}/rows")
        Folder(spark, path).create("schema.json", df.schema.json())
        spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return PageIndex(spark, path)

    def total(self) -> int:
        return self.spark.read.parquet(f"{self.path}/counts").agg(F.sum("n")).first()[0] or 0

    def page(self, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit - 1`` in order; only the partitions that hold them are read."""
        counts = sorted((r["_part"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/counts").collect())  # one row for each partition
        before, parts, skipped = 0, [], 0
        for part, n in counts:
            if before + n <= offset:
                skipped = before + n
            elif before < offset + limit:
                parts.append(part)
            before += n
        schema = T.StructType.fromJson(json.loads(Folder(self.spark, self.path).read("schema.json")))
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/_part={p}" for p in parts])
        return rows.orderBy(*order).offset(offset - skipped).limit(limit)
