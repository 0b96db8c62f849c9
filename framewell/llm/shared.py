"""Where operators keep intermediate tables, and joins whose small side has a checked size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns that may be broadcast (about 16 MB); beyond it a join is shuffled.
BROADCAST_ROWS = 500_000


#: Rows of whole texts that a Python task gets at once.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> None:
    """Let Python tasks of the session get at most :data:`BATCH_ROWS` rows at once: texts are long, and two tasks share an executor."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of what runs inside get at most ``rows`` rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads each file as one partition: a file of one long row can't be read in parts, which would leave tasks empty."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for key in keys:
        spark.conf.set(key, 1 << 40)
    try:
        yield
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, from ``spark.checkpoint.dir`` or set by the caller.

    Where neither is set, a local session (driver and tasks on one machine) gets one under its warehouse; on a cluster
    that is an error, since a folder of one machine would lose data without a word.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/framewell-stash")
    return context.getCheckpointDir()


def stash(df: DataFrame, *, partition_by: list[str] | None = None, compression: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut and a lost executor costs no rerun.

    Files have at most ``file_rows`` rows, if that isn't 0. The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path, partitionBy=partition_by, compression=compression)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, on: list[str], limit: int = BROADCAST_ROWS, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (not in them with ``left_anti``): broadcast if ``ids`` has at most ``limit`` rows, else a shuffled join."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, on, how)


def small_join(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS // 2) -> DataFrame:
    """``df`` joined with a stored table of a few numbers a row: broadcast if ``side`` has at most ``limit`` rows, else shuffled."""
    return df.join(F.broadcast(side) if side.count() <= limit else side, on, how)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def match_rows(df: DataFrame, keys: DataFrame, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` that are (``left_semi``) or are not (``left_anti``) among ``keys`` (doc_id, text_hash), by id and xxhash64 of
    the text; a null id equals a null one. Other columns of ``df`` may have any names."""
    row_id, row_hash = free_names(df, "row_id", "row_hash")
    keys = keys.select(F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_hash)).distinct()
    same = df["doc_id"].cast("long").eqNullSafe(F.col(row_id)) & (F.xxhash64(df["text"]) == F.col(row_hash))
    return df.join(F.broadcast(keys) if keys.count() <= limit else keys, same, how)
