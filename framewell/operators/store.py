"""Results that several stages share are written once and read back: a graph of named stages over DataFrames.

A stage is a function of the results of other stages. When results are asked for, every stage that more than one of them
uses, directly or through each other, is written to the folder that all executors share, under a fingerprint of all that it
depends on; stages used once stay part of their user's plan, where Catalyst optimises across them. A result whose
fingerprint is already there is read back and not made again, also by another graph.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[..., DataFrame]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir`` or set by the caller.

    Where neither is set, a local session gets one under its warehouse; on a cluster that is an error, since a folder of one
    machine can't be read by the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/framewell-stages")
    return context.getCheckpointDir()


def files_of(df: DataFrame) -> str:
    """The files below a DataFrame, with their sizes and times, as a short text; empty if it reads none."""
    files = sorted(df.inputFiles())
    if not files:
        return ""
    listed = df.sparkSession.read.format("binaryFile").load(files).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    return str(listed.agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class StageGraph:
    """Stages by name. ``settings`` are whatever the stages depend on besides their inputs; their ``repr`` is fingerprinted."""

    def __init__(self, spark: SparkSession, settings: object = None):
        self.spark, self.settings = spark, settings
        self.stages: dict[str, tuple[Stage, tuple[str, ...]]] = {}
        self.inputs: dict[str, DataFrame] = {}
        self.kept: set[str] = set()
        self._prints: dict[str, str] = {}
        #: Stages written, and read back from earlier, by this graph.
        self.written: list[str] = []
        self.reused: list[str] = []

    def input(self, name: str, df: DataFrame, keep: bool = False) -> StageGraph:
        """A given DataFrame. If several stages use it, or with ``keep``, its rows are stored like those of a shared stage."""
        self._free(name)
        self.inputs[name] = df
        self.kept |= {name} if keep else set()
        return self

    def stage(self, name: str, make: Stage, *needs: str, keep: bool = False) -> StageGraph:
        """``make`` gets the results of ``needs``, which must be there already. With ``keep`` its rows are stored whenever another stage
        needs them, so that its shuffles are gone before those of its user begin."""
        self._free(name)
        if missing := [n for n in needs if n not in self.stages and n not in self.inputs]:
            raise KeyError(f"stage {name!r} needs {', '.join(missing)}")
        self.stages[name] = (make, needs)
        self.kept |= {name} if keep else set()
        return self

    def _free(self, name: str) -> None:
        if name in self.stages or name in self.inputs:
            raise ValueError(f"there is a stage {name!r} already")

    def fingerprint(self, name: str) -> str:
        """Of a stage: its name and function, the settings and the fingerprints of its needs. Of an input: its plan, columns and files."""
        if name in self._prints:
            return self._prints[name]
        if name in self.inputs:
            df = self.inputs[name]
            plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
            parts = [df.semanticHash(), plan, df.schema.json(), files_of(df)]
        else:
            make, needs = self.stages[name]
            parts = [name, make.__module__, make.__qualname__, self.settings, *map(self.fingerprint, needs)]
        self._prints[name] = hashlib.sha256("\n".join(map(repr, parts)).encode()).hexdigest()[:40]
        return self._prints[name]

    def uses(self, wanted: tuple[str, ...]) -> dict[str, int]:
        """How many users each stage that ``wanted`` needs has, the caller included."""
        out: dict[str, int] = dict.fromkeys(wanted, 1)
        open_, seen = list(dict.fromkeys(wanted)), set(wanted)
        while open_:
            for need in self.stages.get(open_.pop(), (None, ()))[1]:
                out[need] = out.get(need, 0) + 1
                if need not in seen:
                    seen.add(need)
                    open_.append(need)
        return out

    def results(self, *wanted: str) -> list[DataFrame]:
        """The results of ``wanted``; what they share has been written and is read back."""
        uses, done = self.uses(wanted), {}

        def result(name: str) -> DataFrame:
            if name not in done:
                make, needs = self.stages.get(name, (None, ()))
                shared = uses[name] > 1 or name in self.kept and (name in self.inputs or name not in wanted)
                if shared and (stored := self._stored(name)) is not None:
                    done[name] = stored
                else:
                    df = self.inputs[name] if make is None else make(*map(result, needs))
                    done[name] = self._write(name, df) if shared else df
            return done[name]

        return [result(name) for name in wanted]

    def _path(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/stages/{self.fingerprint(name)}"

    def _system(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stored(self, name: str) -> DataFrame | None:
        path = self._path(name)
        mark, system = self._system(f"{path}/_SUCCESS")
        if not system.exists(mark):
            return None
        self.reused.append(name)
        return self.spark.read.parquet(path)

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        """Write beside the path and rename, so a broken run leaves nothing that looks finished, and of two writers one wins. The
        shuffles that made it are removed."""
        path = self._path(name)
        draft = f"{path}-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.parquet(draft, compression="zstd")
        source, system = self._system(draft)
        target, _ = self._system(path)
        if system.exists(target) or not system.rename(source, target):
            system.delete(source, True)
        system.deleteOnExit(target)
        self.written.append(name)
        return self.spark.read.schema(df.schema).parquet(path)
