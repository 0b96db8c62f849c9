"""Sound from WAV files: a data source that deals out byte ranges, so that one long file is read by many tasks and many short ones by
one.

    spark.dataSource.register(WavSource)
    samples = spark.read.format("framewell_wav").load("folder or file")

A row is a sample: path, rate (samples a second), n (its number in the file) and value, the mean of the channels on the scale of
16 bits. Uncompressed files of 8, 16, 24 or 32 bits and of floats are read. Files may be in any store that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewell.config import DEFAULTS, Settings

SCHEMA = "path string, rate int, n long, value double"
#: Rows of a batch.
ROWS = 1 << 16


class NotSound(ValueError):
    """The file is no WAV file, or of a kind that is not read."""


@dataclass(frozen=True)
class Header:
    """Where the samples of a file are, and how they are written."""

    start: int
    size: int
    rate: int
    channels: int
    bits: int
    floats: bool

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def header(file: pa.NativeFile, size: int, name: str) -> Header:
    """Read the chunks up to the samples. A size of samples that is missing or beyond the file's end means: up to its end."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise NotSound(f"{name} is no WAV file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        kind, long = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            raw = file.read(min(long, 40))
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            tag = struct.unpack("<H", raw[24:26])[0] if tag == 0xFFFE and len(raw) >= 26 else tag
            if channels < 1 or rate < 1 or (tag, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
                raise NotSound(f"{name}: format {tag} of {bits} bits in {channels} channels is not read")
            form = (rate, channels, bits, tag == 3)
        elif kind == b"data":
            if form is None:
                raise NotSound(f"{name} has no format before its samples")
            left = size - at - 8
            return Header(at + 8, left if long in (0, 0xFFFFFFFF) else min(long, left), *form)
        at += 8 + long + long % 2
    raise NotSound(f"{name} has no samples")


def decoded(raw: bytes, head: Header) -> np.ndarray:
    """The mean of the channels of each sample, on the scale of 16 bits."""
    if head.floats:
        out = np.frombuffer(raw, f"<f{head.bits // 8}").astype(np.float64) * 32768.0
    elif head.bits == 8:
        out = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128.0) * 256.0
    elif head.bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        out = wide.view("<i4").ravel().astype(np.float64) / 65536.0
    else:
        out = np.frombuffer(raw, f"<i{head.bits // 8}").astype(np.float64) / 2.0 ** (head.bits - 16)
    return out.reshape(-1, head.channels).mean(axis=1)


@dataclass
class Range:
    """Samples that begin within bytes ``first`` to ``last - 1`` of a file."""

    path: str
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


#: Tasks over which all ranges are dealt out; each takes neighbouring ones.
TASKS = 256


class WavReader(DataSourceReader):
    def __init__(self, path: str, bytes_each: int):
        self.path, self.bytes_each = path, bytes_each

    def partitions(self) -> list[Ranges]:
        """Ranges by the files' sizes alone; their headers are read by the tasks. Beyond
        ``TASKS`` ranges a task takes several, so that many short files do not become as many tasks."""
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.extension.lower() == "wav"]
        ranges = [Range(f.path, at, min(at + self.bytes_each, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.bytes_each)]
        each = max(1, -(-len(ranges) // TASKS))
        return [Ranges(ranges[i : i + each]) for i in range(0, len(ranges), each)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        for part in partition.ranges:
            yield from self._samples(store, part)

    def _samples(self, store: fs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        size = store.get_file_info(partition.path).size
        with store.open_input_file(partition.path) as file:
            head = header(file, size, partition.path)
            number = lambda byte: -(-max(0, byte - head.start) // head.width)  # noqa: E731  of the first sample at or after a byte
            at, end = number(partition.first), min(number(partition.last), head.size // head.width)
            while at < end:
                n = min(ROWS, end - at)
                file.seek(head.start + at * head.width)
                values = decoded(file.read(n * head.width), head)
                yield pa.RecordBatch.from_pydict({"path": pa.array([partition.path] * n), "rate": pa.array(np.full(n, head.rate, np.int32)), "n": pa.array(np.arange(at, at + n)), "value": pa.array(values)})
                at += n


class WavSource(DataSource):
    """``path``: a file, or a folder whose .wav files are read. ``bytes``: of a file for one task (16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "framewell_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:  # noqa: ANN001
        return WavReader(self.options["path"], int(self.options.get("bytes", 1 << 24)))


def read_wav(spark: SparkSession, path: str, bytes_each: int = 1 << 24) -> DataFrame:
    spark.dataSource.register(WavSource)
    return spark.read.format("framewell_wav").option("bytes", bytes_each).load(path)


def loudness(samples: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Root mean square of each audio window of ``samples`` (path, rate, n, value), relative to the file's loudest: path, timestamp,
    energy. A window is ``audio_window_seconds`` long, in whole samples, and at least one."""
    size = F.greatest(F.lit(1), F.floor(F.col("rate") * conf.audio_window_seconds).cast("int"))
    rms = samples.groupBy("path", "rate", F.floor(F.col("n") / size).alias("window")).agg((F.sqrt(F.avg(F.col("value") * F.col("value"))) / 32768).alias("rms"))
    peak = F.max("rms").over(Window.partitionBy("path"))
    return rms.select("path", (F.col("window") * size / F.col("rate")).alias("timestamp"), F.when(peak > 0, F.least(F.lit(1.0), F.col("rms") / peak)).otherwise(F.lit(0.0)).alias("energy"))
