"""One file for each row, under its own name: a data source that writes with task commit and abort.

    spark.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("framewell_files").mode("append").save("folder")

A task writes its files beside their places and moves them there once all of its rows are written, so a task that fails leaves
nothing; if the job fails, what other tasks have put in place is taken away again, and ``_SUCCESS`` appears last. With ``append`` a
name that is there already is an error; ``overwrite`` replaces files of the same names and leaves others alone. Files may be in
any store that ``pyarrow.fs`` opens.

    spark.read.format("framewell_files").option("files", "ep*/subtitles/*.srt").load("folder")

Read back, a row is a file: name and content. The driver looks for the folders alone; their files are listed and read by the tasks,
several of which share each folder.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


class BadName(ValueError):
    """A name is empty, leaves the folder, is there twice, or is taken."""


@dataclass
class Put(WriterCommitMessage):
    """Where a task has listed the files that it has put in place: their names stay out of the driver."""

    journal: str


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Put:
        store, root = fs.FileSystem.from_uri(self.path)
        mark, drafts, folders = uuid.uuid4().hex, {}, set()
        try:
            for batch in iterator:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                for name, content in zip(columns["name"].to_pylist(), columns["content"].to_pylist(), strict=True):
                    parts = (name or "").split("/")
                    if not all(parts) or {".", ".."} & set(parts) or name in drafts:
                        raise BadName(f"{name!r} is no name, or is there twice")
                    if not self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                        raise BadName(f"{name} is there already")
                    folder = "/".join([root, *parts[:-1]])
                    if folder not in folders:
                        store.create_dir(folder, recursive=True)
                        folders.add(folder)
                    drafts[name] = f"{folder}/.{parts[-1]}.{mark}"
                    with store.open_output_stream(drafts[name]) as out:
                        out.write(content.encode() if isinstance(content, str) else content or b"")
            put = Put(f"{root}/.{mark}.names")
            store.create_dir(root, recursive=True)
            with store.open_output_stream(put.journal) as out:
                out.write(json.dumps(list(drafts)).encode())
            while drafts:
                name, draft = drafts.popitem()
                store.move(draft, f"{root}/{name}")
            return put
        finally:
            for draft in [*drafts.values(), f"{root}/.{mark}.names"] if drafts else []:
                with suppress(OSError):
                    store.delete_file(draft)

    def commit(self, messages: list[Put | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        for message in filter(None, messages):
            store.delete_file(message.journal)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Put | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            with store.open_input_stream(message.journal) as journal:
                names = json.loads(journal.read())
            for name in names if not self.overwrite else []:
                with suppress(OSError):
                    store.delete_file(f"{root}/{name}")
            store.delete_file(message.journal)


#: Tasks that share a folder; files and bytes of a batch.
SHARES, FILES, BYTES = 8, 1000, 1 << 24


@dataclass
class Share(InputPartition):
    """The files of a folder whose names fall to one of its tasks."""

    folder: str
    number: int


class FilesReader(DataSourceReader):
    def __init__(self, path: str, files: str):
        self.path = path
        *self.folders, self.files = files.split("/")

    def partitions(self) -> list[Share]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = [""]
        for part in self.folders:
            listed = [(f, info) for f in found for info in store.get_file_info(fs.FileSelector(f"{root}/{f}".rstrip("/"), allow_not_found=True))]
            found = [f"{f}{info.base_name}/" for f, info in listed if info.type == fs.FileType.Directory and fnmatchcase(info.base_name, part)]
        return [Share(f, n) for f in sorted(found) for n in range(SHARES)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder
            return
        store, root = fs.FileSystem.from_uri(self.path)
        names, contents, held = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
        for info in store.get_file_info(fs.FileSelector(f"{root}/{partition.folder}".rstrip("/"), allow_not_found=True)):
            if not info.is_file or info.base_name.startswith((".", "_")) or not fnmatchcase(info.base_name, self.files) or zlib.crc32(info.base_name.encode()) % SHARES != partition.number:
                continue
            with store.open_input_stream(info.path) as file:
                contents.append(file.read())
            names.append(partition.folder + info.base_name)
            held += len(contents[-1])
            if len(names) >= FILES or held >= BYTES:
                yield batch()
                names, contents, held = [], [], 0
        if names:
            yield batch()


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framewell_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> FilesReader:  # noqa: ANN001
        return FilesReader(self.options["path"], self.options.get("files", "*"))

    def writer(self, schema, overwrite: bool) -> FilesWriter:  # noqa: ANN001
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows need the columns name and content")
        return FilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``files`` (name, content as text or bytes; null: empty). Rows are dealt out by name, so that one that is there twice is seen."""
    files.sparkSession.dataSource.register(NamedFiles)
    rows = files.select("name", "content").repartition("name")
    rows.write.format("framewell_files").mode("overwrite" if overwrite else "append").save(path)


def read_files(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """Files under ``path`` that fit a pattern, part for part (``ep*/subtitles/*.srt``): name, content."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("framewell_files").option("files", files).load(path)


def _indent(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2))


def indented(text: Column) -> Column:
    """JSON text with two spaces for each level, as it is written to files."""
    return F.pandas_udf(_indent, "string")(text)
