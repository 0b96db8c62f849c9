"""Best-fit packing of token sequences: bounded-space online best fit.

Documents are tokenized once, and their pieces' lengths are stored. Pieces are then dealt to shards by hash; each shard
packs its pieces in one pass with at most ``open_bins`` open sequences. A bitset with one bit for each amount of free
space finds the fullest sequence that still takes a piece. When no sequence takes it and all are in use, the fullest
closes. A shard holds only its open sequences in memory, and the number of shards follows the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.shared import bound_batches, stash
from framewell.llm.tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Packing:
    """``tokenizer``: file of the tokenizer; it must be at that path on every machine."""

    tokenizer: str
    length: int = 4096
    end_id: int = 1
    open_bins: int = 256
    pieces_per_shard: int = 100_000


def pieces(documents: DataFrame, conf: Packing, with_ids: bool = False) -> DataFrame:
    """The documents' pieces of at most ``length`` tokens; with ``with_ids`` also their little-endian 32-bit ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(conf.tokenizer)
        for batch in batches:
            docs = batch.column(0)
            for lo, texts in encode.column(batch.column(1)):
                rows, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(texts, lo):
                    data = np.append(ids, np.uint32(conf.end_id)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(data) // 4, conf.length)):
                        part = data[4 * at : 4 * (at + conf.length)]
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        raw.append(part)
                out = {"doc_id": docs.take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


class Bins:
    """Open sequences of ``length`` tokens, found by their free space."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free = 0  # bit f is set if a sequence with f tokens of free space is open
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.free &= ~(1 << free)
        self.open -= 1
        return out

    def put(self, size: int) -> tuple[int, int]:
        """The sequence that takes a piece, and the place in it."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.length, self.made
            self.made += 1
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
        if free > size:
            left = free - size
            self.by_free.setdefault(left, []).append(name)
            self.free |= 1 << left
            self.open += 1
        return name, self.length - free


def pack(cut: DataFrame, conf: Packing) -> DataFrame:
    """``cut`` (stored; see :func:`pieces`) with sequence_id and offset, dealt by its column ``row``, so that repeated rows spread.
    Shards are packed in an order fixed by the rows, so a task that runs again gives the same."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, shard = Bins(conf.length, conf.open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield batch.append_column("sequence_id", pa.array([shard + x[0] for x in placed], pa.int64())).append_column("offset", pa.array([x[1] for x in placed], pa.int64()))

    shards = max(1, -(-cut.count() // conf.pieces_per_shard))
    dealt = cut.repartition(shards, F.xxhash64("row", "piece")).sortWithinPartitions(F.xxhash64("row", "piece"), "row", "piece").drop("row")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, conf: Packing, with_ids: bool = False) -> DataFrame:
    """Per piece of ``documents`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Only documents longer than ``length`` are cut. Repeated rows, and rows
    without a doc_id, are packed like any others. An empty table gives no piece.
    """
    bound_batches(documents)
    return pack(stash(pieces(documents, conf, with_ids).withColumn("row", F.monotonically_increasing_id())), conf)
