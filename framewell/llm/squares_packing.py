"""Sum-of-squares online packing of token sequences.

A task packs its documents as they come, in the order of its input, so no text or token is shuffled; the placed pieces are
stored. What a document fills
whole windows with goes into windows of its own; the rest is placed at the fill level that gives the smallest sum of
squares of the numbers of partially filled windows at each level (Csirik et al., "On the sum-of-squares algorithm for bin
packing", 2006). An array holds these numbers. At the end of a task (or when ``open_windows`` are open) the windows left
are closed: pieces of the emptiest are cut to fill the fullest, and the last is dealt out to sequences of a power of two,
which need no padding. A task holds its open windows and no more.
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

from framewell.llm.byte_tokens import encoder
from framewell.llm.shared import BATCH_ROWS, small_batches, stash

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class SquaresPacking:
    """``tokenizer``: file of the tokenizer; it must be at that path on every machine. ``length``: a power of two."""

    tokenizer: str
    length: int = 2048
    end_id: int = 1
    open_windows: int = 4096


#: Part of a document: doc_id, start, ids, tokens of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Windows:
    """Partially filled windows by fill level; ``counts[h]`` is the number of those that hold ``h`` tokens."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, dtype=np.int64)
        self.by_level: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose use for ``size`` tokens makes the sum of squares smallest; of several the fullest."""
        n = self.counts
        change = 2 * (n[size + 1 :] - n[1 : self.length + 1 - size]) + 2
        change[-1] -= 1  # a full window is at no level
        change[n[1 : self.length + 1 - size] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[size] + 1 else 0

    def put(self, piece: Piece) -> list[Piece] | None:
        """Place a piece shorter than a window; the window, if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        window = [piece]
        if level:
            window = self.by_level[level].pop()
            window.append(piece)
            self.counts[level] -= 1
            self.open -= 1
        level += size
        if level == self.length:
            return window
        self.by_level.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The open windows as full ones and, last, as sequences of a power of two; pieces of the emptiest are cut to fit."""
        left = [(h, w) for h in sorted(self.by_level, reverse=True) for w in self.by_level[h]]
        self.by_level, self.open = {}, 0
        self.counts[:] = 0
        spare: list[Piece] = []
        lo, hi = 0, len(left)
        while lo < hi:
            level, window = left[lo]
            lo += 1
            while level < self.length and (spare or lo < hi):
                if not spare:
                    hi -= 1
                    spare = left[hi][1]
                doc_id, start, ids, tokens = spare.pop()
                part = ids[: self.length - level]
                window.append((doc_id, start, part, tokens))
                level += len(part)
                if len(part) < len(ids):
                    spare.append((doc_id, start + len(part), ids[len(part) :], tokens))
            if level == self.length:
                yield window
            else:
                spare = window
        while spare:
            rest = sum(len(p[2]) for p in spare)
            room, window = 1 << rest.bit_length() - 1, []
            while room:
                doc_id, start, ids, tokens = spare.pop()
                part = ids[:room]
                window.append((doc_id, start, part, tokens))
                room -= len(part)
                if len(part) < len(ids):
                    spare.append((doc_id, start + len(part), ids[len(part) :], tokens))
            yield window


def pack_squares(documents: DataFrame, conf: SquaresPacking, with_ids: bool = False) -> DataFrame:
    """Per piece of ``documents`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and,
    with ``with_ids``, its little-endian 32-bit ids).

    A null or empty text is its end id alone. Each id lies in one piece; pieces of a sequence follow each other without a
    gap, and every sequence is full or of a power of two tokens, so none is padded. Repeated rows, and rows without a
    doc_id, are packed like any others; other columns may have any names. An empty table gives no piece. A task that runs
    again replaces all of its own sequences, so a lost executor leaves no piece out and none twice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(conf.tokenizer), Windows(conf.length)
        shard, made, rows = TaskContext.get().partitionId() << 40, 0, []

        def add(window: list[Piece]) -> None:
            nonlocal made
            at = 0
            for doc_id, start, ids, tokens in window:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, shard + made, at, raw if with_ids else None))
                at += len(ids)
            made += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, texts in encode.column(batch.column(1)):
                for doc_id, ids in zip(names[lo:], texts, strict=False):
                    ids = np.append(ids, np.uint32(conf.end_id))
                    whole = len(ids) // conf.length * conf.length
                    for at in range(0, whole, conf.length):
                        add([(doc_id, at, ids[at : at + conf.length], len(ids))])
                    if whole < len(ids):
                        if full := windows.put((doc_id, whole, ids[whole:].copy(), len(ids))):
                            add(full)
                        if windows.open > conf.open_windows:
                            for window in windows.close():
                                add(window)
                if rows:
                    yield taken()
        for window in windows.close():
            add(window)
        yield taken()

    schema = PLACED + ", ids binary" * with_ids
    with small_batches(documents.sparkSession, BATCH_ROWS):
        return stash(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
