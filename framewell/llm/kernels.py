"""Vectorised word scanning over Arrow string columns.

Tasks read a batch of texts as one byte buffer and find words, word hashes and shingle hashes with numpy, so that no
Python loop runs per word. A null text counts as empty. Work goes in blocks of about half a megabyte of text to bound
memory; one longer text makes a block of its own. Freed memory goes back to the system after each batch, since Python
workers live on from task to task and share an executor with its JVM.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
BLOCK_BYTES = 1 << 19
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _table(bytes_in_class: set[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[sorted(bytes_in_class)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NON_SPACE = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text with A-Z lower-cased: digits, letters and all beyond ASCII.
ALNUM = _table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_MULTIPLIER) + U64(seed)) | U64(1)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
#: Keeps the first n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


@dataclass
class Words:
    """Words of a block of texts. ``first[i]:first[i+1]`` are the words of text ``i``; ``start`` and ``end`` are bytes of ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    lo: int

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word, of its lower-cased form with ``fold``.

        Words are taken eight bytes at a time and the state is mixed after each, so no arrangement of their letters makes
        two words more alike than chance does.
        """
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
        padded[: len(self.data)] = FOLD[self.data] if fold else self.data
        lanes = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        out = mix((lanes[self.start] & _MASKS[np.minimum(size, 8)]) + size.astype(U64) * U64(_MULTIPLIER))
        for at in range(8, LONG_WORD, 8):
            more = np.flatnonzero(size > at)
            if not len(more):
                break
            out[more] = mix(out[more] * U64(_MULTIPLIER) ^ (lanes[self.start[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(padded[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; ``offsets[i]:offsets[i+1]`` is text ``i``, empty if null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lo: int = 0) -> Words:
    """The words of the texts at ``offsets`` of ``data``."""
    base = offsets[0]
    data = data[base : offsets[-1]]
    offsets = offsets - base
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), lo)
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets), lo)


def blocks(column: pa.Array, word_bytes: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """The column's texts, a block at a time; ``lo`` is the row of a block's first text."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield words(data, offsets[lo : hi + 1], word_bytes, lo)
        lo = hi
    release()


def rolling(hashes: np.ndarray, k: int, seed: int = 0x51) -> np.ndarray:
    """A hash of each ``k`` consecutive hashes, at the place of the first; shorter by ``k - 1``.

    Hashes of 1, 2, 4 ... consecutive ones are put together by the binary digits of ``k``, mixed at every step.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    join = lambda a, b: mix(a * U64(_MULTIPLIER) ^ b)
    run, size, out, covered = hashes, 1, None, 0
    while True:
        if k & size:
            part = run[covered : covered + n]
            out, covered = part if out is None else join(out, part), covered + size
        if covered == k:
            return mix(out + U64(seed + k))
        run, size = join(run[:-size], run[size:]), 2 * size


def grams(block: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-grams that lie within one text, and ``first`` of them by text (as in :class:`Words`)."""
    rolled = rolling(hashes, k)
    each = np.maximum(block.counts() - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(each)])
    place = np.repeat(block.first[:-1] - first[:-1], each) + np.arange(first[-1])
    return rolled[place], first
