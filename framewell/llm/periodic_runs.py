"""Periodic runs of words: seeds on diagonals, extended once.

A run of smallest period ``q`` with at least ``4 * q`` words (and six) holds ``3 * q`` (and five) consecutive words that
stand again ``q`` words later. So for the lags of ``[2^j, 2^(j+1))`` any run holds a k-gram of ``k = 3 * 2^j`` words (five for
lag one) twice, ``q`` apart, and since ``k >= q`` no further occurrence lies between the two. The k-grams of a block of
documents are indexed, each by an exact number made of those of its halves; only pairs of neighbouring occurrences within
one document whose distance lies in the class are seeds, so a document of ``n`` words has at most ``n`` at each scale. A
seed is extended on its diagonal (the lag) in both directions by comparing words, unless the table of the furthest place
covered on that lag shows that it lies inside a stretch already extended. Grams that occur once are left out at the next
scale, so ordinary text costs little beyond the first.

Documents are worked on where they are read, and nothing is shuffled; a task holds half a megabyte of texts at once, or
one longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.shared import BATCH_ROWS, small_batches, stash


@dataclass(frozen=True)
class Runs:
    """Runs have ``least`` words and ``times`` periods, or more. The index relies on ``times >= 3``."""

    least: int = 6
    times: int = 4


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words of a document with its period written in, if its id asks for one (see the query's contract)."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbered(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


def seeds(words: np.ndarray, first: np.ndarray, conf: Runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of seeds, class by class. ``words`` are numbers of words, ``first[d]:first[d+1]`` those of document ``d``."""
    n = len(words)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    room = first[1:][doc] - np.arange(n)  # words from here to the end of the document

    def grams(left: np.ndarray, right: np.ndarray, shift: int, k: int) -> np.ndarray:
        """Numbers of the k-grams made of a ``left`` and, ``shift`` words on, a ``right`` one; -1 where there is none."""
        out = np.full(n, -1, dtype=np.int64)
        at = np.flatnonzero((left >= 0) & (room >= k))
        at = at[right[at + shift] >= 0]
        out[at] = numbered(left[at] * (n + 1) + right[at + shift])
        return out

    def neighbours(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and lags of neighbouring occurrences ``low`` to ``high - 1`` apart, and the names that occur again in their document."""
        at = np.flatnonzero(names >= 0)
        at = at[np.argsort(names[at], kind="stable")]
        again = (names[at[1:]] == names[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
        gap = at[1:] - at[:-1]
        hit = again & (gap >= low) & (gap < high)
        kept = np.full(n, -1, dtype=np.int64)
        for some in (at[:-1][again], at[1:][again]):
            kept[some] = names[some]
        return at[:-1][hit], gap[hit], kept

    two = grams(words, words, 1, 2)
    _, _, two = neighbours(two, 0, 0)
    three = grams(two, words, 2, 3)
    _, _, three = neighbours(three, 0, 0)
    at, lag, _ = neighbours(grams(three, two, 3, 5), 1, 2)
    yield at, lag
    names, k, low = three, 3, 2
    while low * conf.times <= max(size, default=0) and (names >= 0).any():
        names = grams(names, names, k, 2 * k)
        k *= 2
        at, lag, names = neighbours(names, low, 2 * low)
        yield at, lag
        low *= 2


def same_from(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two equally long arrays agree; looks ahead in doubling steps."""
    at, step = 0, 32
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(a)


def find_runs(words: np.ndarray, first: np.ndarray, conf: Runs) -> dict[int, list[tuple[int, int, int]]]:
    """By document, (start, length, period) of all its runs, by start, then period."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for places, lags in seeds(words, first, conf):
        order = np.argsort(places, kind="stable")
        places, lags = places[order], lags[order]
        docs = np.searchsorted(first, places, side="right") - 1
        covered: dict[int, int] = {}  # by lag: the furthest place up to which the diagonal is done
        for at, q, d in zip(places.tolist(), lags.tolist(), docs.tolist(), strict=True):
            if at < covered.get(q, -1):
                continue
            lo, hi = int(first[d]), int(first[d + 1])
            ahead = same_from(words[at : hi - q], words[at + q : hi])
            behind = same_from(words[lo:at][::-1], words[lo + q : at + q][::-1])
            covered[q] = at + max(ahead, 1)
            length = behind + ahead + q
            if length >= max(conf.least, conf.times * q):
                found[d].append((at - behind - lo, length, q))
    return {d: sorted(runs, key=lambda r: (r[0], r[2])) for d, runs in found.items()}


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: More columns of :func:`periodic_runs`.
DETAIL = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]], detail: bool) -> tuple:
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, q in runs:
            change[start + q] += 1
            change[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{start},{length},{q}\n" for start, length, q in runs)
    text = b" ".join(kept)
    out = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text.decode()) if detail else out


def periodic_runs(documents: DataFrame, conf: Runs | None = None, plant: bool = False, detail: bool = True) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): its periodic runs of words ``[^\\x20\\x09-\\x0D]+``.

    doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest length/period (ties: smallest
    start, then period; null without a run); runs_sha256 of the listed runs, collapsed_sha256 of the words left when each run
    keeps its first period; and with ``detail`` the ``runs`` and the ``collapsed`` text. A null or empty text has no words and
    no run. Repeated rows each get their row, rows without a doc_id too; other columns may have any names; an empty table
    gives no row. With ``plant`` a period is first written into documents by their id (none without an id).
    """
    conf = conf or Runs()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.name for x in schema]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = K.buffers(batch.column(1))
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + K.BLOCK_BYTES, side="right")) - 1))
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
                if plant:
                    texts = [words if doc_id is None else planted(words, doc_id) for doc_id, words in zip(ids[lo:hi], texts, strict=True)]
                first = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
                number: dict[bytes, int] = defaultdict(lambda: len(number))  # noqa: B023
                numbers = np.fromiter((number[w] for words in texts for w in words), np.int64, int(first[-1]))
                runs = find_runs(numbers, first, conf)
                rows = [described(doc_id, words, runs.get(i, []), detail) for i, (doc_id, words) in enumerate(zip(ids[lo:hi], texts, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], names)
                lo = hi
            K.release()

    ddl = SCHEMA + DETAIL * detail
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in SCHEMA.split(", ")] + [("runs", run_type), ("collapsed", pa.string())] * detail)
    with small_batches(documents.sparkSession, BATCH_ROWS):
        return stash(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl))
