"""Removal of repeated passages: words inside a window of ``window`` words that also starts anywhere else.

Only windows that can be repeated are looked at one by one:

* equal word sequences are one class; a class of several rows is repeated as a whole;
* every window is named by its smallest rolling hash of ``gram`` words (equal windows have equal names, and few grams
  are the smallest of any window), and a window whose name stands at one place only is unique;
* the 128-bit hashes of the other windows are counted over all classes; those that occur again are marked.

Counts are combined before they are shuffled and the marks come back through joins that can be split, so neither a
passage nor a text that a third of all rows share meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.decontaminate import union
from framewell.llm.shared import bound_batches, keep_ids, stash

KEY = ["k1", "k2", "n_words"]


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 35
    gram: int = 8


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or largest) of each ``n`` consecutive values, in about log n passes."""
    pick = np.minimum if least else np.maximum
    out, size = x, 1
    while size * 2 <= n:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def names(hashes: np.ndarray, conf: SubstringDedup) -> tuple[np.ndarray, np.ndarray]:
    """The name of each window of one text, and the hash at each place that gives some window its name."""
    grams = K.rolling(hashes, conf.gram, seed=0x6A)
    n = conf.window - conf.gram + 1
    name = _sliding(grams, n, True)
    edge = np.zeros(n - 1, dtype=K.U64)
    return name, grams[_sliding(np.concatenate([edge, name, edge]), n, False) == grams]


def _windows(hashes: np.ndarray, conf: SubstringDedup) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    return K.rolling(hashes, conf.window, seed=0x35).view(np.int64), K.rolling(K.mix(hashes ^ K.U64(0x7A3D)), conf.window, seed=0x36).view(np.int64)


def _once_or_twice(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct pair once, and once more if it is there several times."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    nth = np.concatenate([np.ones(min(len(a), 1), bool), ~same])
    second = np.zeros(len(a), bool)
    second[1:] = same & nth[:-1]
    return a[nth | second], b[nth | second]


def _among(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Which pairs are among the known ones."""
    order = np.lexsort((known_b, known_a))
    known_a, known_b = known_a[order], known_b[order]
    at, stop = np.searchsorted(known_a, a), np.searchsorted(known_a, a, side="right")
    out = np.zeros(len(a), dtype=bool)
    while (at < stop).any():  # as often as the first halves of different pairs agree: once
        live = np.flatnonzero(at < stop)
        out[live] |= known_b[at[live]] == b[live]
        at[live] += 1
    return out


def _sequence(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a word sequence."""
    at = np.arange(1, len(hashes) + 1, dtype=K.U64)
    return tuple(int(K.mix(hashes + at * K.U64(s)).sum(dtype=K.U64).view(np.int64)) for s in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, word hashes and bytes of each text."""
    for block in K.blocks(batch.column(column), K.NON_SPACE):
        hashes = block.hashes(fold=False)
        for i in range(len(block.first) - 1):
            a, b = block.first[i], block.first[i + 1]
            yield block.lo + i, hashes[a:b], block.data[block.start[a] : block.end[b - 1]].tobytes() if b > a else b""


def row_id() -> Column:
    """What finds a row's text again: its doc_id, or a hash of the text. Rows that share it are told apart by their words."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def survey(documents: DataFrame, conf: SubstringDedup) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("k1", "k2", "n_words", "whole_sha256", "names")}
            for _, hashes, raw in _texts(batch, 1):
                k1, k2 = _sequence(hashes)
                marks = np.zeros(0, K.U64)
                if len(hashes) >= conf.window:
                    value, count = np.unique(names(hashes, conf)[1], return_counts=True)
                    marks = np.concatenate([value, value[count > 1]])
                for k, v in (("k1", k1), ("k2", k2), ("n_words", len(hashes)), ("whole_sha256", hashlib.sha256(b" ".join(raw.split())).hexdigest()), ("names", marks.view(np.int64))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(out[k], t) for k, t in (("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("names", pa.list_(pa.int64()))))], names=["doc_id", "id", *out])

    return documents.mapInArrow(run, "doc_id long, id long, k1 long, k2 long, n_words long, whole_sha256 string, names array<long>")


def windows(texts: DataFrame, conf: SubstringDedup) -> DataFrame:
    """Of each class, the hashes of windows whose name is in ``shared``: k1, k2, n_words, windows. A pair of hashes is there once, or
    twice if it stands at several places of the text. Rows whose text is of another class are dropped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            shared = batch.column("shared")
            rows, a, b, size = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for i, hashes, _ in _texts(batch, batch.schema.get_field_index("text")):
                if (*_sequence(hashes), len(hashes)) != keys[i]:
                    continue
                named = np.isin(names(hashes, conf)[0], np.asarray(shared[i].values).view(K.U64))
                pair = _once_or_twice(*(x[named] for x in _windows(hashes, conf)))
                rows.append(i)
                for to, x in zip((a, b), pair, strict=True):
                    to.append(x)
                size.append(len(pair[0]))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["w1", "w2"])
            found = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pairs)
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in KEY), found], names=[*KEY, "windows"])

    return texts.mapInArrow(run, "k1 long, k2 long, n_words long, windows array<struct<w1: long, w2: long>>")


def cut(texts: DataFrame, conf: SubstringDedup) -> DataFrame:
    """What is left of each class's text without the windows that are in ``repeated``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            rows: dict[str, list] = {k: [] for k in (*KEY, "n_removed", "kept_sha256", "spans")}
            for i, hashes, raw in _texts(batch, batch.schema.get_field_index("text")):
                if (*_sequence(hashes), len(hashes)) != keys[i]:
                    continue
                known = batch.column("repeated")[i].values
                start = np.flatnonzero(_among(*_windows(hashes, conf), *(np.asarray(known.field(k)) for k in (0, 1))))
                spans = union(np.stack([start, start + conf.window], axis=1))
                words, kept, at = raw.split(), [], 0
                for a, b in spans.tolist():
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                values = (*keys[i], len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()])
                for k, v in zip(rows, values, strict=True):
                    rows[k].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return texts.mapInArrow(run, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def remove_repeats(documents: DataFrame, conf: SubstringDedup = SubstringDedup()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans.

    Words are runs of non-space, unchanged. A word goes if any window that covers it also starts elsewhere, in another
    row or in the same text; all occurrences go. ``spans`` are the removed words as merged start and end,
    ``kept_sha256`` is the hash of the rest, joined by one space. Texts shorter than the window, empty ones and nulls stay
    as they are. Repeated rows repeat each other's windows. Windows are compared by two 64-bit hashes.
    """
    bound_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stash(survey(rows.withColumn("id", row_id()), conf))
    classes = stash(found.filter(f"n_words >= {conf.window}").groupBy(*KEY).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("names").alias("names")))
    each = classes.select(*KEY, "id", F.explode("names").alias("name"))
    again = each.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    met = stash(each.join(again, "name").groupBy(*KEY, "id").agg(F.collect_set("name").alias("shared")))

    texts = rows.select(row_id().alias("id"), "text")
    texts = stash(keep_ids(texts, met.select("id").distinct(), ["id"]).join(met, "id").dropDuplicates([*KEY, "text"]).select(*KEY, "text", "shared"), compression="zstd")
    seen = stash(windows(texts, conf).select(*KEY, F.inline("windows")))
    repeated = seen.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    marked = seen.join(repeated, ["w1", "w2"]).groupBy(*KEY).agg(F.collect_set(F.struct("w1", "w2")).alias("repeated"))
    partly = cut(texts.select(*KEY, "text").join(marked, KEY), conf)

    whole = classes.filter("copies > 1").select(*KEY, F.lit(True).alias("whole"))
    out = found.select("doc_id", *KEY, "whole_sha256").join(whole, KEY, "left").join(partly, KEY, "left")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("whole"), span).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))).alias("spans"),
    )
