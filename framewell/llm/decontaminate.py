"""Benchmark decontamination through a distributed positional inverted index.

Each task indexes the documents it reads: for every term that the benchmark uses, the sorted list of places where it
stands (postings by document, stored as a table in the shared folder, so later passes read neither text nor other
terms). Global term counts come from that table. A window of benchmark words is then looked up from its rarest term on:
the list of its rarest term, shifted by the term's offset in the window, is intersected with the shifted lists of the
others in order of rarity, by binary search in each list, so nearly all candidates go with the second list. What survives
all lists is an exact phrase match. Windows of which at least ``near_terms`` words stand in place, give or take ``slack``,
are proximity matches; one of their rarest terms must be in place.

The index is split by document, so a query costs no shuffle and a common term loads all tasks alike. The benchmark is
taken in blocks of at most ``block_chars`` characters, the only data that driver and tasks get whole: as arrays of numbers,
about 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.shared import bound_batches, stash

FOUND = "doc_id long, text_hash long, n_words long, spans binary, items array<string>, n_near long"


@dataclass(frozen=True)
class Decontamination:
    window: int = 13
    near_terms: int = 11
    slack: int = 2
    block_chars: int = 8_000_000


class Windows:
    """The distinct windows of a block of benchmark items: term numbers, lengths and the items they belong to."""

    def __init__(self, names: pa.Array, texts: pa.Array, window: int):
        hashes, first = [np.zeros(0, K.U64)], [np.zeros(1, np.int64)]
        for block in K.blocks(texts, K.ALNUM):
            hashes.append(block.hashes(fold=True))
            first.append(block.first[1:] + first[-1][-1])
        first = np.concatenate(first)
        self.vocabulary, terms = np.unique(np.concatenate(hashes), return_inverse=True)
        self.terms = terms.astype(np.int32)
        count = np.diff(first)
        size = np.minimum(count, window)
        each = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(each), dtype=np.int32), each)
        at = np.repeat(first[:-1] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        size = size[item]
        # equal windows have equal rows of terms; shorter ones are filled up with -1
        offset = np.arange(window)
        rows = np.where(offset < size[:, None], self.terms[np.minimum(at[:, None] + offset, max(len(terms) - 1, 0))], -1) if len(at) else np.zeros((0, window), np.int32)
        order = np.lexsort(rows.T[::-1])
        rows, item = rows[order], item[order]
        new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
        self.at, self.size = at[order][new], size[order][new]
        #: ``item[item_first[w]:item_first[w + 1]]`` are the places in ``names`` of the items of window w.
        self.item, self.item_first, self.names = item, np.append(new, len(item)), names

    def ranked(self, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and terms of each window from the rarest term on; short windows repeat their last."""
        offset = np.minimum(np.arange(window)[None, :], self.size[:, None] - 1)
        term = self.terms[self.at[:, None] + offset] if len(self.at) else np.zeros((0, window), np.int64)
        order = np.argsort(counts[term], axis=1, kind="stable") if len(self.at) else offset
        return np.take_along_axis(offset, order, 1).astype(np.int8), np.take_along_axis(term, order, 1).astype(np.int32)

    def items(self, windows: np.ndarray) -> set[str]:
        """Names of the items of some windows."""
        places = {i for w in windows.tolist() for i in self.item[self.item_first[w] : self.item_first[w + 1]].tolist()}
        return {self.names[i].as_py() for i in places}


def index(rows: DataFrame, vocabulary: np.ndarray, keep_text: bool) -> DataFrame:
    """Postings by document: ``terms`` and ``places`` are aligned 32-bit numbers, by term and then place."""
    schema = "doc_id long, text_hash long, n_words long, terms binary, places binary, spans binary, items array<string>, n_near long" + ", text string" * keep_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text"), K.ALNUM):
                n = len(block.first) - 1
                hashes = block.hashes(fold=True)
                term = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                at = np.flatnonzero(vocabulary[term] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                row = np.searchsorted(block.first, at, side="right") - 1
                term, place = term[at], at - block.first[row]
                order = np.lexsort((term, row))
                first = np.searchsorted(row, np.arange(n + 1)) * 4
                terms, places = term[order].astype("<i4").tobytes(), place[order].astype("<i4").tobytes()
                lists = [pa.array([x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()) for x in (terms, places)]
                own = batch.slice(block.lo, n)
                columns = [own.column("doc_id"), own.column("text_hash"), pa.array(block.counts()), *lists, own.column("spans"), own.column("items"), own.column("n_near")]
                yield pa.RecordBatch.from_arrays(columns + ([own.column("text")] if keep_text else []), names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def term_counts(postings: DataFrame, n_terms: int) -> np.ndarray:
    """How often each benchmark term stands in the whole corpus: as many numbers as the block has terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(counts[term])], names=["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for term, n in postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def look_up(postings: DataFrame, windows: Windows, conf: Decontamination) -> DataFrame:
    """All matches of the block's windows, added to what earlier blocks found: see :data:`FOUND`. ``spans``: pairs of first word and end."""
    counts = term_counts(postings, len(windows.vocabulary))
    offsets, terms = windows.ranked(counts, conf.window)
    live = np.flatnonzero(counts[terms].min(axis=1) > 0) if len(terms) else np.zeros(0, np.int64)
    nearby = np.flatnonzero((windows.size == conf.window) & (counts[terms] > 0).sum(axis=1).__ge__(conf.near_terms)) if len(terms) else live
    size, slack = windows.size, conf.slack
    n_terms = len(windows.vocabulary)

    def starts(which: np.ndarray, rank: int, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the windows' ``rank``-th rarest term: the window and where it would start."""
        term = terms[which, rank]
        n = first[term + 1] - first[term]
        at = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(which, n), place[at] - np.repeat(offsets[which, rank], n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_numpy()
            n = len(n_words)
            # a list of places in the batch; documents are so far apart that no window reaches from one into the next
            base = np.concatenate([[0], np.cumsum(n_words + conf.window + slack)])
            raw = batch.column("terms").to_pylist()
            term = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
            place = np.frombuffer(b"".join(batch.column("places").to_pylist()), "<i4") + np.repeat(base[:-1], [len(x) // 4 for x in raw])
            width = base[-1] + 2 * (conf.window + slack)
            lists = np.sort(term * width + place)  # all lists, one after the other, each sorted by place
            first = np.searchsorted(lists, np.arange(n_terms + 1) * width)
            place = lists - np.repeat(np.arange(n_terms), np.diff(first)) * width

            def in_list(which: np.ndarray, rank: int, start: np.ndarray, give: int) -> np.ndarray:
                """Whether the windows' ``rank``-th rarest term stands where it should, give or take some words."""
                want = start + offsets[which, rank]
                key = terms[which, rank] * width + want
                found = np.searchsorted(lists, key - np.minimum(want, give))
                return (found < len(lists)) & (lists[np.minimum(found, len(lists) - 1)] <= key + give) if len(lists) else np.zeros(len(which), bool)

            window, start = starts(live, 0, first, place)
            window, start = window[start >= 0], start[start >= 0]
            for rank in range(1, conf.window):
                same = in_list(window, rank, start, 0)
                window, start = window[same], start[same]
            row = np.searchsorted(base, start, side="right") - 1

            near = [starts(nearby, rank, first, place) for rank in range(conf.window - conf.near_terms + 1)]
            w, s = (np.concatenate([x[i] for x in near]) for i in (0, 1))
            at = np.maximum(np.searchsorted(base, s, side="right") - 1, 0)
            whole = (s >= 0) & (s + conf.window <= base[at] + n_words[np.minimum(at, n - 1)])
            w, s, at = w[whole], s[whole], at[whole]
            missed = np.zeros(len(w), np.int64)
            for rank in range(conf.window):
                missed += ~in_list(w, rank, s, slack)
                alive = missed <= conf.window - conf.near_terms
                w, s, at, missed = w[alive], s[alive], at[alive], missed[alive]
            close, exact = (np.unique(np.stack(x), axis=1) for x in ((at, w), (row, window)))
            exact = exact[0][size[exact[1]] == conf.window]
            n_near = np.maximum(np.bincount(close[0], minlength=n) - np.bincount(exact, minlength=n), 0)

            spans, items = [], []
            by_row = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[by_row], np.arange(n + 1))
            old_spans, old_items, old_near = (batch.column(x).to_pylist() for x in ("spans", "items", "n_near"))
            for i in range(n):
                mine = by_row[bounds[i] : bounds[i + 1]]
                new = np.stack([start[mine] - base[i], start[mine] - base[i] + size[window[mine]]], axis=1).astype("<i8")
                spans.append(union(np.concatenate([np.frombuffer(old_spans[i], "<i8").reshape(-1, 2), new])).tobytes())
                items.append(sorted({*old_items[i], *windows.items(np.unique(window[mine]))}))
            found = {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_words": batch.column("n_words"), "spans": pa.array(spans, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "n_near": pa.array(n_near + np.array(old_near, np.int64))}
            if "text" in batch.schema.names:
                found["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(found)

    return postings.mapInArrow(run, FOUND + ", text string" * ("text" in postings.columns))


def union(spans: np.ndarray) -> np.ndarray:
    """Sorted spans that do not touch, covering the same words."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(spans[1:, 0] > end[:-1])
    return np.stack([spans[np.concatenate([[0], cut + 1]), 0], end[np.concatenate([cut, [len(spans) - 1]])]], axis=1)


def decontaminate(documents: DataFrame, benchmark: DataFrame, conf: Decontamination = Decontamination()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, n_items, items, spans, n_near, text_hash.

    ``spans`` (array of first word and end) cover the words inside exact occurrences of windows of ``benchmark``
    (item_id, text), ``n_hit`` counts them, ``items`` are the sorted distinct ids of items with occurring windows, and
    ``n_near`` counts windows that only match in proximity. A null or empty text has no words and no hit; an item
    without words has no window; a null item_id counts as the empty string. Repeated rows each get their result.
    """
    bound_batches(documents)
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n_blocks = max(1, -(-int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // conf.block_chars))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"), F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_near"))
    for k in range(n_blocks):
        block = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toArrow().combine_chunks()
        windows = Windows(*(block.column(i).combine_chunks() if block.num_rows else pa.array([], pa.string()) for i in (0, 1)), conf.window)
        del block
        rows = look_up(stash(index(rows, windows.vocabulary, k < n_blocks - 1)), windows, conf)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("spans").to_pylist()]
            pairs = pa.array([[{"start": int(a), "end": int(b)} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            hit = pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_words")), hit, batch.column("items"), pairs, batch.column("n_near"), batch.column("text_hash")], names=["doc_id", "n_words", "n_hit", "items", "spans", "n_near", "text_hash"])

    out = rows.mapInArrow(unpack, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, n_near long, text_hash long")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", "n_near", "text_hash")
