"""Removal of passages that stand in a given reference: suffix automata of reference shards, sent to all tasks in turn.

Every substring of a shard is a path in its automaton, so one pass over a document gives its matching statistics: for
each word the length of the longest match that ends there. Maximal matches of at least ``window`` words are removed.

A reference of R words in shards of ``shard_words`` costs R / shard_words passes over the documents. That suits a list
of boilerplate or blocked passages; where the corpus is its own reference, the passages go through
:func:`framewell.llm.substring_dedup.remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.decontaminate import union
from framewell.llm.shared import bound_batches, stash


@dataclass(frozen=True)
class ReferenceDedup:
    window: int = 35
    shard_words: int = 100_000


class SuffixAutomaton:
    """The automaton of several word sequences; no path leads from one into the next."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of state ``q`` for the shorter substrings that reach it through ``p``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier sequence has this path
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matching_statistics(self, words: list[int]) -> np.ndarray:
        """For each word, how many words of the longest match end with it."""
        out, state, size = np.zeros(len(words), dtype=np.int64), 0, 0
        follow, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in follow[state]:
                state = link[state]
                size = length[state]
            if w in follow[state]:
                state, size = follow[state][w], size + 1
            else:
                state = size = 0
            out[i] = size
        return out


def _hashes(texts: pa.Array) -> Iterator[tuple[int, list[int], bytes]]:
    for block in K.blocks(texts, K.NON_SPACE):
        hashes = block.hashes(fold=False).view(np.int64)
        for i in range(len(block.first) - 1):
            a, b = block.first[i], block.first[i + 1]
            yield block.lo + i, hashes[a:b].tolist(), block.data[block.start[a] : block.end[b - 1]].tobytes() if b > a else b""


def remove_reference(documents: DataFrame, reference: DataFrame, conf: ReferenceDedup = ReferenceDedup()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans (start and end of removed words).

    Words are runs of non-space, unchanged. A null or empty text has no words, and one in ``reference`` (text) matches
    nothing. Repeated rows each get their result. An empty reference removes nothing. A long reference text is cut into pieces
    that overlap by all but one word of a window, so every window lies whole in one and a shard stays near ``shard_words``.
    """
    bound_batches(documents)
    listed = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")
    known = reference.filter("text IS NOT NULL").select(listed).filter(F.size("w") >= conf.window)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - (conf.window - 1)) / conf.shard_words).cast("int") - 1, F.lit(0)))
    known = known.select(F.explode(F.transform(steps, lambda i: F.array_join(F.slice("w", i * conf.shard_words + 1, F.lit(conf.shard_words + conf.window - 1)), " "))).alias("text")).distinct()
    total = int(known.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0)
    shards = max(1, -(-total // conf.shard_words))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(b"").alias("found"))
    for k in range(shards):
        texts = [r.text for r in known.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).orderBy("text").collect()]
        automaton = documents.sparkSession.sparkContext.broadcast(SuffixAutomaton(words for _, words, _ in _hashes(pa.array(texts, pa.string()))))

        def stream(batches: Iterable[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(2).to_pylist()
                for i, words, _ in _hashes(batch.column(1)):
                    size = automaton.value.matching_statistics(words)
                    end = np.flatnonzero(size >= conf.window) + 1
                    if len(end):
                        spans = np.stack([end - size[end - 1], end], axis=1).astype("<i8")
                        found[i] = union(np.concatenate([np.frombuffer(found[i], "<i8").reshape(-1, 2), spans])).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "text", "found"])

        rows = rows.mapInArrow(stream, "doc_id long, text string, found binary")
        if k < shards - 1:
            rows = stash(rows)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, _, raw in _hashes(batch.column(1)):
                words, kept, at = raw.split(), [], 0
                spans = np.frombuffer(batch.column(2)[i].as_py(), "<i8").reshape(-1, 2).tolist()
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")
