"""Collocations: phrases of two words or more that stand together more often than apart, counted exactly.

Three passes over the texts count words, then pairs of frequent words, then longer phrases whose pairs are all frequent. A
phrase can't be more frequent than any part of it, so this leaves out no candidate. Each task counts in a trie of hash
containers (:mod:`framewell.llm.hat_trie`) and spills whole subtrees as sorted runs; the runs are packed, dealt out by prefix
(the first word and a part of the second, so a frequent first word spreads) and merged there. Which words and pairs are
frequent reaches the tasks as a bit filter of at most ``filter_bits``: it lets through all frequent ones and some others,
whose counts then show what they are. If the corpus outgrows the filter, more is counted and the result is the same.

A word of a language is known by a 64-bit id. Two words of one id are noticed, and the passes start again with other ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm import kernels as K
from framewell.llm.hat_trie import HatTrie, packed
from framewell.llm.shared import BATCH_ROWS, small_batches, small_join, stash

SPACE = {0x20, 0x09}
BREAK = {*b".,;:!?", *range(0x0A, 0x0E)}
_WORD = np.ones(256, dtype=bool)
_WORD[sorted(SPACE | BREAK)] = False
_BREAK = np.zeros(256, dtype=bool)
_BREAK[sorted(BREAK)] = True


@dataclass(frozen=True)
class Collocations:
    """Candidates: phrases of two to ``longest`` words that occur ``least`` times or more. One is dropped if a longer one that
    holds it has ``share`` percent of its occurrences or more. ``top`` phrases a language are reported.

    ``held``: phrases that a task's trie holds before it spills. ``per_prefix``: words of the corpus for each prefix partition."""

    least: int = 30
    longest: int = 4
    share: int = 80
    top: int = 2000
    scale: int = 2_000_000
    filter_bits: int = 1 << 27
    held: int = 500_000
    per_prefix: int = 100_000


def letters(seed: int) -> np.ndarray:
    """Lower-cases A-Z and, for ``seed`` > 0, exchanges bytes, so that other words share an id."""
    return K.FOLD if not seed else np.random.default_rng(seed).permutation(256).astype(np.uint8)[K.FOLD]


class Texts:
    """The words of a block: ``ids`` (unlike for other languages), ``piece`` (grows from piece to piece), and their bytes."""

    def __init__(self, block: K.Words, langs: list[str], salt: dict[str, np.uint64], seed: int):
        self.block, self.langs = block, langs
        text = np.repeat(np.arange(len(langs)), block.counts())
        changed = K.Words(letters(seed)[block.data], block.start, block.end, block.first, block.lo)
        self.ids = K.mix(changed.hashes(fold=False) ^ np.array([salt[x] for x in langs], dtype=np.uint64)[text])
        breaks = np.cumsum(_BREAK[block.data])[block.start]
        self.piece = breaks + np.arange(len(langs) + 1)[text] * (1 + (breaks[-1] if len(breaks) else 0))
        self.text = text

    def phrases(self, width: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of ``width`` words within a piece, of those that start at a ``good`` place, sorted, and their counts."""
        at = np.flatnonzero(good[: len(self.ids) - width + 1])
        at = at[self.piece[at] == self.piece[at + width - 1]]
        rows = np.stack([self.ids[at + i] for i in range(width)], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
        return rows[first], np.diff(np.append(first, len(rows)))


def blocks(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[Texts]:
    salt: dict[str, np.uint64] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in {*langs} - salt.keys():
            salt[lang] = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()))
        for block in K.blocks(batch.column(0), _WORD):
            yield Texts(block, langs[block.lo : block.lo + len(block.first) - 1], salt, seed)


def pair_keys(rows: np.ndarray) -> np.ndarray:
    """One number for each row of one or two ids."""
    return rows[:, 0] if rows.shape[1] == 1 else K.mix(rows[:, 0] * K.U64(0x9E3779B97F4A7C15) ^ K.mix(rows[:, 1]))


def slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places of a filter of ``bits`` (a power of two) for each key."""
    for c in K.constants(3, 0xB1):
        yield K.mix(keys * c) & K.U64(bits - 1)


class Filter:
    """A bit filter of the keys of a table: fixed in size, so it may be sent to all tasks. It never misses one."""

    def __init__(self, table: DataFrame, conf: Collocations):
        spark, size = table.sparkSession, table.count()
        self.bits = bits = min(conf.filter_bits, max(1 << 16, 1 << (16 * size).bit_length()))

        def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(0).to_pylist()
                if raw:
                    keys = pair_keys(np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1))
                    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.unique(np.concatenate(list(slots(keys, bits)))).astype(np.int64))})

        def part(group: pa.Table) -> pa.Table:
            at = group.column("slot").to_numpy() & 0xFFFF
            out = np.zeros(1 << 16, dtype=bool)
            out[at] = True
            return pa.table({"part": group.column("part")[:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

        found = table.select("key").mapInArrow(places, "slot long").distinct().withColumn("part", F.expr("slot >> 16"))
        whole = bytearray(bits // 8)
        for row in found.groupBy("part").applyInArrow(part, "part long, bits binary").collect():  # bits / 8 bytes in all
            whole[row.part << 13 : (row.part + 1) << 13] = row.bits
        self.sent = spark.sparkContext.broadcast(bytes(whole))

    def has(self, rows: np.ndarray) -> np.ndarray:
        held, keys = np.frombuffer(self.sent.value, np.uint8), pair_keys(rows)
        out = np.ones(len(keys), dtype=bool)
        for at in slots(keys, self.bits):
            out &= (held[at >> K.U64(3)] >> (at & K.U64(7)).astype(np.uint8) & 1).astype(bool)
        return out


class Run:
    """Sorted distinct phrases (rows of ids) and their counts, packed column by column; ids of one place are told as differences."""

    @staticmethod
    def pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
        columns = [np.diff(c, prepend=c.dtype.type(0)) if i == 0 else c for i, c in enumerate(rows.T)]
        return b"".join(np.ascontiguousarray(c, "<u8").tobytes() for c in columns) + counts.astype("<u8").tobytes()

    @staticmethod
    def unpack(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.frombuffer(raw, "<u8").reshape(width + 1, -1).astype(np.uint64)
        columns[0] = np.cumsum(columns[0], dtype=np.uint64)
        return columns[:-1].T, columns[-1].astype(np.int64)

    @staticmethod
    def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.lexsort(rows.T[::-1])
        rows, counts = rows[order], counts[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        return rows[first], np.add.reduceat(counts, first)


#: Phrases that a prefix partition may take in before they are merged.
PENDING = 1 << 20


def prefixes(rows: np.ndarray, bits: int) -> np.ndarray:
    """The prefix partition of each phrase: by its first word, and within it by the second, so that a frequent word spreads."""
    second = bits // 2
    return ((rows[:, 0] >> K.U64(64 - bits + second)) << K.U64(second) | rows[:, 1] >> K.U64(64 - second)).astype(np.int64)


def merged(runs: DataFrame, bits: int, least: int) -> DataFrame:
    """(key, n) of the phrases in packed sorted runs (prefix, width, run) of all tasks that occur ``least`` times or more.

    A task streams through its prefix partitions and holds the distinct phrases of one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pending = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows, counts = Run.merge(held)
                rows, counts = rows[counts >= least], counts[counts >= least]
                if len(rows):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(packed(rows), pa.binary()), "n": pa.array(counts)})

        for batch in batches:
            for prefix, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (prefix, width):
                    yield from done()
                    at, held, pending = (prefix, width), [], 0
                held.append(Run.unpack(raw, width))
                pending += len(held[-1][1])
                if pending > PENDING and len(held) > 1:
                    held, pending = [Run.merge(held)], 0
        yield from done()

    order = ["width", "prefix"]
    return runs.repartition(*order).sortWithinPartitions(*order).select("prefix", "width", "run").mapInArrow(run, "key binary, n long")


def count_words(texts: DataFrame, conf: Collocations, seed: int) -> DataFrame:
    """(key, lang, word, n) of all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names = HatTrie(1, limit=conf.held), {}

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            for items in trie.spill(keep):
                known = [names.pop(k) for k, _ in items]
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in items], pa.binary()), "lang": pa.array([x[0] for x in known], pa.string()), "word": pa.array([x[1] for x in known], pa.string()), "n": pa.array([n for _, n in items], pa.int64())})

        for some in blocks(batches, seed):
            if len(some.ids):
                distinct, at, counts = np.unique(some.ids, return_index=True, return_counts=True)
                trie.add(distinct[:, None], counts)
                raw = K.FOLD[some.block.data].tobytes()
                for key, i in zip(packed(distinct[:, None]), at.tolist(), strict=True):
                    if key not in names:
                        names[key] = (some.langs[some.text[i]], raw[some.block.start[i] : some.block.end[i]].decode())
                if trie.size > trie.limit:
                    yield from spilled(trie.limit // 2)
        yield from spilled(0)

    found = texts.mapInArrow(run, "key binary, lang string, word string, n long")
    return found.repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def count_phrases(texts: DataFrame, widths: range, conf: Collocations, seed: int, good: Callable[[Texts, int], np.ndarray], total: int) -> DataFrame:
    """(key, n) of phrases of ``widths`` words that start at places where ``good`` holds, if they are frequent. The number of prefix
    partitions follows ``total``, the words of the corpus."""
    bits = min(40, max(4, (total // conf.per_prefix).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [HatTrie(width, limit=conf.held) for width in widths]

        def spilled(trie: HatTrie, keep: int) -> Iterator[pa.RecordBatch]:
            """Subtrees as runs, each cut by prefix partition; small ones that follow each other go into one batch."""
            for items in joined(trie.spill(keep)):
                rows = np.frombuffer(b"".join(k for k, _ in items), ">u8").astype(np.uint64).reshape(-1, trie.width)
                counts = np.fromiter((n for _, n in items), np.int64, len(items))
                prefix = prefixes(rows, bits)
                order = np.argsort(prefix, kind="stable")
                rows, counts, prefix = rows[order], counts[order], prefix[order]
                edges = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(rows)]
                batch = [(int(prefix[a]), trie.width, Run.pack(rows[a:b], counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["prefix", "width", "run"])

        for some in blocks(batches, seed):
            for trie in tries:
                if len(some.ids) >= trie.width:
                    trie.add(*some.phrases(trie.width, good(some, trie.width)))
                    if trie.size > trie.limit:
                        yield from spilled(trie, trie.limit // 4)
        for trie in tries:
            yield from spilled(trie, 0)

    return merged(texts.mapInArrow(run, "prefix long, width int, run binary"), bits, conf.least)


def joined(runs: Iterator[list[tuple[bytes, int]]], most: int = 1 << 17) -> Iterator[list[tuple[bytes, int]]]:
    """Sorted runs of subtrees put together, so that each prefix partition gets few and long parts."""
    held: list[tuple[bytes, int]] = []
    for run in runs:
        held += run
        if len(held) >= most:
            held.sort()
            yield held
            held = []
    if held:
        held.sort()
        yield held


def frequent_pairs(words: Filter) -> Callable[[Texts, int], np.ndarray]:
    def good(some: Texts, width: int) -> np.ndarray:
        known = words.has(some.ids[:, None])
        return known[:-1] & known[1:]

    return good


def of_pairs(pairs: Filter) -> Callable[[Texts, int], np.ndarray]:
    """Places from which on all pairs of a phrase are frequent."""

    def good(some: Texts, width: int) -> np.ndarray:
        known = np.append(pairs.has(np.stack([some.ids[:-1], some.ids[1:]], axis=1)), False)
        out = known.copy()
        for i in range(1, width - 1):
            out[:-i] &= known[i:]
        return out

    return good


def part(first: int | Column, size: int | Column) -> Column:
    """Words ``first`` to ``first + size - 1`` of a key, from 0."""
    return F.col("key").substr(F.lit(8) * first + 1, F.lit(8) * size)


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(documents: DataFrame, conf: Collocations | None = None) -> DataFrame:
    """Per language the ``top`` phrases of ``documents`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``. ``a`` is the number of
    occurrences of the phrase, ``l`` and ``r`` those of its two parts at the cut whose ``score``, floor(scale * a / (l + r)), is
    lowest (ties: the first), ``n`` the words of the language. Phrases are ranked by score, then ``a``, both falling, then by
    their bytes. A null language is ``und``; null and empty texts have no words; repeated rows count each; other columns may
    have any names; an empty table, and a language without a candidate, give no row.
    """
    conf = conf or Collocations()
    texts = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seed = -1
    with small_batches(documents.sparkSession, BATCH_ROWS):
        while True:
            seed += 1
            words = stash(count_words(texts, conf, seed))
            if words.groupBy("key").count().filter("count > 1").isEmpty():
                break
        total = words.groupBy("lang").agg(F.sum("n").alias("n"))
        size = total.agg(F.sum("n")).first()[0] or 0
        words = stash(words.filter(F.col("n") >= conf.least))
        phrases = pairs = stash(count_phrases(texts, range(2, 3), conf, seed, frequent_pairs(Filter(words.select("key"), conf)), size))
        if conf.longest > 2:
            longer = stash(count_phrases(texts, range(3, conf.longest + 1), conf, seed, of_pairs(Filter(pairs.select("key"), conf)), size))
            phrases = pairs.unionByName(longer)
    return ranked(words, total, phrases, conf)


def ranked(words: DataFrame, total: DataFrame, phrases: DataFrame, conf: Collocations) -> DataFrame:
    """The report from counts of frequent words and phrases."""
    size = (F.length("key") / 8).cast("int")
    known = words.select("key", "n").unionByName(phrases)
    cuts = phrases.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("key", "a", "cut", part(0, F.col("cut")).alias("head"), part(F.col("cut"), size - F.col("cut")).alias("tail"))
    cuts = cuts.join(known.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(known.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
    score = F.expr(f"(cast(a as decimal(20,0)) * {conf.scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.select("key", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("at")).groupBy("key", "a").agg(F.min("at").alias("at"))
    inside = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for k in range(2, conf.longest) for i in range(conf.longest - k + 1)]
    if inside:
        held = phrases.filter(size > 2).select("key", "n", F.explode(F.array(*inside)).alias("x")).filter((F.col("x.k") < size) & (F.col("x.i") + F.col("x.k") <= size))
        held = held.select(part(F.col("x.i"), F.col("x.k")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("most"))
        best = best.join(held, "key", "left").filter(F.col("most").isNull() | (100 * exact("most") < conf.share * exact("a"))).drop("most")
    spelled = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: part(i, 1))).alias("i", "one"))
    spelled = spelled.join(words.select(F.col("key").alias("one"), "lang", "word"), "one").groupBy("key", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ").alias("phrase"))
    found = best.join(spelled, "key").select("lang", "phrase", "a", "at.l", "at.r", "at.score", F.pmod(F.xxhash64("key"), F.lit(64)).alias("lot"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for groups in (("lang", "lot"), ("lang",)):  # the last window sees at most 64 * top rows
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).filter(F.col("rank") <= conf.top)
    return small_join(found, total, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
