"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage_words`` words. Every passage is encoded: numbers about its signs, words and
repetitions, and the mean of learned embeddings of its words, word pairs and character trigrams (hashed to ``buckets``), go
through a hidden layer. Gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages,
and the weighted sum of their codes gives the document's score. Only document labels are used; the attention learns which
passages decide. The model is fitted on a bounded sample of labelled documents and applied to all, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import kernels as K
from framewell.llm.shared import bound_batches, keep_ids

_CLASSES = np.zeros((9, 256), dtype=bool)
for _row, _bytes in enumerate([range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b"!", b"|", b"*#$%&", b".,;:?'\"()-", b"\n", range(0x80, 0x100)]):
    _CLASSES[_row, list(_bytes)] = True
N_FEATURES = 18


@dataclass(frozen=True)
class Quality:
    """``sample``: at most so many labelled documents are used to fit, those with the smallest hash of their id. ``epochs`` fit the
    numbers alone; then all is fitted together, ``joint_epochs`` times and ``joint_steps`` steps at least. ``width`` 0: no embeddings. ``buckets``: 65536 at most."""

    passage_words: int = 64
    sample: int = 2000
    buckets: int = 1 << 14
    width: int = 8
    joint_epochs: int = 6
    joint_steps: int = 240
    hidden: int = 16
    gate: int = 8
    epochs: int = 40
    batch: int = 128
    rate: float = 0.01
    bound: float = 0.3
    seed: int = 7


def passages(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: its first row, the features of all passages, and ``first`` of them by text. A text without words is one blank passage."""
    for block in K.blocks(column, K.NON_SPACE):
        counts = block.counts()
        each = np.maximum(-(-counts // size), 1)
        first = np.concatenate([[0], np.cumsum(each)])
        x = np.zeros((first[-1], N_FEATURES))
        doc = np.repeat(np.arange(len(counts)), each)
        begin = block.first[doc] + (np.arange(first[-1]) - first[doc]) * size
        end = np.minimum(begin + size, block.first[doc + 1])
        full = np.flatnonzero(end > begin)
        if len(full):
            begin, end = begin[full], end[full]
            n = end - begin
            lo, hi = block.start[begin], block.end[end - 1]
            n_bytes = (hi - lo).astype(float)
            for k, members in enumerate(_CLASSES):
                sums = np.concatenate([[0], np.cumsum(members[block.data], dtype=np.int64)])
                x[full, k] = (sums[hi] - sums[lo]) / n_bytes
            x[full, 9] = x[full, 0] / (x[full, 0] + x[full, 1] + 1e-3)
            length = (block.end - block.start).astype(float)
            sums = lambda v: np.add.reduceat(v, begin) if len(v) else np.zeros(0)
            x[full, 10] = sums(length) / n / 10
            x[full, 11] = sums((length <= 3).astype(float)) / n
            x[full, 12] = sums((length >= 16).astype(float)) / n
            last = block.data[block.end - 1]
            x[full, 13] = sums(_CLASSES[5][last].astype(float)) / n
            hashes = block.hashes(fold=True)
            twice = np.zeros(len(hashes))
            twice[1:] = hashes[1:] == hashes[:-1]
            x[full, 14] = sums(twice) / n
            low = hashes >> K.U64(24)
            for k, group in ((15, np.repeat(np.arange(len(full)), n)), (16, np.repeat(np.arange(len(counts)), counts))):
                key = np.sort((group.astype(K.U64) << K.U64(40)) | low)
                own = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> K.U64(40)).astype(np.int64), minlength=group[-1] + 1)
                x[full, k] = own / n if k == 15 else (own / np.maximum(counts[: len(own)], 1))[doc[full]]
            x[full, 17] = np.log1p(n) / 4
        yield block.lo, x, first


@dataclass
class Grams:
    """Grams of a block's words. ``word``: bucket of each distinct word; ``code``: which one stands at each place; ``char`` and
    ``char_first``: buckets of the distinct words' trigrams; ``pair``: bucket of each word with the next; ``passage``: of each word."""

    word: np.ndarray
    code: np.ndarray
    char: np.ndarray
    char_first: np.ndarray
    pair: np.ndarray
    passage: np.ndarray
    n: np.ndarray

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Per passage the mean over its words of the embeddings of word, trigrams (their mean) and pair; 0 without words."""
        out = np.zeros((len(self.n), table.shape[1]))
        if len(self.code):
            sizes = np.diff(self.char_first)
            own = table[self.word] + np.add.reduceat(table[self.char], self.char_first[:-1], axis=0) / sizes[:, None]
            each = own[self.code]
            inner = np.flatnonzero(self.passage[1:] == self.passage[:-1])
            each[inner] += table[self.pair[inner]]
            begin = np.flatnonzero(np.append(True, self.passage[1:] != self.passage[:-1]))
            at = self.passage[begin]
            out[at] = np.add.reduceat(each, begin, axis=0) / self.n[at, None]
        return out

    def sparse(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same means as weights: (passage, bucket, weight), each pair once."""
        sizes = np.diff(self.char_first)[self.code]
        ends = np.cumsum(sizes)
        chars = self.char[np.repeat(self.char_first[:-1][self.code] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        inner = np.flatnonzero(self.passage[1:] == self.passage[:-1])
        passage = np.concatenate([self.passage, np.repeat(self.passage, sizes), self.passage[inner]])
        weight = np.concatenate([np.ones(len(self.code)), np.repeat(1 / np.maximum(sizes, 1), sizes), np.ones(len(inner))]) / self.n[passage]
        key, at = np.unique(passage * buckets + np.concatenate([self.word[self.code], chars, self.pair[inner]]), return_inverse=True)
        return key // buckets, key % buckets, np.bincount(at, weight, len(key))


def grams(block: K.Words, first: np.ndarray, size: int, buckets: int) -> Grams:
    """The grams of a block whose passages :func:`passages` has numbered ``first``."""
    counts = block.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    passage = first[doc] + (np.arange(len(doc)) - block.first[doc]) // size
    hashes = block.hashes(fold=True)
    code, distinct = pd.factorize(hashes)
    place = np.zeros(len(distinct), np.int64)
    place[code[::-1]] = np.arange(len(code))[::-1]
    start, long = block.start[place], (block.end - block.start)[place]
    char_first = np.concatenate([[0], np.cumsum(long)])
    of = np.repeat(np.arange(len(distinct)), long)
    at = np.arange(char_first[-1]) - char_first[of] - 1  # a trigram starts one byte before the word, where a mark stands
    data = np.concatenate([[0], K.FOLD[block.data], [0, 0]]).astype(K.U64)
    here = start[of] + at + 1
    a, b, c = np.where(at < 0, K.U64(1), data[here]), data[here + 1], np.where(at == long[of] - 2, K.U64(2), data[here + 2])
    bucket = lambda x: (x >> K.U64(40)).astype(np.int64) % buckets
    pair = bucket(K.rolling(np.append(hashes, K.U64(0)), 2)) if len(hashes) else np.zeros(0, np.int64)
    return Grams(bucket(distinct), code, bucket(K.mix((a << K.U64(16) | b << K.U64(8) | c) * K.U64(0x9E3779B97F4A7C15))), char_first, pair, passage, np.maximum(np.bincount(passage, minlength=first[-1]), 1))


def encoded(column: pa.Array, conf: Quality) -> Iterator[tuple[int, np.ndarray, np.ndarray, Grams | None]]:
    """:func:`passages` with the grams of each block, if the model has embeddings."""
    for (lo, x, first), block in zip(passages(column, conf.passage_words), K.blocks(column, K.NON_SPACE), strict=True):
        yield lo, x, first, grams(block, first, conf.passage_words, conf.buckets) if conf.width else None


@dataclass
class Model:
    """Parameters by name; see the module's text. ``E`` holds the embeddings, if there are any."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray, vectors: np.ndarray | None = None) -> dict[str, np.ndarray]:
        p, at = self.p, first[:-1]
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        if "E" in p:
            z = np.concatenate([z, np.zeros((len(x), p["E"].shape[1])) if vectors is None else vectors], axis=1)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        doc = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        bag = np.add.reduceat(a[:, None] * h, at, axis=0)
        score = 1 / (1 + np.exp(-(bag @ p["c"] + p["d"])))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "doc": doc, "bag": bag, "score": score}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """``entries``: (passage, bucket, weight) of the grams, by passage; without them the embeddings stay out."""
        p = self.p
        f = self.forward(x, first, None if entries is None else mixed(p["E"], entries, len(x)))
        at, doc, a, h, t, s = first[:-1], f["doc"], f["a"], f["h"], f["t"], f["s"]
        error = (f["score"] - y) / len(y)
        to_bag = error[:, None] * p["c"][None, :]
        to_a = (h * to_bag[doc]).sum(axis=1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, at)[doc])
        to_t, to_s = to_e[:, None] * p["w"] * s * (1 - t * t), to_e[:, None] * p["w"] * t * s * (1 - s)
        to_h = a[:, None] * to_bag[doc] + to_t @ p["V"].T + to_s @ p["U"].T
        to_z = to_h * (1 - h * h)
        out = {"W": f["z"].T @ to_z, "b": to_z.sum(0), "V": h.T @ to_t, "U": h.T @ to_s, "w": (t * s).T @ to_e, "c": f["bag"].T @ error, "d": error.sum(keepdims=True)}
        if entries is not None:
            passage, bucket, weight = entries
            to_v = to_z @ p["W"][N_FEATURES:].T
            out["E"] = np.stack([np.bincount(bucket, weight * column[passage], len(p["E"])) for column in to_v.T], axis=1)
        return out


def mixed(table: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Weighted sums of embeddings for ``n`` passages."""
    passage, bucket, weight = entries
    return np.stack([np.bincount(passage, weight * column[bucket], n) for column in table.T], axis=1)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, conf: Quality, entries: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Model:
    """Adam on the log loss with a little weight decay; the same rows give the same model.

    ``entries``: the grams of all passages, as (passage, bucket, weight) by passage. First the numbers are fitted alone, then
    the embeddings with them, so that words decide what the numbers leave open."""
    rng = np.random.default_rng(conf.seed)
    shape = {"W": (N_FEATURES, conf.hidden), "b": (conf.hidden,), "V": (conf.hidden, conf.gate), "U": (conf.hidden, conf.gate), "w": (conf.gate,), "c": (conf.hidden,), "d": (1,)}
    p = {k: rng.normal(0, 0.3, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    model = Model(x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), x.std(axis=0) + 1e-3 if len(x) else np.ones(N_FEATURES), p)
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    p["d"][:] = np.log(share / (1 - share))
    _descend(model, x, first, y, conf, conf.epochs, rng, None)
    if entries is not None and conf.width:
        p["E"] = rng.normal(0, 0.3, (conf.buckets, conf.width))
        p["W"] = np.concatenate([p["W"], rng.normal(0, 0.3, (conf.width, conf.hidden))])
        batches = max(1, len(y) // conf.batch)
        _descend(model, x, first, y, conf, max(conf.joint_epochs, -(-conf.joint_steps // batches)), rng, entries)
    return model


def _parts(first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts ``first[i]:first[i+1]`` of ``some`` stand, one after the other, and where each begins among them."""
    n = first[some + 1] - first[some]
    part = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[some] - part[:-1], n) + np.arange(part[-1]), part


def _descend(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, conf: Quality, epochs: int, rng: np.random.Generator, entries: tuple | None) -> None:
    p = model.p
    m, v, step = {k: np.zeros(w.shape) for k, w in p.items()}, {k: np.zeros(w.shape) for k, w in p.items()}, 0
    at = np.searchsorted(entries[0], np.arange(len(x) + 1)) if entries is not None else None
    for epoch in range(epochs):
        rate = conf.rate * (1 - epoch / epochs)
        for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // conf.batch)):
            rows, part = _parts(first, docs)
            own = None
            if entries is not None:
                which, begin = _parts(at, rows)
                own = (np.repeat(np.arange(len(rows)), np.diff(begin)), entries[1][which], entries[2][which])
            step += 1
            for k, g in model.gradient(x[rows], part, y[docs], own).items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: a fifth by a checksum of the id, and those without one."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def learn(documents: DataFrame, labels: DataFrame, conf: Quality) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out. Their passages' numbers and gram counts come to the
    driver, not their texts."""
    bound_batches(documents)
    marked = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.sample)
    named = {r.doc_id: r.quality for r in chosen.collect()}
    spark = documents.sparkSession
    ids = spark.createDataFrame([(i,) for i in named], "doc_id long")
    rows = keep_ids(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, ["doc_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, first, found in encoded(batch.column(1), conf):
                parts = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                told = [(b"", b"", b"")] * len(parts)
                if found is not None:
                    passage, bucket, weight = found.sparse(conf.buckets)
                    n = np.bincount(passage, minlength=first[-1])
                    at = np.concatenate([[0], np.cumsum(n)])
                    told = [(n[a:b].astype("<u4").tobytes(), bucket[at[a] : at[b]].astype("<u2").tobytes(), weight[at[a] : at[b]].astype("<f2").tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [pa.array(c, pa.binary()) for c in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(parts)), pa.array(parts, pa.binary()), *columns], names=["doc_id", "x", "n", "bucket", "weight"])

    found = rows.mapInArrow(run, "doc_id long, x binary, n binary, bucket binary, weight binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(np.float64) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    entries = None
    if conf.width and found:
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in found), kind)
        entries = (np.repeat(np.arange(first[-1], dtype=np.int32), join("n", "<u4")), join("bucket", "<u2"), join("weight", "<f2"))
    return fit(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), first, np.array([named[r.doc_id] for r in found]), conf, entries)


def score(documents: DataFrame, labels: DataFrame, conf: Quality = Quality()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): its columns but the text, held_out, score, predicted (1 from ``bound`` on), n_passages, attention.

    ``attention`` is the largest weight of a passage. A null or empty text is one blank passage and gets a score like any
    other. Without labels the score is that of an untrained model. Repeated rows each get their result; a row without a
    doc_id is held out. Columns of ``documents`` that are named like an added one are left out.
    """
    found = apply(documents, learn(documents, labels, conf), conf)
    added = [x for x in found.columns if x != "row"]
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in ("text", *added)], *added)


def apply(documents: DataFrame, model: Model, conf: Quality = Quality()) -> DataFrame:
    """``row``, a struct of all columns of ``documents`` whatever their names, and the columns that :func:`score` adds."""
    added = "held_out boolean, score double, predicted int, n_passages long, attention double"
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, first, told in encoded(batch.column(1), conf):
                vectors = told.vectors(model.p["E"]) if told is not None and "E" in model.p else None
                f, own = model.forward(x, first, vectors), batch.slice(lo, len(first) - 1)
                new = [pa.array(f["score"]), pa.array((f["score"] >= conf.bound).astype(np.int32)), pa.array(np.diff(first)), pa.array(np.maximum.reduceat(f["a"], first[:-1]))]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *new], names=["row", *(x.split()[0] for x in added.split(", "))])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL(added).fields]))
