"""Embeddings of the quality classifier: the same means in both forms, gradients, and what only words can tell."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from framewell.llm import kernels as K
from framewell.llm import quality as Q

TEXTS = ["", "a", "one two  one Two tree", None, "é😀 x" * 3, " ".join(f"w{i % 9}" for i in range(200)), "word"]


def plain(text: str | None, table: np.ndarray, conf: Q.Quality) -> np.ndarray:
    """The vectors of one text's passages, a word at a time."""
    bucket = lambda h: int(h >> 40) % conf.buckets
    words = [w for w in (text or "").encode().translate(bytes(K.FOLD)).split()]
    hashes = [int(next(K.blocks(pa.array([w.decode()]), K.NON_SPACE)).hashes(True)[0]) for w in words]
    out = []
    for at in range(0, max(len(words), 1), conf.passage_words):
        total, n = np.zeros(table.shape[1]), len(words[at : at + conf.passage_words])
        for i in range(at, at + n):
            total += table[bucket(hashes[i])]
            marked = b"\x01" + words[i] + b"\x02"
            keys = np.array([int.from_bytes(marked[j : j + 3]) for j in range(len(words[i]))], K.U64)
            total += table[(K.mix(keys * K.U64(0x9E3779B97F4A7C15)) >> K.U64(40)).astype(np.int64) % conf.buckets].mean(axis=0)
            if i + 1 < at + n:
                total += table[bucket(int(K.rolling(np.array(hashes[i : i + 2], K.U64), 2)[0]))]
        out.append(total / max(n, 1))
    return np.array(out)


def test_means_of_grams() -> None:
    conf = Q.Quality(passage_words=16, buckets=512)
    table = np.random.default_rng(0).normal(size=(512, 8))
    want = np.concatenate([plain(t, table, conf) for t in TEXTS])
    (_, x, first, found), = Q.encoded(pa.array(TEXTS), conf)
    assert np.allclose(found.vectors(table), want) and len(x) == first[-1] == len(want)
    assert np.allclose(Q.mixed(table, found.sparse(512), len(x)), want)


def test_gradient_of_the_embeddings() -> None:
    conf = Q.Quality(passage_words=4, buckets=32, width=3, hidden=4, gate=2, epochs=1, joint_epochs=1, joint_steps=1)
    (_, x, first, found), = Q.encoded(pa.array(["a b c d e f", "b c", "x y z x y z x y"]), conf)
    y, entries = np.array([1.0, 0.0, 1.0]), found.sparse(32)
    model = Q.fit(x, first, y, conf, entries)

    def loss() -> float:
        s = model.forward(x, first, found.vectors(model.p["E"]))["score"]
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    for name, g in model.gradient(x, first, y, entries).items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 40)]:
            own = model.p[name]
            kept, own[at] = own[at], own[at] + 1e-6
            up = loss()
            own[at] = kept - 1e-6
            low = loss()
            own[at] = kept
            assert abs((up - low) / 2e-6 - g[at]) < 1e-6, (name, at)


def auc(score: list, label: list) -> float:
    good = [s for s, y in zip(score, label, strict=True) if y]
    bad = [s for s, y in zip(score, label, strict=True) if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_words_decide_where_shapes_are_alike(spark) -> None:
    """Good and bad texts have words of one length and shape; only which words they are tells them apart."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, good, bad = ([word() for _ in range(n)] for n in (300, 25, 25))
    rows, labels = [], []
    for i in range(900):
        mine = rng.choices(common, k=120)
        for _ in range(6):
            mine[rng.randrange(120)] = rng.choice(good if i % 2 else bad)
        rows.append((i, " ".join(mine)))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {}
    for width in (0, 8):
        got = [r for r in Q.score(docs, marks, Q.Quality(width=width)).collect() if r.held_out]
        found[width] = auc([r.score for r in got], [r.doc_id % 2 for r in got])
    assert found[0] < 0.7 and found[8] > 0.95, found
