"""The trie against a counter, and collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from framewell.llm import collocations as C
from framewell.llm.hat_trie import HatTrie, Node, items, packed

SCHEMA = "doc_id long, text string, lang string, word string, n string, key string"


@pytest.mark.parametrize(("width", "heads"), [(1, 10**6), (2, 3), (2, 10**6), (3, 1), (4, 2)])
def test_trie_counts_bursts_and_spills(width: int, heads: int) -> None:
    rng = np.random.default_rng(width)
    trie, want, runs, burst = HatTrie(width, burst=16, limit=800), Counter(), [], False
    top = np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)
    for _ in range(60):
        rows = rng.integers(0, 30, (100, width)).astype(np.uint64)
        rows[:, 0] = rng.integers(0, heads, 100) if heads > 3 else top[rng.integers(0, heads, 100)]
        rows, counts = np.unique(rows, axis=0, return_counts=True)
        trie.add(rows, counts)
        want.update(dict(zip(packed(rows), counts.tolist(), strict=True)))
        assert trie.size == sum(1 for _ in items(trie.root))
        burst |= any(isinstance(p, Node) for p in trie.root.parts)
        if trie.size > trie.limit:
            runs += trie.spill(400)
            assert trie.size <= 400
    assert burst == (width > 1 and heads <= 3), "frequent prefixes burst into nodes, and only these"
    runs += trie.spill(0)
    got = Counter()
    for run in runs:
        assert run == sorted(run)
        got.update(dict(run))
    assert got == want and trie.size == 0


def plain(rows: list, conf: C.Collocations) -> list[tuple]:
    counts, total, out = defaultdict(Counter), Counter(), []
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, conf.longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found, most = [], Counter()
        for p, a in f.items():
            if a >= conf.least and len(p) > 2:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        most[p[i : i + k]] = max(most[p[i : i + k]], a)
        for p, a in f.items():
            if len(p) > 1 and a >= conf.least and not (most[p] and 100 * most[p] >= conf.share * a):
                score, _, left, right = min((conf.scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[: conf.top], 1)]
    return sorted(out)


def made(rng: random.Random, n: int) -> list[tuple]:
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Ab", "aB", "naïve", "x" * 90, "\x00"]
    text = lambda: "".join(rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b"]) + w for w in rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60)))
    return [(i, rng.choice([None, "", text(), text() + " new york city hall" * rng.randint(0, 3)]), rng.choice(["en", "de", None, "und"]), "w", "n", "k") for i in range(n)]


@pytest.mark.parametrize("conf", [C.Collocations(least=3, top=40, held=60, filter_bits=1 << 16), C.Collocations(least=2, longest=2), C.Collocations(least=2, longest=3, share=50)])
def test_equals_a_plain_count(spark, conf: C.Collocations) -> None:
    rows = made(random.Random(4), 120)
    rows += [rows[-1]] * 30 + [(999, "red green " * 3000, "fr", None, None, None)]
    found = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), conf)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, conf)


def test_empty_table(spark) -> None:
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_of_one_id_start_again(spark, monkeypatch) -> None:
    """All words of the first seed get one id; the result is right all the same."""
    rows = made(random.Random(9), 40)
    conf = C.Collocations(least=2)
    tried = []
    count = C.count_words

    def counted(texts, conf, seed):  # noqa: ANN001, ANN202
        tried.append(seed)
        if seed:
            return count(texts, conf, seed)
        return count(texts, conf, seed).withColumn("key", C.F.substring("key", 1, 0))

    monkeypatch.setattr(C, "count_words", counted)
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA), conf).collect())) == plain(rows, conf)
    assert tried == [0, 1]
