"""Periodic runs against a plain search over all lags and starts."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

from framewell.llm.periodic_runs import Runs, find_runs, periodic_runs, planted, seeds, same_from
import numpy as np

SCHEMA = "doc_id long, text string, runs string, number string"


def plain(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: maximal stretches at each lag that have no smaller period."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in out.items())


def collapsed(words: list, runs: list) -> list:
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng: random.Random) -> list[str]:
    """Periodic parts of many lags, some with faults or within others, between other words."""
    out: list[str] = []
    for _ in range(rng.randint(1, 6)):
        part = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 24]))]
        if rng.random() < 0.3:
            part = part[:2] * 4 + part
        part = (part * rng.randint(1, 7))[: rng.randint(1, 120)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "x"
        out += part
    return out


def test_all_runs_of_random_texts(spark) -> None:
    rng = random.Random(11)
    texts = [random_words(rng) for _ in range(600)] + [["a"] * 700, list("ab") * 300, (list("aab") * 5 + list("c")) * 20]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    number: dict[str, int] = {}
    found = find_runs(np.array([number.setdefault(w, len(number)) for t in texts for w in t]), first, Runs())
    assert [found.get(i, []) for i in range(len(texts))] == [plain(t) for t in texts]
    assert sum(map(len, found.values())) > 500
    seeded = [len(at) for at, _ in seeds(np.zeros(700, np.int64), np.array([0, 700]), Runs())]
    assert max(seeded) < 700, "neighbouring occurrences only, not all pairs"


def test_same_from() -> None:
    a = np.arange(500)
    for at in (0, 1, 31, 32, 33, 95, 96, 499):
        assert same_from(a, np.where(a == at, -1, a)) == at
    assert same_from(a, a) == 500 and same_from(a[:0], a[:0]) == 0


def test_rows_and_edges(spark) -> None:
    """Nulls, empty and very long texts, repeated rows, ties and clashing columns."""
    rng = random.Random(5)
    texts = [None, "", " \n\x0b", "a a a a a", "a a a a a a", "x            ", "a a a a a a b b b b b b", *(" ".join(random_words(rng)) for _ in range(40)), " ".join(f"w{i % 5000}" for i in range(40_000))]
    rows = [(i, t, "r", "n") for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[4], None, None)]
    found = periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 1
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        runs, r = plain(words) if i + 1 < len(texts) else [(0, 40_000, 5000)], by_id[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.n_runs, [tuple(x) for x in r.runs]) == (len(runs), runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        left = b" ".join(collapsed(words, runs))
        assert r.collapsed == left.decode() and r.collapsed_sha256 == hashlib.sha256(left).hexdigest()
    assert (by_id[6].start, by_id[6].length) == (0, 6), "ties go to the smallest start"
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_planted_periods() -> None:
    assert planted([], 0) == [] and planted([b"a"], 1) == [b"a"]
    changed = [i for i in range(400) if planted([b"%d" % k for k in range(300)], i) != [b"%d" % k for k in range(300)]]
    assert 20 < len(changed) < 60
