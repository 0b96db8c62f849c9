from __future__ import annotations

import random

from framewell.llm.suffix_automaton import ReferenceDedup, SuffixAutomaton, remove_reference


def test_matching_statistics_are_the_longest_matches():
    rng = random.Random(6)
    for _ in range(150):
        parts = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(0, 4))]
        text = [rng.randrange(4) for _ in range(40)]
        inside = {tuple(p[a:b]) for p in parts for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
        want = [max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(text))]
        assert SuffixAutomaton(parts).matching_statistics(text).tolist() == want


def test_reference_passages_go(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    a, b = words(12), words(9)
    docs = [(1, " ".join(words(5) + a[1:] + words(4))), (2, " ".join(a[:6] + ["x"] + b)), (3, None), (3, None), (4, ""), (None, " ".join(b))]
    reference = spark.createDataFrame([(" ".join(a),), (" ".join(b),), (None,), ("",)], "text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for shard in (100, 10):
        out = remove_reference(frame, reference, ReferenceDedup(window=8, shard_words=shard)).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 9, 9), (1, 20, 11), (2, 16, 9), (3, 0, 0), (3, 0, 0), (4, 0, 0)]
    assert remove_reference(frame, reference.limit(0), ReferenceDedup(window=8)).agg({"n_removed": "sum"}).first()[0] == 0


def test_a_reference_text_longer_than_a_shard(spark):
    """Passages that cross the pieces of a long reference text go whole, and no automaton holds all of it."""
    words = [f"w{i}" for i in range(400)]
    text = lambda *parts: " ".join(w for a, b in parts for w in words[a:b])
    docs = [(1, "a " + text((30, 90)) + " b"), (2, text((0, 400))), (3, text((100, 109), (200, 209))), (4, "x " + text((390, 400)) + " y " + text((45, 60))), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for shard in (50, 10_000):
        out = remove_reference(frame, spark.createDataFrame([(text((0, 400)),), ("short",), (None,)], "text string"), ReferenceDedup(window=10, shard_words=shard))
        got[shard] = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, [tuple(s) for s in r.spans]) for r in out.collect()}
    assert got[50] == got[10_000]
    assert {i: r[:2] for i, r in got[50].items()} == {1: (62, 60), 2: (400, 400), 3: (18, 0), 4: (27, 25), 5: (0, 0)}
