"""Operators that SQL can't express against plain versions, one document at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from framewell.llm import licenses, quality

from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    """Base columns, labels and score of a text."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    found = []
    for label, template in licenses.TEMPLATES:
        t = template.split()
        hits = [(i - a, a, i) for i in range(len(w) - 2) for a in range(len(t) - 2) if w[i : i + 3] == t[a : a + 3]]
        islands = []
        for d in sorted({h[0] for h in hits}):
            if not islands or d - islands[-1][-1] > 3:
                islands.append([])
            islands[-1].append(d)
        for island in islands:
            mine = [h for h in hits if h[0] in island]
            first, end, share = min(h[2] for h in mine), max(h[2] for h in mine) + 3, len({h[1] for h in mine}) / (len(t) - 2)
            marks = lambda x: {y for y in x if y in licenses.MARKS}
            if share >= 0.75 and end - first <= 1.5 * len(t) and marks(w[first:end]) == marks(t):
                found.append((-share, -len(t), label, first, end))
    kept = []
    for s in sorted(set(found)):
        if not any(s[2] != k[2] and s[3] < k[4] and k[3] < s[4] for k in kept):
            kept.append(s)
    labels = sorted({x[1] for x in base})
    score = 1.0 if base else max((-s[0] for s in kept), default=0.0)
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(labels), ",".join(sorted({*labels, *(s[2] for s in kept)})), score


def test_licenses_are_those_of_a_plain_scan(spark):
    rng = np.random.default_rng(8)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for _ in range(150):  # templates with words put in, left out or replaced, and others behind them
        words = []
        for k in rng.integers(0, len(licenses.TEMPLATES), rng.integers(1, 4)):
            for word in licenses.TEMPLATES[k][1].split():
                r = rng.random()
                words += [word] if r > 0.09 else [] if r < 0.03 else ["the", word] if r < 0.06 else [str(rng.choice(licenses.MARKS))]
            words += ["and"] * rng.integers(0, 5)
        texts.append("; ".join(words) if rng.random() < 0.3 else " ".join(words).title())
    texts += ["\u212aelvin licensed under cc by 4 0", "GNU General Public \u0130 License", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(frame).collect()}
    for i, text in enumerate(texts):
        want = plain_scan(text)
        assert got[i][:-1] == want[:-1] and got[i][-1] == pytest.approx(want[-1]), text


def test_scores_are_those_of_a_plain_forward_pass(spark):
    """Each document's score from its own passages, written out with loops, whatever block it was in."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()] + [None, "", "one", "w " * 5000]
    column = pa.array(texts, pa.string())
    parts = list(quality.passages(column, 64))
    x, first = np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    model = quality.fit(x, first, np.arange(len(texts)) % 2 * 1.0, quality.Quality(epochs=2))
    scores = model.forward(x, first)["score"]
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for i, text in enumerate(texts):
        (_, own, _), codes, weights = next(quality.passages(pa.array([text], pa.string()), 64)), [], []
        assert len(own) == max(1, -(-len((text or "").split()) // 64))
        for passage in own:
            h = np.tanh(np.clip((passage - model.mean) / model.scale, -5, 5) @ p["W"] + p["b"])
            codes.append(h)
            weights.append(float(np.exp((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"])))
        bag = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        assert scores[i] == pytest.approx(float(sigmoid(bag @ p["c"] + p["d"][0])), abs=1e-9)
