"""PII: places of many matches, the trees and their thresholds."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from framewell.llm import pii
from framewell.llm.boosting import Trees, threshold
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, valid string"


def spans(found, name="base") -> dict:  # noqa: ANN001
    return {r.doc_id: [tuple(x.split(":")) for x in (r.s.split(",") if r.s else [])] for r in found.select("doc_id", pii.listed(F.col(name)).alias("s")).collect()}


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 700])
def test_places_of_many_matches(spark, n: int) -> None:
    text = "é😀 " + "".join(f"ü{'x' * (i % 5)} a{i}@mail.org{', ' * (i % 3)} " for i in range(n)) + "tail"
    found = spans(pii.find(spark.createDataFrame([(1, text, "v"), (2, None, None)], SCHEMA)))
    assert found == {1: [("email", str(m.start()), str(m.end())) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)], 2: []}
    assert len(found[1]) == n
    clean = pii.redact(spark.createDataFrame([(1, text, "v")], SCHEMA)).first().text
    assert clean == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]", text)


def test_time_grows_with_the_matches(spark) -> None:
    def seconds(n: int) -> float:
        docs = spark.createDataFrame([(1, " ".join(f"user{i}@mail.org" for i in range(n)), "v")], SCHEMA)
        began = time.time()
        assert pii.candidates(docs.withColumn("text_hash", F.lit(0)), pii.PiiScan()).filter("kind = 'email'").count() == n
        return time.time() - began

    seconds(100)
    one, two = min(seconds(10_000) for _ in range(2)), min(seconds(20_000) for _ in range(2))
    assert two < 2.5 * max(one, 0.5), (one, two)


def test_trees_tell_true_candidates_from_false_ones() -> None:
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (400, 3))
    good = ((x[:, 0] >= 2) == (x[:, 1] >= 1)).astype(float)
    model = Trees(["a", "b", "c"]).fit(x, good * 5, np.full(len(x), 5.0))
    score = model.predict(x)
    assert score[good == 1].min() > 0.9 and score[good == 0].max() < 0.1


def test_score_of_the_column_is_that_of_numpy(spark) -> None:
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (200, 2))
    model = Trees(["a", "b"]).fit(x, (x.sum(axis=1) > 4).astype(float), np.ones(len(x)))
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int").select(model.column().alias("s")).collect()
    assert np.allclose([r.s for r in rows], model.predict(x), rtol=0, atol=1e-12)


def test_threshold() -> None:
    assert threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.9) == 2.0
    score, good = np.array([0.9, 0.5, 0.5, 0.2]), np.array([10.0, 9, 1, 0])
    assert 0.5 - 1e-8 < threshold(score, good, np.array([10.0, 10, 1, 50]), 0.9) < 0.5
    assert threshold(score, np.zeros(4), np.ones(4), 0.9) == 2.0
    assert threshold(np.array([0.4, 0.4 - 1e-13]), np.array([9.0, 0.0]), np.array([9.0, 9.0]), 0.9) == 2.0, "scores that differ in the last bits are one"


def test_false_masked_addresses_stay_far_below_the_bound(spark) -> None:
    """Plain addresses are valid by definition and must not vouch for masked forms, of which here none is right."""
    rows = [(i, f"write to user{i}@mail{i % 7}.org today", "v") for i in range(400)] + [(1000 + i, f"we meet (at) noon.9{i % 10} as ever", "v") for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("text_hash", F.xxhash64("text"))
    found = pii.features(pii.candidates(docs, pii.PiiScan()))
    model, bounds = pii.train(found, pii.PiiScan())
    worst = found.filter("kind = 'email' AND form = 1").select(F.max(model.column()).alias("s")).first().s
    assert worst is not None and bounds["email"] == 2.0 > worst
    got = spans(pii.find(docs), "spans")
    assert all(len(got[i]) == 1 for i in range(400)) and all(got[1000 + i] == [] for i in range(10))


def test_right_masked_addresses_are_found(spark) -> None:
    rows = [(i, f"write to user{i} (at) mail{i % 7}.org today", "v") for i in range(300)]
    got = spans(pii.find(spark.createDataFrame(rows, SCHEMA)), "spans")
    assert all([x[0] for x in got[i]] == ["email"] for i in range(300))
