"""Overlap removal with an index against the greedy choice over all kept clips."""

from __future__ import annotations

import random
import time

import pytest
from framewell.config import Settings
from framewell.operators.intervals import Intervals
from framewell.plans.ranking import remove_overlaps

SCHEMA = "video_id long, pos long, start_seconds double, end_seconds double, duration_seconds double, rank_score double"


def greedy(rows: list, least: float) -> set:
    kept: list = []
    for v, pos, s, e, d, _ in sorted(rows, key=lambda r: (r[0], -r[5], r[1])):
        ratio = lambda k: max(0.0, min(k[3], e) - max(k[2], s)) / min(k[4], d) if min(k[4], d) > 0 else 0.0  # noqa: B023, E731
        if all(k[0] != v or ratio(k) < least for k in kept):
            kept.append((v, pos, s, e, d))
    return {k[:2] for k in kept}


def made(rng: random.Random, videos: int, n: int, span: float) -> list:
    out = []
    for v in range(videos):
        for i in range(n):
            s, d = rng.uniform(0, span), rng.choice([0.0, 1e-3, rng.uniform(0, 5), rng.uniform(20, 90), span])
            out.append((v, i, s, s + rng.choice([d, d, d / 2]) * rng.choice([1, 1, 1, -1]), d, float(rng.randint(0, 9))))
    return out


@pytest.mark.parametrize("least", [0.5, 0.01, 1.0])
def test_random_cases(spark, least: float) -> None:
    rng = random.Random(4)
    rows = made(rng, 60, 30, 300.0) + [(100, 0, 1.0, 2.0, 1.0, 5.0)] * 2
    got = remove_overlaps(spark.createDataFrame(rows, SCHEMA), Settings(overlap_threshold=least)).collect()
    assert {(r.video_id, r.pos) for r in got} == greedy(rows, least)


def test_overlapping_finds_all() -> None:
    rng = random.Random(1)
    kept, index = [], Intervals()
    for _ in range(400):
        s = rng.uniform(0, 100)
        e = s + rng.choice([0.0, rng.uniform(0, 0.1), rng.uniform(0, 3), rng.uniform(0, 60)])
        want = sorted(k for k in kept if min(k[1], e) > max(k[0], s))
        assert sorted(index.overlapping(s, e)) == want or e <= s
        kept.append((s, e, 1.0))
        index.add(s, e, 1.0)


def test_one_video_of_many_clips(spark) -> None:
    """Time follows the clips: 100,000 clips of one video take far less than four times those of 50,000."""

    def seconds(n: int) -> float:
        rows = spark.range(n).selectExpr("1L AS video_id", "id AS pos", "id * 37 % 1000003 * 1.0D AS start_seconds", "id * 37 % 1000003 + 30.0D AS end_seconds", "30.0D AS duration_seconds", "id % 101 * 1.0D AS rank_score")
        began = time.time()
        remove_overlaps(rows).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1000)
    half, whole = seconds(50_000), seconds(100_000)
    assert whole < 3 * max(half, 1.0) and whole < 60
