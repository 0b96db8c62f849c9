"""Analyzers as table functions: typed failures, other windows stay."""

from __future__ import annotations

import pytest
from framewell.plans import analyzers as A

WINDOWS = "video_id long, window_index long, window_start double, window_end double, text string"


def analyze(text: str, start: float, end: float) -> list:
    if text == "boom":
        return 1 // 0
    if text == "limit":
        raise A.RateLimited("slow down")
    if text == "bad":
        return [{"start_seconds": 1.0}]
    return [{"start_seconds": start + i, "end_seconds": start + i + n, "viral_score": 5.0, "emotion": "joy", "other": 1} for i, n in enumerate(map(int, text.split()))]


def test_failures_are_rows_and_other_windows_stay(spark) -> None:
    A.register_analyzer(spark, "find_clips", analyze)
    texts = ["10 20", "boom", "limit", "", "bad", "10 0 5"]
    windows = spark.createDataFrame([(1, i, 0.0, 600.0, t) for i, t in enumerate(texts)], WINDOWS)
    rows = A.analyzed(windows, "find_clips")
    got = {(r.window_index, r.pos): (r.start_seconds, r.end_seconds, r.failure_kind, r.failure) for r in rows.collect()}
    assert got == {
        (0, 0): (0.0, 10.0, None, None), (0, 1): (1.0, 21.0, None, None), (1, None): (None, None, "error", "ZeroDivisionError: integer division or modulo by zero"),
        (2, None): (None, None, "rate_limited", "RateLimited: slow down"), (4, None): (None, None, "bad_answer", "BadAnswer: not a list of clips"),
        (5, 0): (0.0, 10.0, None, None), (5, 1): (2.0, 7.0, None, None),
    }
    clips = A.clips_of(rows).collect()
    assert sorted((r.window_index, r.start_seconds, r.end_seconds) for r in clips) == [(0, 0.0, 10.0), (0, 1.0, 21.0), (5, 2.0, 7.0)]
    named = spark.sql("SELECT c.pos FROM VALUES ('3 4', 1.0D, 2.0D) AS w(t, a, b), LATERAL find_clips(w.t, w.a, w.b) c").collect()
    assert sorted(r.pos for r in named) == [0, 1]


def test_names(spark) -> None:
    with pytest.raises(ValueError, match="name"):
        A.register_analyzer(spark, "a; DROP", analyze)
    with pytest.raises(ValueError, match="name"):
        A.analyzed(spark.createDataFrame([], WINDOWS), "x y")
