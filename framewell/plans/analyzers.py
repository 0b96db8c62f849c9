"""Analyzers as table functions: a window's text to any number of clips, for lateral joins and by name in SQL.

An analyzer is a Python function of a window's text, start and end that gives clips as dicts, or raises. Registered under a name
it is a table function whose rows are clips or one typed failure, so a window that fails costs no other window:

    register_analyzer(spark, "find_clips", analyze)
    SELECT w.video_id, c.* FROM windows w, LATERAL find_clips(w.text, w.window_start, w.window_end) c
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.plans.windows import merge_window_clips, window_lines
from framewell.sources.transcripts import prompt_line

#: Rows of the table function. A failure has its kind and text and no clip.
CLIPS = "pos long, start_seconds double, end_seconds double, viral_score double, emotion string, failure_kind string, failure string"
NAMES = [x.split()[0] for x in CLIPS.split(", ")]

Analyze = Callable[[str, float, float], list[dict]]


class AnalyzerFailure(Exception):
    """A window could not be analyzed; ``kind`` says why."""

    kind = "error"


class Refused(AnalyzerFailure):
    kind = "refused"


class RateLimited(AnalyzerFailure):
    kind = "rate_limited"


class BadAnswer(AnalyzerFailure):
    """The analyzer's answer is no list of clips."""

    kind = "bad_answer"


def rows_of(analyze: Analyze, text: str, start: float, end: float) -> list[dict]:
    """The rows for one window: clips that end after they start, in the analyzer's order, or a failure."""
    try:
        found = analyze(text, start, end)
        if not isinstance(found, list) or not all(isinstance(c, dict) and {"start_seconds", "end_seconds"} <= c.keys() for c in found):
            raise BadAnswer("not a list of clips")
        rows = [{n: c.get(n) for n in NAMES if n not in ("pos", "failure_kind", "failure")} for c in found]
        rows = [r for r in rows if float(r["end_seconds"]) > float(r["start_seconds"])]
        return [{"pos": i, **r} for i, r in enumerate(rows)]
    except Exception as e:  # any error of an analyzer is a row, so that other windows stay
        return [{"failure_kind": getattr(e, "kind", "error"), "failure": f"{type(e).__name__}: {e}"}]


def register_analyzer(spark: SparkSession, name: str, analyze: Analyze) -> None:
    """Make ``analyze`` the table function ``name`` of the session; a name that is there is replaced."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} can't be a function's name")

    class Analyzer:
        def eval(self, text: str, start: float, end: float) -> Iterator[tuple]:
            for row in rows_of(analyze, text, start, end):
                yield tuple(row.get(n) for n in NAMES)

    spark.udtf.register(name, F.udtf(Analyzer, returnType=CLIPS, useArrow=True))


def window_texts(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The lines of each window as one text: video_id, window_index, window_start, window_end, text."""
    line = F.struct("seconds", "pos", prompt_line().alias("line"))
    grouped = window_lines(segments, conf).groupBy("video_id", F.col("index").alias("window_index"), "window_start", "window_end").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("video_id", "window_index", "window_start", "window_end", F.array_join(F.transform("lines", lambda x: x.line), "\n").alias("text"))


def analyzed(windows: DataFrame, name: str) -> DataFrame:
    """Clips and failures of all windows by the analyzer ``name``: video_id, window_index and the columns of :data:`CLIPS`."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} can't be a function's name")
    sql = f"SELECT w.video_id, w.window_index, c.* FROM {{windows}} w, LATERAL {name}(w.text, w.window_start, w.window_end) c"
    return windows.sparkSession.sql(sql, windows=windows)


def clips_of(rows: DataFrame) -> DataFrame:
    """The clips among :func:`analyzed` rows, equal spans of a video once."""
    return merge_window_clips(rows.filter("failure_kind IS NULL").drop("failure_kind", "failure"))
