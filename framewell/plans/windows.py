"""Transcript windows, candidate windows and the merging of what windows gave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.scoring import line_score, words
from framewell.operators.islands import first_rows, interval_islands, top_rows
from framewell.operators.joins import overlapping


def line_ends(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``segments`` with end_seconds: the next line's start, or a tail after the last one."""
    along = Window.partitionBy("video_id").orderBy("seconds", "pos")
    return segments.withColumn("end_seconds", F.coalesce(F.lead("seconds").over(along), F.col("seconds") + conf.tail_seconds))


def transcript_windows(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Overlapping windows of each video: video_id, index, start_seconds, end_seconds. The last one ends with the video."""
    size, stride = conf.window_seconds, conf.window_seconds - conf.window_overlap_seconds
    if stride <= 0:
        raise ValueError("the overlap must be shorter than the window")
    ends = segments.groupBy("video_id").agg(F.min("seconds").alias("first"), (F.max("seconds") + conf.tail_seconds).alias("total"))
    more = F.greatest(F.ceil((F.col("total") - F.col("first") - size) / stride), F.lit(0))
    starts = ends.select("video_id", "total", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("total") <= size, F.lit(0)).otherwise(more).cast("long"))).alias("index"))
    start = F.when(F.col("total") <= size, F.col("first")).otherwise(F.col("first") + F.col("index") * stride)
    return starts.select("video_id", "index", start.alias("start_seconds"), F.when(F.col("total") <= size, F.col("total")).otherwise(F.least(start + size, F.col("total"))).alias("end_seconds"))


def window_lines(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Lines of each window, by overlap of intervals: a line can be in several windows. Windows without lines have none."""
    pairs = overlapping(transcript_windows(segments, conf), line_ends(segments, conf).withColumnRenamed("seconds", "start_seconds"), ["video_id"], bucket=conf.window_seconds)
    return pairs.select("l.video_id", "index", F.col("l.start_seconds").alias("window_start"), F.col("l.end_seconds").alias("window_end"), "pos", F.col("r.start_seconds").alias("seconds"), "speaker", "text")


def merge_window_clips(found: DataFrame) -> DataFrame:
    """Clips of all windows (video_id, window_index, pos, start_seconds, end_seconds), equal spans once: the first window's."""
    return first_rows(found, ["video_id", "start_seconds", "end_seconds"], ["window_index", "pos"])


def transcript_signals(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """One signal per line: start_seconds, end_seconds, signal_type, score, label, details."""
    along = Window.partitionBy("video_id").orderBy("seconds", "pos")
    end = F.coalesce(F.lead("seconds").over(along), F.col("seconds") + F.greatest(F.lit(8.0), words(F.col("text")) * F.lit(0.4)))
    out = segments.select("video_id", "pos", F.col("seconds").alias("start_seconds"), end.alias("end_seconds"), F.lit("transcript_dialogue").alias("signal_type"), line_score(F.col("text")).alias("score"), F.lit("dialogue_peak").alias("label"), F.substring("text", 1, 120).alias("details"))
    return out.filter(F.col("score") >= conf.candidate_min_score)


def scene_signals(scenes: DataFrame) -> DataFrame:
    """A signal around the middle of each scene (video_id, pos, start_seconds, end_seconds)."""
    middle, half = (F.col("start_seconds") + F.col("end_seconds")) / 2, F.least(F.lit(15.0), (F.col("end_seconds") - F.col("start_seconds")) / 2)
    return scenes.select("video_id", "pos", (middle - half).alias("start_seconds"), (middle + half).alias("end_seconds"), F.lit("scene_change").alias("signal_type"), F.lit(0.6).alias("score"), F.lit("scene").alias("label"), F.lit("").alias("details"))


def merge_signals(signals: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Signals joined into islands, each clamped to the allowed length by its end: video_id, island, start_seconds,
    end_seconds, score, labels and signal_types (distinct, in order), details (the first that is not empty)."""
    order = ["start_seconds", "pos"]
    marked = interval_islands(signals, ["video_id"], "start_seconds", "end_seconds", order, conf.candidate_merge_gap)
    item = F.struct("start_seconds", "pos", "label", "signal_type", "details")
    grouped = marked.groupBy("video_id", "island").agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("reach"), F.max("score").alias("score"), F.array_sort(F.collect_list(item)).alias("items"))
    length = F.least(F.greatest(F.col("reach") - F.col("start_seconds"), F.lit(conf.candidate_min_seconds)), F.lit(conf.candidate_max_seconds))
    texts = F.filter(F.transform("items", lambda x: x.details), lambda d: d != "")
    return grouped.select("video_id", "island", "start_seconds", (F.col("start_seconds") + length).alias("end_seconds"), "score", F.array_distinct(F.transform("items", lambda x: x.label)).alias("labels"), F.array_distinct(F.transform("items", lambda x: x.signal_type)).alias("signal_types"), F.coalesce(F.get(texts, F.lit(0)), F.lit("")).alias("details"))


def candidate_windows(signals: DataFrame, n: int, conf: Settings = DEFAULTS) -> DataFrame:
    """The ``n`` best islands of each video, with a score from 0 to 10 and their rank."""
    out = merge_signals(signals, conf).withColumn("score", F.least(F.lit(10.0), F.col("score") * 10))
    return top_rows(out, ["video_id"], [F.desc("score"), "start_seconds", "island"], n)


def analyze_windows(segments: DataFrame, analyzer: Callable[[DataFrame], DataFrame], conf: Settings = DEFAULTS) -> DataFrame:
    """Apply an analyzer (a function from window lines to clips with window_index) to all windows and merge its clips."""
    return merge_window_clips(analyzer(window_lines(segments, conf)))
