"""Clip ranking: factors, greedy overlap removal, variety.

``clips``: video_id, pos, start_seconds, end_seconds, duration_seconds, viral_score, emotion. ``segments``: video_id, pos,
seconds, speaker, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.scoring import emotion_intensity, length_score, rank_score
from framewell.operators.folds import ordered_scan
from framewell.operators.intervals import Intervals
from framewell.operators.joins import contained

CLIP = ["video_id", "pos"]


def dialogue(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Per clip the characters of the lines that start in it, and how many lines. One join serves all users of it."""
    light = clips.select(*CLIP, "start_seconds", "end_seconds")
    met = contained(light, segments.select("video_id", "seconds", "text"), ["video_id"], "start_seconds", "end_seconds", "seconds", bucket=conf.join_bucket_seconds)
    return met.groupBy("s.video_id", "s.pos").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_lines"))


def dialogue_density(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``clips`` with characters of dialogue per second; 0 without dialogue or length."""
    out = clips.join(dialogue(clips, segments, conf), CLIP, "left")
    density = F.when(F.col("duration_seconds") > 0, F.coalesce("n_chars", F.lit(0)) / F.col("duration_seconds")).otherwise(F.lit(0.0))
    return out.withColumn("dialogue_density", density).drop("n_chars", "n_lines")


def score_clips(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``clips`` with their factors and ``rank_score``; density counts relative to the video's densest clip."""
    most = F.max("dialogue_density").over(Window.partitionBy("video_id"))
    dense = F.when(most > 0, F.col("dialogue_density") / most).otherwise(F.lit(0.0))
    out = dialogue_density(clips, segments, conf).withColumn("dialogue", dense)
    out = out.withColumn("emotion_intensity", emotion_intensity(F.col("emotion"))).withColumn("length_score", length_score(F.col("duration_seconds"), conf))
    return out.withColumn("rank_score", rank_score(F.col("viral_score"), F.col("emotion_intensity"), F.col("dialogue"), F.col("length_score"), conf)).drop("dialogue")


def remove_overlaps(ranked: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """By falling score, clips that do not overlap a clip kept before them by ``overlap_threshold`` of the shorter.

    A clip that was dropped drops no other, so this is one scan of each video's clips by score: rows stream, and a task holds
    only the clips kept, sorted by start, and looks at those near a clip (see :class:`framewell.operators.intervals.Intervals`).
    """

    def make():
        kept, least = Intervals(), conf.overlap_threshold

        def step(start: float, end: float, seconds: float) -> tuple:
            for a, b, length in kept.overlapping(start, end):
                shorter = min(length, seconds)
                if ((min(b, end) - max(a, start)) / shorter if shorter > 0 else 0.0) >= least:
                    return (False,)
            kept.add(start, end, seconds)
            return (True,)

        return step

    if conf.overlap_threshold <= 0:
        raise ValueError("overlap_threshold must be above 0")
    seen = ordered_scan(ranked, ["video_id"], [F.desc("rank_score"), "pos"], ["start_seconds", "end_seconds", "duration_seconds"], make, "_kept boolean")
    return seen.filter("_kept").drop("_kept")


def variety(ranked: DataFrame, n: int, conf: Settings = DEFAULTS) -> DataFrame:
    """The video's ``n`` best clips if each emotion's best clip gets a bonus; ``rank`` is their place.

    Choosing one by one, with a bonus for emotions not yet chosen, gives the same: an emotion's best clip comes before its
    others in either order.
    """
    own = Window.partitionBy("video_id", F.lower(F.trim("emotion"))).orderBy(F.desc("rank_score"), "pos")
    bonus = F.when(F.row_number().over(own) == 1, F.lit(conf.variety_bonus)).otherwise(F.lit(0.0))
    best = Window.partitionBy("video_id").orderBy(F.desc("boosted"), F.desc("rank_score"), "pos")
    out = ranked.withColumn("boosted", F.col("rank_score") + bonus).withColumn("rank", F.row_number().over(best).cast("long"))
    return out.filter(F.col("rank") <= n).drop("boosted")


def rank_clips(clips: DataFrame, segments: DataFrame, top_n: int | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """Score, remove overlaps, choose with variety. Without clips the result is empty."""
    return variety(remove_overlaps(score_clips(clips, segments, conf), conf), top_n or conf.max_clips, conf)
