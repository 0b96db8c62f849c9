"""Scores of clips and transcript lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings

#: Intensity by emotion, in the order in which partial matches are tried.
EMOTION_INTENSITY = {
    "betrayal": 1.0, "shock": 0.95, "accusation": 0.9, "anger": 0.9, "reveal": 0.9, "cliffhanger": 0.88, "suspense": 0.85, "argument": 0.85, "lie": 0.85,
    "drama": 0.8, "voting": 0.8, "emotional": 0.78, "strategy": 0.75, "laughter": 0.72, "humor": 0.72, "funny": 0.7, "surprise": 0.7, "memorable": 0.65,
}
#: Fixed value: words that mark a line as charged.
CHARGED = r"(?i)\b(?:never|always|lie|lying|vote|kill|shocked|crazy|insane|wow|what)\b"


def emotion_intensity(emotion: Column) -> Column:
    """The intensity of an emotion: its own, else that of the first known one it contains, else one half."""
    name = F.lower(F.trim(emotion))
    exact = [(name == known, weight) for known, weight in EMOTION_INTENSITY.items()]
    partly = [(F.contains(name, F.lit(known)), weight) for known, weight in EMOTION_INTENSITY.items()]
    (first, weight), *rest = exact + partly
    out = F.when(first, F.lit(weight))
    for condition, weight in rest:
        out = out.when(condition, F.lit(weight))
    return out.otherwise(F.lit(0.5))


def length_score(seconds: Column, conf: Settings = DEFAULTS) -> Column:
    """1 within the ideal length, falling to 0 at the limits."""
    rise, fall = conf.ideal_min_seconds - conf.min_clip_seconds, conf.max_clip_seconds - conf.ideal_max_seconds
    short = (seconds - conf.min_clip_seconds) / rise if rise > 0 else F.lit(0.0)
    long = (F.lit(float(conf.max_clip_seconds)) - seconds) / fall if fall > 0 else F.lit(0.0)
    inside = F.when(seconds.between(conf.ideal_min_seconds, conf.ideal_max_seconds), F.lit(1.0)).when(seconds < conf.ideal_min_seconds, short).otherwise(long)
    return F.when((seconds < conf.min_clip_seconds) | (seconds > conf.max_clip_seconds), F.lit(0.0)).otherwise(inside)


def rank_score(viral: Column, emotion: Column, dialogue: Column, length: Column, conf: Settings = DEFAULTS) -> Column:
    """The weighted sum of a viral score from 0 to 10 and factors from 0 to 1, to three digits."""
    total = viral * conf.weight_viral + emotion * 10 * conf.weight_emotion + dialogue * 10 * conf.weight_dialogue + length * 10 * conf.weight_length
    return F.round(total, 3)


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def line_score(text: Column) -> Column:
    """How lively a transcript line is: its length, marks and charged words."""
    length = F.least(F.lit(1.0), words(text) / F.lit(18.0))
    marks = F.when(text.rlike("[!?]"), F.lit(0.15)).otherwise(F.lit(0.0))
    charged = F.when(text.rlike(CHARGED), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.35) + length * 0.35 + marks + charged)
