"""Quality checks of clips: length, silence, score and repeated dialogue, with a message for each issue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.binding import let
from framewell.operators.joins import contained

CLIP = ["video_id", "pos"]


SPAN = ["video_id", "start_seconds", "end_seconds"]


def dialogue_facts(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Per clip: silence_ratio, fingerprint and repeated, from one join of distinct spans with the lines that start in them.

    A line speaks until the next one or the clip's end, but at most ``max_line_seconds``. The fingerprint is the SHA-256 of the
    trimmed lower-case lines, joined in order; it is empty without lines, and for a clip of blank ones. So texts are shuffled
    for spans and not for clips. A clip without lines is all silence.
    """
    light = clips.select(*SPAN).distinct()
    met = contained(light, segments.select("video_id", F.col("pos").alias("line"), "seconds", "text"), ["video_id"], "start_seconds", "end_seconds", "seconds", bucket=conf.join_bucket_seconds)
    met = met.select(*[f"s.{c}" for c in SPAN], "line", "seconds", F.lower(F.trim("text")).alias("said"))
    along = Window.partitionBy(*SPAN).orderBy("seconds", "line")
    until = F.coalesce(F.lead("seconds").over(along), F.col("end_seconds"))
    met = met.withColumn("speech", F.least(F.greatest(until - F.col("seconds"), F.lit(0.0)), F.lit(conf.max_line_seconds)))
    lines = F.array_sort(F.collect_list(F.struct("seconds", "line", "said")))
    found = met.groupBy(*SPAN).agg(F.sum("speech").alias("speech"), lines.alias("lines"), F.count("*").alias("n"))
    texts = F.transform("lines", lambda x: x.said)
    said = F.array_compact(texts)
    print_ = let(F.array_join(texts, " "), lambda t: F.when(t == "", F.lit("").cast("binary")).otherwise(F.unhex(F.sha2(t, 256))))
    found = found.select(*SPAN, "speech", print_.alias("fingerprint"), (F.col("n") != F.size(F.array_distinct(said))).alias("repeated"))
    out = clips.join(found, SPAN, "left")
    silence = F.when(F.col("speech").isNull() | (F.col("duration_seconds") <= 0), F.lit(1.0)).otherwise(F.lit(1.0) - F.least(F.lit(1.0), F.col("speech") / F.col("duration_seconds")))
    return out.select(*clips.columns, silence.alias("silence_ratio"), F.coalesce("fingerprint", F.lit("").cast("binary")).alias("fingerprint"), F.coalesce("repeated", F.lit(False)).alias("repeated"))


def silence_ratio(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    return dialogue_facts(clips, segments, conf).drop("fingerprint", "repeated")


def check_quality(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Per clip: index (from 1 in ``pos`` order), passed and issues (code, message), in the order of the checks.

    A clip repeats another's dialogue if an accepted clip with the same fingerprint comes before it. The first clip of a
    fingerprint that passes all other checks is the only one accepted, so the least such index decides.
    """
    facts = dialogue_facts(clips, segments, conf).withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("pos")).cast("long"))
    low, high = conf.min_clip_seconds, conf.max_clip_seconds
    percent = lambda c: F.format_string("%.0f%%", c * 100)
    issue = lambda cond, code, message: F.when(cond, F.struct(F.lit(code).alias("code"), message.alias("message")))
    seconds, score = F.format_string("%.1f", "duration_seconds"), F.format_string("%.1f", "viral_score")
    own = [
        issue(F.col("duration_seconds") < low, "too_short", F.concat(F.lit("Clip duration "), seconds, F.lit(f"s is below minimum {low}s"))),
        issue(F.col("duration_seconds") > high, "too_long", F.concat(F.lit("Clip duration "), seconds, F.lit(f"s exceeds maximum {high}s"))),
        issue(F.col("silence_ratio") > conf.max_silence_ratio, "too_much_silence", F.concat(F.lit("Estimated silence ratio "), percent(F.col("silence_ratio")), F.lit(f" exceeds maximum {conf.max_silence_ratio:.0%}"))),
        issue(F.col("viral_score") < conf.min_viral_score, "low_confidence", F.concat(F.lit("Viral score "), score, F.lit(f" is below minimum {conf.min_viral_score:.1f}"))),
        issue(F.col("repeated"), "repeated_dialogue", F.lit("Clip contains repeated dialogue lines")),
    ]
    facts = facts.withColumn("own", F.array_compact(F.array(*own)))
    accepted = F.min(F.when(F.size("own") == 0, F.col("index"))).over(Window.partitionBy("video_id", "fingerprint"))
    again = issue((F.length("fingerprint") > 0) & (accepted < F.col("index")), "repeated_dialogue", F.lit("Clip dialogue duplicates another clip in the batch"))
    out = facts.withColumn("issues", F.concat("own", F.array_compact(F.array(again))))
    return out.select("video_id", "pos", "index", "start_seconds", "end_seconds", "viral_score", (F.size("issues") == 0).alias("passed"), "issues")


def passed_clips(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The clips that pass all checks."""
    return clips.join(check_quality(clips, segments, conf).filter("passed").select(*CLIP), CLIP, "left_semi")
