"""Texts that an external renderer takes: crop and blur filters, argument lists, and its log read back.

Their words and signs are fixed values, set by the renderer's syntax.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _whole(c: Column) -> Column:
    """Rounded to an integer, halves to even, as text."""
    return F.bround(c, 0).cast("long").cast("string")


def even(c: Column) -> Column:
    """The rounded value made even by at most one less, at least 2."""
    n = F.bround(c, 0).cast("long")
    return F.greatest(F.lit(2), n - F.pmod(n, F.lit(2)))


def crop_filter(x: Column, y: Column, w: Column, h: Column, width: int = 1080, height: int = 1920) -> Column:
    """Crop one segment and scale it to the target."""
    return _text("crop=", even(w).cast("string"), ":", even(h).cast("string"), ":", _whole(x), ":", _whole(y), f",scale={width}:{height}:flags=lanczos")


def blur_filter(x: Column, y: Column, w: Column, h: Column, width: int = 1080, height: int = 1920, strength: int = 20) -> Column:
    """One segment over a blurred, filled copy of the frame; sizes are rounded but not made even."""
    back = f"[0:v]split=2[fg][bg];[bg]scale={width}:{height}:force_original_aspect_ratio=increase,crop={width}:{height},boxblur={strength}:5[blurred];"
    return _text(back + "[fg]crop=", _whole(w), ":", _whole(h), ":", _whole(x), ":", _whole(y), f",scale={width}:-2:force_original_aspect_ratio=decrease[scaled];[blurred][scaled]overlay=(W-w)/2:(H-h)/2[vout]")


def center_crop_filter(w: Column, h: Column, width: int = 1080, height: int = 1920) -> Column:
    """Crop the middle of a frame that is wider than the target, else scale up and crop."""
    side = f"ih*{width}/{height}"
    wide = f"crop={side}:ih:(iw-{side})/2:0,scale={width}:{height}"
    tall = f"scale={width}:{height}:force_original_aspect_ratio=increase,crop={width}:{height}"
    return F.when(w / h > width / height, wide).otherwise(tall)


def cut_arguments(source: Column, target: Column, start: Column, seconds: Column, copy: bool = True) -> Column:
    """Arguments that cut a clip, by copying streams or by encoding them again."""
    how = ["-c", "copy", "-avoid_negative_ts", "make_zero"] if copy else ["-c:v", "libx264", "-preset", "fast", "-crf", "23", "-c:a", "aac", "-b:a", "128k"]
    head = [F.lit("-y"), F.lit("-ss"), F.format_string("%.3f", start), F.lit("-i"), source, F.lit("-t"), F.format_string("%.3f", seconds)]
    return F.array(*head, *map(F.lit, how), target)


def clip_paths(index: Column) -> Column:
    """Output paths of a clip by kind, and how to get the index back: see :func:`clip_index`."""
    n = index.cast("string")
    return F.struct(_text("clips/clip", n, ".mp4").alias("clip"), _text("vertical/clip", n, "_vertical.mp4").alias("vertical"), _text("subtitles/clip", n, ".srt").alias("subtitles"), _text("metadata/clip", n, ".json").alias("metadata"))


def clip_index(stem: Column) -> Column:
    return F.regexp_extract(stem, r"clip(\d+)(?:_vertical)?(?:\.[a-z0-9]+)?$", 1).try_cast("int")


def scene_log(logs: DataFrame, threshold: float) -> DataFrame:
    """Scene boundaries of a detector's log (video_id, content): timestamp, confidence from 0 to 1 (the threshold if none is given)."""
    lines = logs.select("video_id", F.explode(F.split("content", r"\r\n|\n|\r")).alias("line"))
    time = F.regexp_extract("line", r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    score = F.regexp_extract("line", r"scene(?:_score)?[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    out = lines.select("video_id", time.alias("timestamp"), F.least(F.greatest(F.coalesce(score, F.lit(threshold)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return out.filter("timestamp IS NOT NULL")
