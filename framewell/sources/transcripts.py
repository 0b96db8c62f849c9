"""Transcript text to segments: subtitle cues, inline timestamps, and blocks under timestamp lines.

``raw``: video_id, content. ``segments``: video_id, pos, start, seconds, speaker, text. Lines become rows, and blocks of
lines come from window sums, so any number of transcripts is parsed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewell.functions.time import LINE_TIMESTAMP, format_timestamp, parse_timestamp

#: The forms of cue lines, of lines that begin with their time, and of lines that begin with a speaker.
SRT_CUE = r"^(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})"
VTT_CUE = r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})"
INLINE = r"^\[?((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)\]?\s*(?:-\s*)?(.+)$"
SPEAKER = r"(?s)^([^:]+):\s*(.*)$"


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r\n|\n|\r")


def detect_format(content: Column) -> Column:
    """vtt, srt, inline_bracket, inline_timestamp or multiline, by the first test that holds; null for a blank text."""
    full = F.filter(F.transform(lines_of(content), lambda x: F.trim(x)), lambda x: x != "")
    share = lambda test: F.size(F.filter(full, test)) >= F.size(full) * 0.5
    any_srt = F.exists(lines_of(content), lambda x: x.rlike(r"\d{2}:\d{2}:\d{2},\d{3}\s*-->"))
    out = F.when(F.startswith(F.upper(F.ltrim(content)), F.lit("WEBVTT")), "vtt").when(any_srt, "srt")
    out = out.when(share(lambda x: F.startswith(x, F.lit("["))), "inline_bracket").when(share(lambda x: x.rlike(INLINE)), "inline_timestamp").otherwise("multiline")
    return F.when(F.trim(content) != "", out)


def _split_speaker(line: Column) -> tuple[Column, Column]:
    """Speaker (null without one) and the rest; what looks like a timestamp is no speaker."""
    name = F.trim(F.regexp_extract(line, SPEAKER, 1))
    named = line.rlike(SPEAKER) & (name != "") & ~F.concat(name, F.lit(":00")).rlike(LINE_TIMESTAMP + "$")
    return F.when(named, name), F.when(named, F.trim(F.regexp_extract(line, SPEAKER, 2))).otherwise(line)


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse_transcripts(raw: DataFrame, format_hint: str | None = None) -> DataFrame:
    """All segments of all transcripts, each in its detected or hinted format, ordered in ``pos`` by time and place.

    Lines outside any segment are dropped, and so are segments without dialogue; a transcript without any gives no row.
    """
    fmt = F.lit(format_hint) if format_hint else detect_format(F.col("content"))
    cut = raw.select("video_id", fmt.alias("format"), lines_of(F.col("content")).alias("lines"))  # in a step of its own: once for a text, not for each of its lines
    rows = cut.select("video_id", "format", F.posexplode("lines").alias("n", "line")).withColumn("line", F.trim("line"))
    cue = F.when(F.col("format") == "vtt", F.col("line").rlike(VTT_CUE)).when(F.col("format") == "srt", F.col("line").rlike(SRT_CUE))
    opens = F.coalesce(cue, F.when(F.col("format") == "multiline", F.col("line").rlike(LINE_TIMESTAMP)).otherwise(F.col("line").rlike(INLINE)))
    opens = opens & ((F.col("format") != "inline_bracket") | F.startswith("line", F.lit("[")))
    along = Window.partitionBy("video_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(along)).filter("block > 0")
    inside = Window.partitionBy("video_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("format").isin("vtt", "srt") & ((F.col("line") == "") | F.col("line").rlike(r"^\d+$")) | F.col("format").startswith("inline") & ~F.col("opens")
    rows = rows.withColumn("closed", F.max(ends.cast("int")).over(inside) == 1)
    said = F.array_sort(F.collect_list(F.when(~F.col("opens") & ~F.col("closed") & (F.col("line") != ""), F.struct("n", "line"))))
    blocks = rows.groupBy("video_id", "block", "format").agg(F.min(F.when(F.col("opens"), F.col("line"))).alias("head"), F.min("n").alias("n"), F.transform(said, lambda x: x.line).alias("said"))

    inline_name, inline_text = _split_speaker(F.trim(F.regexp_extract("head", INLINE, 2)))
    joined = F.array_join("said", " ")
    cue_name, cue_text = _split_speaker(joined)

    def step(state: Column, line: Column) -> Column:
        name, text = _split_speaker(line)
        add = lambda s, t: F.struct(s.alias("speaker"), F.array_append(state.said, t).alias("said"))
        fresh = (F.size(state.said) == 0) & name.isNotNull()
        return F.when(fresh & (text == ""), F.struct(name.alias("speaker"), state.said.alias("said"))).when(fresh, add(name, text)).otherwise(add(state.speaker, line))

    blank = F.struct(F.lit(None).cast("string").alias("speaker"), F.array().cast("array<string>").alias("said"))
    folded = F.aggregate("said", blank, step)
    kind = F.col("format")
    start = F.when(kind == "vtt", F.regexp_extract("head", VTT_CUE, 1)).when(kind == "srt", F.regexp_extract("head", SRT_CUE, 1)).when(kind == "multiline", F.regexp_extract("head", LINE_TIMESTAMP, 1)).otherwise(F.regexp_extract("head", INLINE, 1))
    pick = lambda multi, cue, inline: F.when(kind == "multiline", multi).when(kind.isin("vtt", "srt"), cue).otherwise(inline)
    blocks = blocks.withColumn("folded", folded)
    text = _tidy(pick(F.array_join("folded.said", " "), F.coalesce(F.nullif(cue_text, F.lit("")), joined), inline_text))
    out = blocks.select("video_id", "n", "block", parse_timestamp(start).alias("seconds"), pick(F.col("folded.speaker"), cue_name, inline_name).alias("speaker"), text.alias("text")).filter("text <> ''")
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("seconds", "n", "block")) - 1
    return out.select("video_id", pos.cast("long").alias("pos"), format_timestamp(F.col("seconds")).alias("start"), "seconds", "speaker", "text")


def read_transcripts(spark: SparkSession, path: str, format_hint: str | None = None) -> DataFrame:
    """Segments of all text files under ``path``, one transcript a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("video_id"), F.col("value").alias("content"))
    return parse_transcripts(files, format_hint)


def prompt_line() -> Column:
    """``[start] speaker: text`` of a line."""
    return F.concat(F.lit("["), format_timestamp(F.col("seconds")), F.lit("] "), F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), F.col("text"))


def render_for_prompt(segments: DataFrame) -> DataFrame:
    """The lines of each video, in order: video_id, prompt. A video's whole transcript becomes one text, by intent."""
    lists = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seconds", "pos", prompt_line().alias("line")))).alias("lines"))
    return lists.select("video_id", F.array_join(F.transform("lines", lambda x: x.line), "\n").alias("prompt"))


#: Fixed value: a line pasted from a platform's page gives its time as a clock and again in words.
PASTED = r"^(\d+):(\d\d)(?:\d\d seconds|\d+ minutes?, \d+ seconds)(.*)$"


def pasted_lines(raw: DataFrame) -> DataFrame:
    """Lines of transcripts pasted from a platform's page (video_id, content): video_id, n, seconds, text.

    Chapter headings, lines of another form, blank ones and those of only music or laughter go.
    """
    rows = raw.select("video_id", F.posexplode(lines_of(F.col("content"))).alias("n", "line")).withColumn("line", F.trim("line")).filter(F.col("line").rlike(PASTED))
    part = lambda i: F.regexp_extract("line", PASTED, i)
    out = rows.select("video_id", "n", (part(1).cast("long") * 60 + part(2).cast("long")).cast("double").alias("seconds"), F.trim(part(3)).alias("text"))
    return out.filter("text NOT IN ('', '[music]', '[laughter]')")


def tidy_pasted(raw: DataFrame) -> DataFrame:
    """Pasted transcripts with a timestamp at the start of each line: video_id, content. Those without any line are empty."""
    line = F.concat(format_timestamp(F.col("seconds")), F.lit(" "), "text")
    lists = pasted_lines(raw).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n"))
    return raw.select("video_id").distinct().join(lists, "video_id", "left").select("video_id", F.coalesce(text, F.lit("\n")).alias("content"))
