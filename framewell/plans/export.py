"""What leaves the pipeline as text: clip prompts, filled templates, metadata files and episode reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.time import format_timestamp
from framewell.operators.joins import contained
from framewell.sources.files import write_files
from framewell.sources.transcripts import prompt_line

#: Names of templates that have been renamed.
RENAMED = {"clip_selection": "clip_analysis", "metadata_generation": "metadata"}


def clip_prompts(clips: DataFrame, segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The transcript of each clip, the lines that start in it: video_id, pos, prompt. A clip without lines has an empty one."""
    spans = clips.select("video_id", "pos", "start_seconds", "end_seconds")
    lines = segments.select("video_id", F.col("pos").alias("line"), "seconds", "speaker", "text")
    met = contained(spans, lines, ["video_id"], "start_seconds", "end_seconds", "seconds", bucket=conf.join_bucket_seconds)
    told = met.select("s.video_id", "s.pos", F.struct("seconds", "line", prompt_line().alias("text")).alias("x")).groupBy("video_id", "pos").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x.text), "\n")
    return spans.select("video_id", "pos").join(told, ["video_id", "pos"], "left").select("video_id", "pos", F.coalesce(text, F.lit("")).alias("prompt"))


def cuttable(clips: DataFrame, durations: DataFrame) -> DataFrame:
    """Clips that end within their video (durations: video_id, duration), with ``index`` from 1 among those."""
    kept = clips.join(durations.select("video_id", "duration"), "video_id").filter("end_seconds <= duration").drop("duration")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("pos")).cast("long"))


def template_name(name: Column) -> Column:
    """A template's current name."""
    out = name
    for old, new in RENAMED.items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with each ``{{name}}`` replaced, in the order of ``values``; a name without a value stays."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def listed(setting: Column, fallback: list[str] | None = None, lower: bool = False) -> Column:
    """The items of a comma-separated setting, trimmed and without blank ones; ``fallback`` if there are none."""
    items = F.filter(F.transform(F.split(setting, ","), lambda x: F.lower(F.trim(x)) if lower else F.trim(x)), lambda x: x != "")
    return items if fallback is None else F.when(F.size(items) > 0, items).otherwise(F.array(*map(F.lit, fallback)))


def metadata_files(metadata: DataFrame) -> DataFrame:
    """One JSON text for each clip (video_id, index, further columns): video_id, index, name, content. json_path is left out."""
    fields = [c for c in metadata.columns if c not in ("video_id", "json_path")]
    return metadata.select("video_id", "index", F.format_string("clip%d_metadata.json", "index").alias("name"), F.to_json(F.struct(*fields)).alias("content"))


def write_metadata(metadata: DataFrame, path: str) -> None:
    """A file for each clip under ``path``: ``<video_id>-clip<index>_metadata.json``."""
    name = F.concat(F.col("video_id").cast("string"), F.lit("-"), "name")
    write_files(metadata_files(metadata).select(name.alias("name"), "content"), path)


def analysis(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Per video the number of its lines and its candidate windows as JSON: video_id, segment_count, candidate_windows."""
    counts = segments.groupBy("video_id").agg(F.count("*").alias("segment_count"))
    item = F.struct("rank", "start_seconds", "end_seconds", "score", "labels")
    lists = windows.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("w"))
    return counts.join(lists, "video_id", "left").select("video_id", "segment_count", F.to_json(F.coalesce("w", F.array())).alias("candidate_windows"))


def reports(episodes: DataFrame, windows: DataFrame) -> DataFrame:
    """A report in Markdown of each episode (video_id, source, transcript, n_clips): video_id, report."""
    labels = F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise(F.lit("candidate"))
    line = F.format_string("- `%s` → `%s` score %.1f (%s)", format_timestamp(F.col("start_seconds")), format_timestamp(F.col("end_seconds")), "score", labels)
    lists = windows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("w"))
    head = F.array(F.lit("# Episode Export Report"), F.lit(""), F.format_string("- Source video: `%s`", "source"), F.format_string("- Transcript: `%s`", "transcript"), F.format_string("- Clips exported: %d", "n_clips"), F.lit(""))
    body = F.coalesce(F.concat(F.array(F.lit("## Candidate Windows"), F.lit("")), F.transform("w", lambda x: x.line), F.array(F.lit(""))), F.array().cast("array<string>"))
    return episodes.join(lists, "video_id", "left").select("video_id", F.array_join(F.concat(head, body), "\n").alias("report"))
