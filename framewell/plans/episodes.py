"""The export of episodes from end to end: ranking, quality, cut list, subtitles, metadata, analysis, report and manifest.

All episodes are exported in one job. A file is a row (name, content); names lie in one folder for each episode, as
:data:`LAYOUT` says. What needs a renderer (cutting, cropping, burning in) is left to it; the manifest has the names that
its output takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.operators.store import StageGraph
from framewell.plans import export, quality, ranking, subtitles
from framewell.sources.files import indented, write_files

#: The folders and files of an episode; ``{}`` is a clip's number.
LAYOUT = {"video": "clips/clip{}.mp4", "vertical": "reframe/clip{}_vertical.mp4", "subtitles": "subtitles/clip{}.srt", "metadata": "metadata/clip{}_metadata.json", "metrics": "reframe/clip{}_metrics.json", "analysis": "analysis.json", "report": "report.md", "manifest": "manifest.json"}


def file_name(episode: Column, kind: str, index: Column | None = None) -> Column:
    """The name of an episode's file of a kind, below the folder of all episodes."""
    head, _, tail = LAYOUT[kind].partition("{}")
    parts = [F.lit(head), index.cast("string"), F.lit(tail)] if tail else [F.lit(head)]
    return F.concat(episode, F.lit("/"), *parts)


def chosen(clips: DataFrame, segments: DataFrame, top_n: int | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """The ranked clips with ``passed`` and ``issues`` of their checks. ``pos`` is the place in the ranking, which the check of
    repeated dialogue goes by, and ``source_pos`` what it was."""
    ranked = ranking.rank_clips(clips, segments, top_n, conf).withColumn("source_pos", F.col("pos")).withColumn("pos", F.col("rank"))
    checks = quality.check_quality(ranked, segments, conf).select("video_id", "pos", "passed", "issues")
    return ranked.join(checks, ["video_id", "pos"])


def cut_list(found: DataFrame, episodes: DataFrame) -> DataFrame:
    """The clips that passed and end within their episode, with ``index`` from 1 among these."""
    return export.cuttable(found.filter("passed").drop("passed", "issues"), episodes)


def manifests(episodes: DataFrame, clips: DataFrame, found: DataFrame, cut: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Per episode its counts, rejections and bundles: video_id, clips_analyzed, clips_ranked, clips_rejected, clips_exported,
    manifest (JSON). An episode without clips has none of each."""
    count = lambda df, name, what=F.lit(1): df.groupBy("video_id").agg(F.count(what).alias(name))
    told = found.groupBy("video_id").agg(F.count("*").alias("clips_ranked"), F.count_if(~F.col("passed")).alias("clips_rejected"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(F.col("pos").alias("rank"), "issues")))).alias("quality_rejections"))
    name = F.col("episode")
    bundled = cut.join(episodes.select("video_id", "episode"), "video_id")
    if metadata is None:
        bundled = bundled.withColumn("metadata", F.lit(None).cast("string"))
    else:
        there = metadata.select("video_id", F.col("pos").alias("source_pos"), F.lit(True).alias("has"))
        bundled = bundled.join(there, ["video_id", "source_pos"], "left").withColumn("metadata", F.when(F.col("has"), file_name(name, "metadata", F.col("index"))))
    item = F.struct("index", "rank", "start_seconds", "end_seconds", "rank_score", *[file_name(name, k, F.col("index")).alias(k) for k in ("video", "vertical", "subtitles")], "metadata")
    bundles = bundled.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("clips"))
    out = reduce(lambda a, b: a.join(b, "video_id", "left"), [episodes, count(clips, "clips_analyzed"), told, count(cut, "clips_exported"), bundles])
    counts = ["clips_analyzed", "clips_ranked", "clips_rejected", "clips_exported"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    body = F.struct(F.col("source").alias("source_video"), F.col("transcript").alias("transcript_source"), *counts, none("quality_rejections"), none("clips"))
    return out.select("video_id", "episode", "source", "transcript", *counts, F.to_json(body, {"ignoreNullFields": "false"}).alias("manifest"))


def stages(episodes: DataFrame, clips: DataFrame, segments: DataFrame, windows: DataFrame | None = None, metadata: DataFrame | None = None, metrics: DataFrame | None = None, top_n: int | None = None, conf: Settings = DEFAULTS) -> StageGraph:
    """The export as a graph: ``found``, ``cut``, ``manifests`` and ``files`` (name, content).

    ``episodes``: video_id, episode (its folder), source, transcript, duration. ``clips``, ``segments``: see
    :mod:`framewell.plans.ranking`. ``windows``: candidate windows, for analysis and report. ``metadata``: video_id, pos of a
    clip and further columns. ``metrics``: one row for each video and clip (video_id, pos of the source clip, further columns).
    """
    graph = StageGraph(clips.sparkSession, (conf, top_n))
    for name, df in (("episodes", episodes), ("clips", clips), ("segments", segments), ("windows", windows), ("metadata", metadata), ("metrics", metrics)):
        if df is not None:
            graph.input(name, df)
    graph.stage("found", lambda c, s: chosen(c, s, top_n, conf), "clips", "segments")
    graph.stage("cut", cut_list, "found", "episodes")
    graph.stage("manifests", lambda e, c, f, k, *m: manifests(e, c, f, k, *m), "episodes", "clips", "found", "cut", *["metadata"] * (metadata is not None))
    extra = [n for n in ("windows", "metadata", "metrics") if n in graph.inputs]
    return graph.stage("files", lambda m, k, s, *rest: files(m, k, s, **dict(zip(extra, rest, strict=True)), conf=conf), "manifests", "cut", "segments", *extra)


def files(made: DataFrame, cut: DataFrame, segments: DataFrame, windows: DataFrame | None = None, metadata: DataFrame | None = None, metrics: DataFrame | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """The text files of all episodes (see :data:`LAYOUT`) from their manifests and cut lists: name, content."""
    episode, name = made.select("video_id", "episode"), F.col("episode")
    numbered = cut.select("video_id", "source_pos", "index").join(episode, "video_id")
    spans = cut.select("video_id", F.col("index").alias("pos"), "start_seconds", "end_seconds")
    texts = subtitles.srt_files(subtitles.clip_cues(spans, segments, conf=conf))
    silent = spans.join(texts, ["video_id", "pos"], "left").join(episode, "video_id")
    out = [silent.select(file_name(name, "subtitles", F.col("pos")).alias("name"), F.coalesce("content", F.lit("")).alias("content"))]
    for kind, table in (("metadata", metadata), ("metrics", metrics)):
        if table is not None:
            fields = [c for c in table.columns if c not in ("video_id", "pos")]
            rows = numbered.join(table.withColumnRenamed("pos", "source_pos"), ["video_id", "source_pos"])
            fields = ["index", *fields] if kind == "metadata" else fields
            out.append(rows.select(file_name(name, kind, F.col("index")).alias("name"), indented(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("content")))
    told = made.select("video_id", "source", "transcript", F.col("clips_exported").alias("n_clips"))
    if windows is not None:
        body = F.concat(F.lit('{"segment_count":'), F.col("segment_count").cast("string"), F.lit(',"candidate_windows":'), "candidate_windows", F.lit("}"))
        analyzed = export.analysis(segments, windows).join(episode, "video_id")
        out.append(analyzed.select(file_name(name, "analysis").alias("name"), indented(body).alias("content")))
    else:
        windows = segments.sparkSession.createDataFrame([], "video_id long, rank long, start_seconds double, end_seconds double, score double, labels array<string>")
    out.append(export.reports(told, windows).join(episode, "video_id").select(file_name(name, "report").alias("name"), F.col("report").alias("content")))
    out.append(made.select(file_name(name, "manifest").alias("name"), indented(F.col("manifest")).alias("content")))
    return reduce(DataFrame.unionByName, out)


def export_episodes(path: str, graph: StageGraph, overwrite: bool = False) -> DataFrame:
    """Write the files of ``graph`` (see :func:`stages`) below ``path``; the manifests are returned."""
    made, listed = graph.results("manifests", "files")
    write_files(listed, path, overwrite)
    return made
