"""The reframing chain: from tracked faces, speech and sound to crops and their metrics, for any number of videos in one plan.

``frames``: video_id, frame_number, timestamp of all frames, those without faces included. ``faces``: see
:mod:`framewell.plans.people`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions import geometry as G
from framewell.operators.store import StageGraph
from framewell.plans import camera, crops, people

FRAME = ["video_id", "frame_number"]


def speech_windows(segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Spoken spans of transcript lines: video_id, timestamp, speech_end, speaker.

    A line is spoken until the next one starts; the last one until the video ends (``durations``: video_id, duration) but a
    second at least, or as long as its words take. One that would not last gets half a second.
    """
    along = Window.partitionBy("video_id").orderBy("seconds", "pos")
    lines = segments if durations is None else segments.join(durations.select("video_id", "duration"), "video_id", "left")
    duration = F.lit(None).cast("double") if durations is None else F.col("duration")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    start = F.col("seconds")
    end = F.coalesce(F.lead("seconds").over(along), F.when(duration.isNotNull(), F.greatest(start + 1.0, duration)), start + F.greatest(F.lit(2.0), words * 0.35))
    return lines.select("video_id", start.alias("timestamp"), F.when(end <= start, start + 0.5).otherwise(end).alias("speech_end"), "speaker")


def composition(frames: DataFrame, ranked: DataFrame, rapid: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """``frames`` with shot_type, targets, reason, zoom_multiplier and the framing of the targets: center_x, center_y, zoom (its
    width) and crop_height. ``ranked``: faces as :func:`framewell.plans.people.importance` gives them. A frame without faces is
    a wide shot of the whole picture."""
    return compose(frames, people.by_frame(ranked), rapid, width, height, conf)


def compose(frames: DataFrame, seen: DataFrame, rapid: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`composition` from the faces of each frame, see :func:`framewell.plans.people.by_frame`."""
    out = frames.join(shot_frames(seen, rapid, width, height, conf).drop("f"), FRAME, "left")
    shot = F.coalesce("shot_type", F.lit("wide_table"))
    out = out.withColumns({"targets": F.coalesce("targets", F.array().cast("array<string>")), "reason": F.coalesce("reason", F.lit("no visible faces; default wide framing")), "zoom_multiplier": people.zoom_of(shot, conf), "shot_type": shot})
    out = out.withColumn("aim", F.coalesce("aim", whole_frame(width, height, conf)))
    return out.select(*frames.columns, "shot_type", "targets", "reason", "zoom_multiplier", F.col("aim.cx").alias("center_x"), F.col("aim.cy").alias("center_y"), F.col("aim.w").alias("zoom"), F.col("aim.h").alias("crop_height"))


def _framing(boxes: Column, width: float, height: float, zoom: Column, conf: Settings) -> Column:
    return G.framing(boxes, F.lit(width), F.lit(height), conf.target_aspect, conf.min_padding, conf.forehead_ratio, conf.thirds_offset, zoom)


def whole_frame(width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> Column:
    """The framing of a frame without faces."""
    return _framing(F.array().cast("array<struct<x: double, y: double, w: double, h: double>>"), width, height, people.zoom_of(F.lit("wide_table"), conf), conf)


def shot_frames(seen: DataFrame, rapid: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """Shots (see :func:`framewell.plans.people.frame_shots`) with ``aim``, the framing of their targets. Frames are framed before they
    meet others, so that only what is asked for goes on and not the faces."""
    shots = people.frame_shots(seen, rapid, conf)
    chosen = F.transform(F.filter("f", lambda f: F.array_contains(F.col("targets"), f.track_id)), lambda f: f.b)
    return shots.withColumn("aim", _framing(chosen, width, height, people.zoom_of(F.col("shot_type"), conf), conf))


def rank_faces(faces: DataFrame, speech: DataFrame, energy: DataFrame, conf: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Faces with speaker and importance, and which videos are a rapid discussion at their end."""
    scored = people.speaker_scores(people.signals(faces, speech, energy, conf=conf), conf)
    return people.importance(people.recent_speaker(scored, conf), conf), people.rapid_discussion(people.speaker_segments(scored, conf), conf)


def camera_path(plan: DataFrame, boundaries: DataFrame | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """The smoothed path of a composition: path_x, path_y, path_zoom and motion. The camera jumps near scene boundaries;
    without ``boundaries`` the plan says in ``near`` where these are."""
    aims = plan if boundaries is None else camera.near_boundaries(plan, boundaries, conf)
    return camera.steady(aims.select("video_id", "frame_number", "timestamp", "near", "center_x", "center_y", "zoom"), conf).drop("center_x", "center_y", "zoom")


def aimed(marked: DataFrame, seen: DataFrame, rapid: DataFrame, conf: Settings = DEFAULTS, boxes: bool = False) -> DataFrame:
    """``marked`` (frames with ``near``) with the framing of their shots and with ``held`` (see :func:`framewell.plans.crops.held`), one
    short row each, and the boxes of their faces if asked for. ``seen``: see :func:`framewell.plans.people.by_frame`."""
    extra = [F.transform("f", lambda f: f.b).alias("boxes")] if boxes else []
    found = shot_frames(seen, rapid, conf=conf).select(*FRAME, "aim", crops.held(conf).alias("held"), *extra)
    out = marked.join(found, FRAME, "left").withColumn("aim", F.coalesce("aim", whole_frame(conf=conf)))
    return out.select(*FRAME, "timestamp", "near", F.col("aim.cx").alias("center_x"), F.col("aim.cy").alias("center_y"), F.col("aim.w").alias("zoom"), *[c for c in ("held", "boxes") if c in out.columns])


def crop_plan(aims: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Crops of each frame that follow the speaker without jerks, from what :func:`aimed` gives: video_id, frame_number, timestamp,
    ``crop``, track, and the camera's path. Rows are sorted by video once; path, crops and panning pass them on as they are."""
    path = camera.steady(aims, conf).drop("zoom").withColumns({"center_x": F.col("path_x"), "center_y": F.col("path_y")})
    made = crops.place(path, conf=conf)
    made = made.withColumns({"center_x": F.col("crop.x") + F.col("crop.w") / 2, "center_y": F.col("crop.y") + F.col("crop.h") / 2})
    panned = camera.pan(made, conf, arranged=True)
    crop = G.box(F.col("pan_x") - F.col("crop.w") / 2, F.col("pan_y") - F.col("crop.h") / 2, F.col("crop.w"), F.col("crop.h"))
    return panned.withColumn("crop", crop).drop("center_x", "center_y", "pan_x", "pan_y")


def reframe(frames: DataFrame, faces: DataFrame, speech: DataFrame, energy: DataFrame, boundaries: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The crop of each frame, from tracked faces on: speakers, importance, shots, framing, pursuit, smoothing and panning."""
    return stages(frames, faces, speech, energy, boundaries, conf).results("crops")[0]


def metrics(made: DataFrame, faces: DataFrame, path: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """All metrics of a reframed video: how its faces are shown (see :func:`framewell.plans.camera.visibility_metrics`), and how
    the camera moved. ``path`` has motion and ``near``; its jumps away from boundaries are unnecessary cuts."""
    return camera.visibility_metrics(made, faces, conf).join(camera.path_metrics(path, conf).drop("n_frames"), "video_id", "left")


def stages(frames: DataFrame, faces: DataFrame, speech: DataFrame, energy: DataFrame, boundaries: DataFrame, conf: Settings = DEFAULTS) -> StageGraph:
    """The chain as a graph: ``scored``, ``runs`` (of frames with one speaker), ``ranked``, ``rapid``, ``seen`` (ranked faces by frame),
    ``shots``, ``marked`` (frames near boundaries), ``composition``, ``path``, ``crops`` and ``metrics``. What the results asked for have
    in common is worked out once (see :mod:`framewell.operators.store`); the inputs are stored too, since look-ups read theirs twice.
    Crops and metrics come from one sort of short rows by video each, and store no path."""
    graph = StageGraph(frames.sparkSession, conf)
    for name, df in (("frames", frames), ("faces", faces), ("speech", speech), ("energy", energy), ("boundaries", boundaries)):
        graph.input(name, df, keep=True)
    needed = [*FRAME, "timestamp", people.BUCKET, "track_id", *"xywh", "confidence", "expression", "presence", "center", "speaker_score", "active"]
    graph.stage("scored", lambda f, s, e: people.speaker_scores(people.signals(f, s, e, conf=conf), conf).select(*needed), "faces", "speech", "energy")
    graph.stage("runs", people.speaker_runs, "scored")
    graph.stage("ranked", lambda s, r: people.importance(people.recent_speaker(s, conf, r), conf), "scored", "runs")
    graph.stage("rapid", lambda s, r: people.rapid_discussion(people.speaker_segments(s, conf, r), conf), "scored", "runs")
    graph.stage("seen", people.by_frame, "ranked", keep=True)
    graph.stage("shots", lambda f, q: people.frame_shots(f, q, conf).drop("f"), "seen", "rapid")
    graph.stage("marked", lambda f, b: camera.near_boundaries(f, b, conf), "frames", "boundaries")
    graph.stage("composition", lambda m, f, q: compose(m, f, q, conf=conf), "marked", "seen", "rapid")
    graph.stage("path", lambda c: camera_path(c, conf=conf), "composition")
    graph.stage("crops", lambda m, f, q: crop_plan(aimed(m, f, q, conf), conf).select(*FRAME, "timestamp", "crop.*", "track"), "marked", "seen", "rapid")
    return graph.stage("metrics", lambda m, f, q: camera.shown_metrics(crop_plan(aimed(m, f, q, conf, boxes=True), conf), camera.travelled(conf), conf), "marked", "seen", "rapid")
