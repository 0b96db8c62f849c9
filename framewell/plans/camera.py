"""Camera paths and crops over time: pursuit, smoothing, panning, resampling, scenes, metrics.

Recurrences are scans over sorted rows (see :func:`framewell.operators.folds.ordered_scan`); the rest is window functions.
``frames``: video_id, frame_number, timestamp, center_x, center_y, zoom and ``near``, whether a scene boundary is near.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.geometry import box, visibility
from framewell.functions.render import even
from framewell.operators.folds import ordered_scan
from framewell.operators.islands import split_runs
from framewell.operators.joins import as_of, look_up

MOTION = "velocity_x double, velocity_y double, zoom_velocity double, acceleration_x double, acceleration_y double, zoom_acceleration double"


def follow(state: dict, x: float, y: float, z: float, t: float, near: int, conf: Settings = DEFAULTS) -> tuple:
    """The camera's next position, zoom and motion for a target, with limited speed; ``state`` is what it remembers."""
    if not state or near:
        moved, velocity, acceleration = (x, y, z), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
    else:
        dt = t - state["t"] if t > state["t"] else 0.5
        px, py, pz = state["at"]
        far = math.hypot(x - px, y - py)
        pan = min(1.0, conf.max_pan_speed * dt / far, conf.camera_smoothing) if far > 0 else 0.0
        rest = abs(z - pz)
        zoom = min(1.0, conf.max_zoom_speed * dt / rest, conf.camera_smoothing) if rest > 0 else 0.0
        moved = (px + (x - px) * pan, py + (y - py) * pan, pz + (z - pz) * zoom)
        velocity = tuple((a - b) / dt for a, b in zip(moved, state["at"], strict=True))
        acceleration = tuple((a - b) / dt for a, b in zip(velocity, state["v"], strict=True))
    state.update(at=moved, v=velocity, t=t)
    return (*moved, *velocity, *acceleration)


def pursue(frames: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Follow each frame's target with limited speed: path_x, path_y, path_zoom and their motion. Near a boundary the camera jumps."""

    def make():
        return partial(follow, {}, conf=conf)

    parts = split_runs(frames, ["video_id"], ["timestamp", "frame_number"], F.col("near") == 1, "_part")  # each jump starts anew, so parts run in parallel
    return ordered_scan(parts, ["video_id", "_part"], ["timestamp", "frame_number"], ["center_x", "center_y", "zoom", "timestamp", "near"], make, "path_x double, path_y double, path_zoom double, " + MOTION).drop("_part")


def ease(state: dict, x: float, y: float, zoom: float, t: float, conf: Settings = DEFAULTS) -> tuple:
    """The smoothed position, zoom and motion for a frame; ``state`` is what is remembered of the frames before."""
    a, target = conf.smoothing_strength, [x, y, zoom]
    if not state:
        at = tuple(a * v + (1.0 - a) * v for v in target)
        state.update(at=at, v=(0.0, 0.0, 0.0), t=t)
        return (*at, *(0.0,) * 6)
    dt = t - state["t"] if t > state["t"] else 0.5
    most = conf.smoothing_max_jerk * dt
    aim = [a * v + (1.0 - a) * p for v, p in zip(target, state["at"], strict=True)]
    turn = (aim[2] - state["at"][2]) / dt
    if state["v"][2] != 0.0 and math.copysign(1.0, turn) != math.copysign(1.0, state["v"][2]):
        aim[2] = state["at"][2] + (aim[2] - state["at"][2]) * conf.zoom_damping
    velocity = [(n - p) / dt for n, p in zip(aim, state["at"], strict=True)]
    velocity = tuple(v if abs(v - before) <= most else before + math.copysign(most, v - before) for v, before in zip(velocity, state["v"], strict=True))
    acceleration = tuple((n - v) / dt for n, v in zip(velocity, state["v"], strict=True))
    at = tuple(p + v * dt for p, v in zip(state["at"], velocity, strict=True))
    state.update(at=at, v=velocity, t=t)
    return (*at, *velocity, *acceleration)


def smooth(frames: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Exponential smoothing of center and zoom with limited changes of velocity: smooth_x, smooth_y, smooth_zoom and motion.

    A zoom that turns back is damped. State starts anew at each part between boundaries, so parts run in parallel.
    """

    def make():
        return partial(ease, {}, conf=conf)

    parts = split_runs(frames, ["video_id"], ["timestamp", "frame_number"], F.col("near") == 1)
    return ordered_scan(parts, ["video_id", "part"], ["timestamp", "frame_number"], ["center_x", "center_y", "zoom", "timestamp"], make, "smooth_x double, smooth_y double, smooth_zoom double, " + MOTION)


def steady(frames: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`smooth` of what :func:`pursue` gives, in one scan: path_x, path_y, path_zoom and motion. Both start anew near boundaries.
    ``jump`` and ``zoomed`` are how far the camera moved and zoomed since the frame before, null at a video's first."""

    def make():
        led: dict = {}
        eased: dict = {}
        last: list = []

        def step(x: float, y: float, zoom: float, t: float, near: int) -> tuple:
            at = follow(led, x, y, zoom, t, near, conf)[:3]
            if near == 1:
                eased.clear()
            out = ease(eased, *at, t, conf)
            dx, dy, dz = (a - b for a, b in zip(out[:3], last, strict=True)) if last else (None,) * 3
            last[:] = out[:3]
            return *out, *((None, None) if dx is None else (math.sqrt(dx * dx + dy * dy), abs(dz)))

        return step

    return ordered_scan(frames, ["video_id"], ["timestamp", "frame_number"], ["center_x", "center_y", "zoom", "timestamp", "near"], make, "path_x double, path_y double, path_zoom double, " + MOTION + ", jump double, zoomed double")


def pan(frames: DataFrame, conf: Settings = DEFAULTS, arranged: bool = False) -> DataFrame:
    """Smooth pan centers: pan_x, pan_y. Small moves are ignored, and a new speaker (``track``) is followed faster. ``arranged``: see
    :func:`framewell.operators.folds.ordered_scan`."""

    def make():
        state: dict = {}

        def step(x: float, y: float, track: str | None) -> tuple:
            ex, ey = state.get("at", (x, y))
            before = state.get("track")
            strength = conf.pan_switch_strength if before is not None and track != before else conf.pan_strength
            x, y = (e if abs(v - e) < conf.pan_deadband else v for v, e in ((x, ex), (y, ey)))
            at = (strength * x + (1.0 - strength) * ex, strength * y + (1.0 - strength) * ey)
            state.update(at=at, track=track)
            return at

        return step

    return ordered_scan(frames, ["video_id"], ["timestamp", "frame_number"], ["center_x", "center_y", "track"], make, "pan_x double, pan_y double", arranged)


def resample(crops: DataFrame, fps: float, conf: Settings = DEFAULTS) -> DataFrame:
    """Crops (video_id, timestamp, x, y, w, h) on a regular grid up to the last one: position between neighbours is linear."""
    ends = crops.groupBy("video_id").agg(F.max("timestamp").alias("last"))
    grid = ends.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") * fps).cast("long"))).alias("n")).withColumn("timestamp", F.col("n") / F.lit(float(fps)))
    rows = crops.select("video_id", "timestamp", F.struct("timestamp", "x", "y", "w", "h").alias("crop"))
    both = look_up(grid, rows, ["video_id"], "timestamp", {"a": ("crop", "backward"), "b": ("crop", "forward")}, bucket=conf.look_up_bucket_seconds)
    t0, t1 = F.col("a.timestamp"), F.col("b.timestamp")
    share = F.when(t1 > t0, (F.col("timestamp") - t0) / (t1 - t0)).otherwise(F.lit(0.0))
    at = lambda v: F.coalesce(F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * share, F.col(f"a.{v}"), F.col(f"b.{v}"))
    return both.select("video_id", "n", "timestamp", at("x").alias("x"), at("y").alias("y"), F.coalesce("a.w", "b.w").alias("w"), F.coalesce("a.h", "b.h").alias("h"))


def crop_segments(crops: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Runs of crops in which each is close to the one before: video_id, start_time, end_time and the first crop."""
    along = Window.partitionBy("video_id").orderBy("timestamp", "frame_number")
    before = F.lag(F.struct("x", "y", "w", "h")).over(along)
    away = F.sqrt((F.col("x") - before.x) * (F.col("x") - before.x) + (F.col("y") - before.y) * (F.col("y") - before.y))
    same = (F.abs(F.col("w") - before.w) < 0.5) & (F.abs(F.col("h") - before.h) < 0.5)
    gap = away + F.when(same, F.lit(0.0)).otherwise(F.abs(F.col("w") - before.w))
    marked = crops.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).withColumn("gap", gap)
    parts = split_runs(marked, ["video_id"], ["timestamp", "frame_number"], F.col("gap") > conf.segment_merge_threshold)
    heads = parts.groupBy("video_id", "part", "n").agg(F.min(F.struct("timestamp", "frame_number", "x", "y", "w", "h")).alias("c"), F.max("timestamp").alias("last"))
    end = F.coalesce(F.lead("c.timestamp").over(Window.partitionBy("video_id").orderBy("part")), F.col("last") + F.lit(1.0) / F.greatest(F.lit(1.0), F.col("n")))
    return heads.select("video_id", F.col("c.timestamp").alias("start_time"), end.alias("end_time"), "c.x", "c.y", "c.w", "c.h")


def pan_commands(crops: DataFrame) -> DataFrame:
    """Renderer commands of each video, one line for each rounded x or y that changes: video_id, commands."""
    along = Window.partitionBy("video_id").orderBy("timestamp", "frame_number")
    rows = crops.withColumn("px", F.greatest(F.lit(0), F.bround("x", 0).cast("long"))).withColumn("py", F.greatest(F.lit(0), F.bround("y", 0).cast("long")))
    changed = lambda c: F.when(F.lag(c).over(along).isNull() | (F.lag(c).over(along) != F.col(c)), F.concat(F.format_string("%.3f", "timestamp"), F.lit(f" crop {c[1]} "), F.col(c).cast("string"), F.lit(";")))
    rows = rows.select("video_id", "timestamp", "frame_number", F.array_compact(F.array(changed("px"), changed("py"))).alias("lines")).filter("size(lines) > 0")
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "frame_number", "lines"))).alias("l"))
    return lists.select("video_id", F.array_join(F.flatten(F.transform("l", lambda x: x.lines)), "\n").alias("commands"))


def scene_cuts(histograms: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Boundaries between frames whose histograms (shares per bin) differ by at least the threshold: timestamp, confidence.

    Histograms of a video with unequal numbers of bins are an error."""
    along = Window.partitionBy("video_id").orderBy("timestamp")
    before = F.lag("histogram").over(along)
    apart = F.aggregate(F.zip_with("histogram", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2
    apart = F.when(F.size("histogram") != F.size(before), F.raise_error(F.lit("histograms of unequal sizes"))).otherwise(apart)
    return histograms.withColumn("confidence", apart).filter(F.col("confidence") >= conf.scene_threshold).select("video_id", "timestamp", "confidence")


def merge_boundaries(boundaries: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Boundaries (video_id, timestamp, confidence) so that close ones are one, the more confident: it becomes what the next is
    compared with. A scan numbers the groups of close ones and marks each that takes the lead of its group; the last does."""

    def make():
        state: dict = {"group": 0}

        def step(at: float, confidence: float) -> tuple:
            last = state.get("last")
            if last is not None and at - last[0] < conf.scene_min_gap:
                leads = confidence > last[1]
            else:
                leads = True
                state["group"] += 1
            if leads:
                state["last"] = (at, confidence)
            return state["group"], leads

        return step

    rows = boundaries.select("video_id", "timestamp", "confidence")
    seen = ordered_scan(rows, ["video_id"], ["timestamp", "confidence"], ["timestamp", "confidence"], make, "group long, leads boolean")
    last = seen.filter("leads").groupBy("video_id", "group").agg(F.max(F.struct("timestamp", "confidence")).alias("b"))
    return last.select("video_id", "b.timestamp", "b.confidence")


def scene_segments(boundaries: DataFrame, durations: DataFrame) -> DataFrame:
    """Scenes between boundaries: video_id, index, start_seconds, end_seconds. Empty ones go, numbers stay."""
    long = durations.filter("duration > 0")
    points = boundaries.select("video_id", "timestamp").join(long.select("video_id"), "video_id", "left_semi").withColumn("side", F.lit(1))
    points = points.unionByName(long.select("video_id", F.lit(0.0).alias("timestamp"), F.lit(0).alias("side"))).unionByName(long.select("video_id", F.col("duration").alias("timestamp"), F.lit(2).alias("side")))
    along = Window.partitionBy("video_id").orderBy("side", "timestamp")
    out = points.select("video_id", (F.row_number().over(along) - 1).cast("long").alias("index"), F.col("timestamp").alias("start_seconds"), F.lead("timestamp").over(along).alias("end_seconds"))
    return out.filter("end_seconds > start_seconds")


def near_boundaries(frames: DataFrame, boundaries: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``frames`` (video_id, timestamp) with ``near``: 1 if a boundary (video_id, timestamp) is at most the tolerance away, else 0."""
    cuts = boundaries.select("video_id", "timestamp", F.col("timestamp").alias("cut"))
    both = look_up(frames, cuts, ["video_id"], "timestamp", {"_before": ("cut", "backward"), "_after": ("cut", "forward")}, bucket=conf.look_up_bucket_seconds)
    away = F.least(F.col("timestamp") - F.col("_before"), F.col("_after") - F.col("timestamp"))
    return both.withColumn("near", F.coalesce(away <= conf.boundary_tolerance, F.lit(False)).cast("int")).drop("_before", "_after")


def scene_at(frames: DataFrame, scenes: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``frames`` (video_id, timestamp) with ``scene``, the index of the scene that holds the time; past the last one's end the last."""
    along = Window.partitionBy("video_id").orderBy("start_seconds")
    spans = scenes.select("video_id", F.col("start_seconds").alias("timestamp"), F.col("index").alias("scene"), "end_seconds", F.lead("index").over(along).isNull().alias("_last"))
    out = as_of(frames, spans, ["video_id"], "timestamp", ["scene", "end_seconds", "_last"], bucket=conf.look_up_bucket_seconds)
    return out.withColumn("scene", F.when((F.col("timestamp") < F.col("end_seconds")) | F.col("_last"), F.col("scene"))).drop("matched_timestamp", "end_seconds", "_last")


def fixed_size(crops: DataFrame) -> DataFrame:
    """Per video the even width and height of its crops if all have the same, else nulls: video_id, w, h."""
    sizes = crops.select("video_id", even(F.col("w")).alias("w"), even(F.col("h")).alias("h")).groupBy("video_id")
    found = sizes.agg(F.min("w").alias("w"), F.max("w").alias("w2"), F.min("h").alias("h"), F.max("h").alias("h2"))
    same = (F.col("w") == F.col("w2")) & (F.col("h") == F.col("h2"))
    return found.select("video_id", F.when(same, F.col("w")).alias("w"), F.when(same, F.col("h")).alias("h"))


def render_times(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Crop segments with the times at which they are rendered: none before 0, none shorter than a twentieth of a second, and
    the last reaches the video's end. ``durations``: video_id, duration; without one the last ends as it does."""
    along = Window.partitionBy("video_id").orderBy("start_time")
    last = F.lead("start_time").over(along).isNull()
    start = F.greatest(F.lit(0.0), F.col("start_time"))
    out = segments.withColumn("last", last).withColumn("start_time", start).withColumn("end_time", F.greatest(F.col("start_time") + 0.05, F.col("end_time")))
    out = out.join(durations.select("video_id", "duration"), "video_id", "left")
    return out.withColumn("end_time", F.when(F.col("last"), F.greatest("end_time", "duration")).otherwise(F.col("end_time"))).drop("last", "duration")


def visibility_metrics(crops: DataFrame, faces: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """How well the crops (video_id, frame_number, x, y, w, h) of each video show its faces: average_visibility (0 without any),
    clipped_percent of faces shown to less than the threshold, average_empty_space (1 for a frame without faces), frames, faces."""
    seen = faces.groupBy("video_id", "frame_number").agg(F.collect_list(box(*map(F.col, "xywh"))).alias("boxes"))
    rows = crops.select("video_id", "frame_number", box(*map(F.col, "xywh")).alias("crop")).join(seen, ["video_id", "frame_number"], "left")
    return shown_metrics(rows, [], conf)


def shown_metrics(rows: DataFrame, more: list[Column], conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`visibility_metrics` of frames with ``crop`` and the ``boxes`` of their faces (null without any), and the aggregates
    ``more`` of the same rows."""
    rows = rows.withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<x: double, y: double, w: double, h: double>>")))
    area = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b.w * b.h)
    empty = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), F.col("crop.w") * F.col("crop.h"))))
    rows = rows.withColumns({"share": F.transform("boxes", lambda b: visibility(F.col("crop"), b)), "empty": empty})
    low = F.size(F.filter("share", lambda v: v < conf.visibility_threshold))
    per = rows.groupBy("video_id").agg(F.avg("empty").alias("average_empty_space"), F.sum(F.aggregate("share", F.lit(0.0), lambda a, v: a + v)).alias("_seen"), F.sum(F.size("share")).alias("face_frame_count"), F.sum(low).alias("_low"), F.count("*").alias("frame_count"), *more)
    of = lambda v: F.coalesce(F.try_divide(v, F.col("face_frame_count")), F.lit(0.0))
    rest = per.columns[6:]
    return per.select("video_id", of(F.col("_seen")).alias("average_visibility"), (of(F.col("_low")) * 100).alias("clipped_percent"), "average_empty_space", "frame_count", "face_frame_count", *rest)


def path_metrics(path: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Per video: how far the camera moved, its jitter, and its jumps away from boundaries. ``path`` has motion columns and near."""
    along = Window.partitionBy("video_id").orderBy("timestamp", "frame_number")
    step = lambda c: F.col(c) - F.lag(c).over(along)
    rows = path.withColumn("jump", F.sqrt(step("path_x") * step("path_x") + step("path_y") * step("path_y"))).withColumn("zoomed", F.abs(step("path_zoom")))
    return rows.groupBy("video_id").agg(*travelled(conf), F.count("*").alias("n_frames"))


def travelled(conf: Settings = DEFAULTS) -> list[Column]:
    """Aggregates of a path's rows with ``jump`` and ``zoomed`` (see :func:`steady`): movement, jitter and cuts."""
    jitter = F.when(F.col("jump").isNotNull(), F.sqrt(F.col("acceleration_x") ** 2 + F.col("acceleration_y") ** 2) + F.abs("zoom_acceleration"))
    cut = (F.col("near") == 0) & ((F.col("jump") > conf.cut_pixels) | (F.col("zoomed") > conf.cut_zoom))
    return [F.coalesce(F.sum("jump"), F.lit(0.0)).alias("movement"), F.coalesce(F.sum(jitter), F.lit(0.0)).alias("jitter"), F.count_if(cut).alias("cuts")]


def audio_energy(samples: DataFrame, size: int) -> DataFrame:
    """Root mean square of each ``size`` samples (video_id, n, value), relative to the video's loudest: window, energy."""
    rms = samples.groupBy("video_id", F.floor(F.col("n") / size).alias("window")).agg((F.sqrt(F.avg(F.col("value") * F.col("value"))) / 32768).alias("rms"))
    peak = F.max("rms").over(Window.partitionBy("video_id"))
    return rms.select("video_id", "window", F.when(peak > 0, F.col("rms") / peak).otherwise(F.lit(0.0)).alias("energy"))
