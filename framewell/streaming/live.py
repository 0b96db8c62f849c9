"""Streaming twins of operators on media time, for transcripts and signals that arrive while a video runs.

``at`` is the event time of a row. State is bounded by the watermark; later rows are dropped, as the watermark says.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewell.config import DEFAULTS, Settings
from framewell.plans.camera import MOTION, follow
from framewell.plans.tracking import Tracker


def live_windows(lines: DataFrame, watermark: str = "10 minutes", conf: Settings = DEFAULTS) -> DataFrame:
    """Lines (video_id, at, text) per overlapping window, by the time they start: unlike
    :func:`framewell.plans.windows.window_lines` a line does not reach into the window after its own."""
    size, stride = (f"{int(x)} seconds" for x in (conf.window_seconds, conf.window_seconds - conf.window_overlap_seconds))
    grouped = lines.withWatermark("at", watermark).groupBy("video_id", F.window("at", size, stride))
    return grouped.agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def live_islands(signals: DataFrame, watermark: str = "1 minute", conf: Settings = DEFAULTS) -> DataFrame:
    """Signals (video_id, at, seconds, score) joined while the next starts before a gap after the last one's end has passed.
    A start exactly at the end of the gap opens a new island here, while the batch operator still joins it."""
    gap = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, seconds + {conf.candidate_merge_gap}e0)")
    grouped = signals.withWatermark("at", watermark).groupBy("video_id", F.session_window("at", gap))
    return grouped.agg(F.max("score").alias("score"), F.count("*").alias("n_signals"))


def live_energy(samples: DataFrame, watermark: str = "10 seconds", conf: Settings = DEFAULTS) -> DataFrame:
    """Root mean square of audio samples (video_id, at, value) per window."""
    width = f"{int(conf.audio_window_seconds * 1000)} milliseconds"
    return samples.withWatermark("at", watermark).groupBy("video_id", F.window("at", width)).agg((F.sqrt(F.avg(F.col("value") * F.col("value"))) / 32768).alias("rms"))


def first_dialogue(clips: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first clip (video_id, fingerprint, at) of each dialogue, once the other checks have passed."""
    return clips.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["video_id", "fingerprint"])


def live_scan(frames: DataFrame, step: Callable[[dict, tuple], Iterable[tuple]], out: str, watermark: str, idle_seconds: int) -> DataFrame:
    """A recurrence over each video's frames (video_id, at, timestamp, further columns) as they come.

    ``step`` is called with the video's state, a dict that JSON can hold and that is empty at first, and a frame; it gives rows
    of ``out`` after video_id and timestamp. A video's state goes when the watermark is ``idle_seconds`` past its last frame.
    Frames of one trigger are taken in order of time; one that is not later than a frame of an earlier trigger is dropped,
    since its successors have been given out.
    """
    schema = f"video_id long, timestamp double, {out}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, last, latest = state.get if state.exists else ("{}", None, 0)
        held, made, rows = json.loads(text), [], pd.concat(list(chunks)).sort_values("timestamp", kind="stable")
        if last is not None:
            rows = rows[rows["timestamp"] > last]
        for row in rows.itertuples():
            made += [(key[0], row.timestamp, *x) for x in step(held, row)]
        if len(rows):
            last = float(rows["timestamp"].max())
            latest = max(latest, int(rows["at"].max().timestamp() * 1000))
        latest = max(latest, state.getCurrentWatermarkMs())
        state.update((json.dumps(held), last, latest))
        state.setTimeoutTimestamp(latest + idle_seconds * 1000)
        yield pd.DataFrame(made, columns=names)

    keyed = frames.withWatermark("at", watermark).groupBy("video_id")
    return keyed.applyInPandasWithState(run, schema, "held string, last double, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def live_pan(frames: DataFrame, watermark: str = "1 minute", idle_seconds: int = 600, conf: Settings = DEFAULTS) -> DataFrame:
    """Pan centers (video_id, at, timestamp, center_x, center_y, track) smoothed as they come: see :func:`live_scan`."""

    def step(held: dict, row: tuple) -> list[tuple]:
        x, y = row.center_x, row.center_y
        ex, ey, before = held.get("eye", (x, y, None))
        strength = conf.pan_switch_strength if before is not None and row.track != before else conf.pan_strength
        x, y = (e if abs(v - e) < conf.pan_deadband else v for v, e in ((x, ex), (y, ey)))
        ex, ey = strength * x + (1 - strength) * ex, strength * y + (1 - strength) * ey
        held["eye"] = ex, ey, row.track
        return [(ex, ey)]

    return live_scan(frames, step, "pan_x double, pan_y double", watermark, idle_seconds)


def live_pursuit(frames: DataFrame, watermark: str = "1 minute", idle_seconds: int = 600, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`framewell.plans.camera.pursue` of frames (video_id, at, timestamp, center_x, center_y, zoom, near) as they come."""

    def step(held: dict, row: tuple) -> list[tuple]:
        return [follow(held, row.center_x, row.center_y, row.zoom, row.timestamp, row.near, conf)]

    return live_scan(frames, step, "path_x double, path_y double, path_zoom double, " + MOTION, watermark, idle_seconds)


def live_tracks(frames: DataFrame, watermark: str = "1 minute", idle_seconds: int = 600, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`framewell.plans.tracking.track_faces` of frames as they come, one row each: video_id, at, timestamp, frame_number and
    ``boxes``, an array of face_pos, x, y, w, h, confidence that may be empty. Tracks unseen for ``tracking_max_age`` frames go."""
    fields = ("face_pos", "x", "y", "w", "h", "confidence")

    def step(held: dict, row: tuple) -> list[tuple]:
        boxes = sorted((b for b in json.loads(row.boxes or "[]") if b and b.get("x") is not None), key=lambda b: b["face_pos"])
        tracker = Tracker(conf, held.get("tracks"), held.get("made", 0))
        found = tracker.see([(b["x"], b["y"], b["w"], b["h"]) for b in boxes])
        held.update(tracks=tracker.tracks, made=tracker.made)
        return [(row.frame_number, *(b.get(f) for f in fields), f"person_{t}", s) for b, (t, s) in zip(boxes, found, strict=True)]

    out = "frame_number long, face_pos long, x double, y double, w double, h double, confidence double, track_id string, association_score double"
    return live_scan(frames.withColumn("boxes", F.to_json("boxes")), step, out, watermark, idle_seconds)
