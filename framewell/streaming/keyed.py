"""Recurrences over streams with typed state: smoothing and face tracking on Spark's state processors.

State is a value or a map with a schema, kept by Spark's RocksDB state store (set ``spark.sql.streaming.stateStore.providerClass``).
It can begin with what a batch run left (``initial``), so a stream goes on where a backfill ended. ``at`` is a frame's event time;
a timer drops a video's state when the watermark is ``idle_seconds`` past its last frame. Frames of one trigger are taken in
order of time; one that is not later than a frame of an earlier trigger is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewell.config import DEFAULTS, Settings
from framewell.plans.camera import MOTION, ease
from framewell.plans.tracking import Tracker

CLOCK = "last double, latest long"
EASED = "x double, y double, zoom double, vx double, vy double, vz double, t double"
TRACK = "x double, y double, w double, h double, misses int"
BOX = ("face_pos", "x", "y", "w", "h", "confidence")


class Frames(StatefulProcessor):
    """What the processors share: order within a trigger, frames that come too late, and the timer."""

    def __init__(self, out: str, idle_seconds: int, conf: Settings):
        self.names, self.idle_ms, self.conf = [x.split()[0] for x in out.split(", ")], idle_seconds * 1000, conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        last, latest = self.clock.get() if self.clock.exists() else (None, 0)
        if last is not None:
            frames = frames[frames["timestamp"] > last]
        if len(frames):
            made = [(key[0], *row) for row in self.see(frames)]
            last, latest = float(frames["timestamp"].max()), max(latest, int(frames["at"].max().timestamp() * 1000))
            yield pd.DataFrame(made, columns=self.names)
        self._wait(last, max(latest, timerValues.getCurrentWatermarkInMs()))

    def _wait(self, last: float | None, latest: int) -> None:
        self.clock.update((last, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        self.forget()
        yield pd.DataFrame([], columns=self.names)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.iloc[0]
        self.start(row)
        self._wait(float(row["t"]), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Smoothing(Frames):
    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("eased", EASED)

    def see(self, frames: pd.DataFrame) -> Iterator[tuple]:
        state: dict = {}
        if self.held.exists():
            x, y, z, vx, vy, vz, t = self.held.get()
            state.update(at=(x, y, z), v=(vx, vy, vz), t=t)
        for row in frames.itertuples():
            if row.near == 1:
                state.clear()
            yield (row.timestamp, *ease(state, row.center_x, row.center_y, row.zoom, row.timestamp, self.conf))
        self.held.update((*state["at"], *state["v"], state["t"]))

    def start(self, row: pd.Series) -> None:
        self.held.update(tuple(float(row[c.split()[0]]) for c in EASED.split(", ")))

    def forget(self) -> None:
        self.held.clear()


class Tracking(Frames):
    def open(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "id long", TRACK)
        self.made = handle.getValueState("made", "n long")

    def see(self, frames: pd.DataFrame) -> Iterator[tuple]:
        held = sorted((k[0], v) for k, v in self.tracks.iterator())
        tracker = Tracker(self.conf, [{"id": i, "box": tuple(v[:4]), "misses": v[4]} for i, v in held], self.made.get()[0] if self.made.exists() else 0)
        for row in frames.itertuples():
            boxes = sorted((b for b in json.loads(row.boxes or "[]") if b and b.get("x") is not None), key=lambda b: b["face_pos"])
            found = tracker.see([(b["x"], b["y"], b["w"], b["h"]) for b in boxes])
            yield from ((row.timestamp, row.frame_number, *(b.get(f) for f in BOX), f"person_{t}", s) for b, (t, s) in zip(boxes, found, strict=True))
        for i, _ in held:
            if all(t["id"] != i for t in tracker.tracks):
                self.tracks.removeKey((i,))
        for t in tracker.tracks:
            self.tracks.updateValue((t["id"],), (*map(float, t["box"]), t["misses"]))
        self.made.update((tracker.made,))

    def start(self, row: pd.Series) -> None:
        for t in json.loads(row["tracks"]):
            self.tracks.updateValue((t["id"],), (t["x"], t["y"], t["w"], t["h"], t["misses"]))
        self.made.update((int(row["made"]),))

    def forget(self) -> None:
        self.tracks.clear()
        self.made.clear()


def _process(frames: DataFrame, processor: Frames, out: str, watermark: str, initial: DataFrame | None) -> DataFrame:
    keyed = frames.withWatermark("at", watermark).groupBy("video_id")
    return keyed.transformWithStateInPandas(processor, out, "Append", "EventTime", initialState=initial.groupBy("video_id") if initial is not None else None)


def keyed_smooth(frames: DataFrame, watermark: str = "1 minute", idle_seconds: int = 600, initial: DataFrame | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`framewell.plans.camera.smooth` of frames (video_id, at, timestamp, center_x, center_y, zoom, near) as they come.
    ``initial``: see :func:`smooth_state`."""
    out = "video_id long, timestamp double, smooth_x double, smooth_y double, smooth_zoom double, " + MOTION
    return _process(frames, Smoothing(out, idle_seconds, conf), out, watermark, initial)


def smooth_state(smoothed: DataFrame) -> DataFrame:
    """Where a batch run of :func:`framewell.plans.camera.smooth` has left each video, for :func:`keyed_smooth`."""
    names = {"t": "timestamp", "x": "smooth_x", "y": "smooth_y", "zoom": "smooth_zoom", "vx": "velocity_x", "vy": "velocity_y", "vz": "zoom_velocity"}
    last = F.max(F.struct("timestamp", "frame_number", *[F.col(c).alias(n) for n, c in names.items()])).alias("s")
    return smoothed.groupBy("video_id").agg(last).select("video_id", *[f"s.{x.split()[0]}" for x in EASED.split(", ")])


def keyed_tracks(frames: DataFrame, watermark: str = "1 minute", idle_seconds: int = 600, initial: DataFrame | None = None, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`framewell.plans.tracking.track_faces` of frames as they come, one row each: video_id, at, timestamp, frame_number and
    ``boxes``, an array of face_pos, x, y, w, h, confidence that may be empty. ``initial``: see :func:`track_state`."""
    out = "video_id long, timestamp double, frame_number long, face_pos long, x double, y double, w double, h double, confidence double, track_id string, association_score double"
    return _process(frames.withColumn("boxes", F.to_json("boxes")), Tracking(out, idle_seconds, conf), out, watermark, initial)


def track_state(tracked: DataFrame, frames: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The tracks that a batch run of :func:`framewell.plans.tracking.track_faces` has left, for :func:`keyed_tracks`. ``frames``
    (video_id, frame_number, timestamp) are all frames, those without faces included."""
    behind = frames.select("video_id", "frame_number", "timestamp").withColumn("misses", (F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("frame_number"))) - 1).cast("int"))
    ends = behind.groupBy("video_id").agg(F.max("timestamp").alias("t"))
    number = F.regexp_extract("track_id", "([0-9]+)$", 1).cast("long")
    last = tracked.groupBy("video_id", number.alias("id")).agg(F.max(F.struct("frame_number", "x", "y", "w", "h")).alias("b"))
    last = last.withColumn("frame_number", F.col("b.frame_number")).join(behind.select("video_id", "frame_number", "misses"), ["video_id", "frame_number"])
    item = F.struct("id", "b.x", "b.y", "b.w", "b.h", "misses")
    held = last.groupBy("video_id").agg(F.to_json(F.collect_list(F.when(F.col("misses") <= conf.tracking_max_age, item))).alias("tracks"), F.max("id").alias("made"))
    return ends.join(held, "video_id").select("video_id", "t", "tracks", "made")
