"""Face tracking: greedy matching of detections to tracks, frame by frame, as a scan over each video's frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.operators.folds import ordered_scan


class Tracker:
    """The tracks of one video. ``see`` takes a frame's boxes and gives a track number and association score for each."""

    def __init__(self, conf: Settings = DEFAULTS, tracks: list[dict] | None = None, made: int = 0):
        self.conf = conf
        self.tracks = tracks or []
        self.made = made

    def _score(self, a: tuple, b: tuple) -> float | None:
        """How well a box continues a track: None if it is neither near nor overlapping."""
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        shared = w * h if w > 0 and h > 0 else 0.0
        total = a[2] * a[3] + b[2] * b[3] - shared
        iou = shared / total if shared > 0 and total > 0 else 0.0
        far = math.dist((a[0] + a[2] / 2, a[1] + a[3] / 2), (b[0] + b[2] / 2, b[1] + b[3] / 2))
        if iou < self.conf.tracking_iou and far > self.conf.tracking_distance:
            return None
        return max(iou, 0.5 * max(0.0, 1.0 - far / self.conf.tracking_distance))

    def _pairs(self, boxes: list[tuple]) -> list[tuple[float, int, int]]:
        """Score, track and box of all pairs that have a score. Most pairs are far apart, which needs no score; a margin leaves those
        at the limit to it."""
        limit = self.conf.tracking_distance**2 * (1 + 1e-9) if self.conf.tracking_iou > 0 else math.inf
        placed = [(d, b, b[0], b[1], b[0] + b[2], b[1] + b[3], b[0] + b[2] / 2, b[1] + b[3] / 2) for d, b in enumerate(boxes)]
        out = []
        for t, track in enumerate(self.tracks):
            x, y, w, h = box = track["box"]
            right, bottom, cx, cy = x + w, y + h, x + w / 2, y + h / 2
            for d, b, left, top, r, low, bx, by in placed:
                dx, dy = cx - bx, cy - by
                if dx * dx + dy * dy > limit and not (left < right and x < r and top < bottom and y < low):
                    continue
                if (s := self._score(box, b)) is not None:
                    out.append((s, t, d))
        return out

    def see(self, boxes: list[tuple]) -> list[tuple[int, float]]:
        pairs = self._pairs(boxes)
        pairs.sort(key=lambda p: -p[0])
        out: dict[int, tuple[int, float]] = {}
        used: set[int] = set()
        for s, t, d in pairs:
            if t not in used and d not in out:
                used.add(t)
                out[d] = (self.tracks[t]["id"], s)
                self.tracks[t].update(box=boxes[d], misses=0)
        for t, track in enumerate(self.tracks):
            if t not in used:
                track["misses"] += 1
        self.tracks = [t for t in self.tracks if t["misses"] <= self.conf.tracking_max_age]
        for d, b in enumerate(boxes):
            if d not in out:
                self.made += 1
                self.tracks.append({"id": self.made, "box": b, "misses": 0})
                out[d] = (self.made, 1.0)
        return [out[d] for d in range(len(boxes))]


def track_faces(faces: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``faces`` (video_id, frame_number, timestamp, face_pos, x, y, w, h, confidence) with track_id and association_score.

    Each frame's boxes are one row for the scan. Frames without faces must be there to count as misses: pass them as rows
    with null boxes.
    """
    item = F.struct("face_pos", "x", "y", "w", "h", "confidence")
    frames = faces.groupBy("video_id", "frame_number").agg(F.min("timestamp").alias("timestamp"), F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), item))).alias("boxes"))

    def make():
        tracker = Tracker(conf)

        def step(boxes: list[dict]) -> tuple:
            found = tracker.see([(b["x"], b["y"], b["w"], b["h"]) for b in boxes])
            return (" ".join(f"{t}:{s!r}" for t, s in found),)

        return step

    seen = ordered_scan(frames, ["video_id"], ["frame_number"], ["boxes"], make, "found string")
    pairs = F.arrays_zip(F.col("boxes").alias("box"), F.split("found", " ").alias("hit"))
    rows = seen.filter("size(boxes) > 0").select("video_id", "frame_number", "timestamp", F.explode(pairs).alias("p"))
    part = F.split("p.hit", ":")
    return rows.select("video_id", "frame_number", "timestamp", "p.box.*", F.concat(F.lit("person_"), F.get(part, F.lit(0))).alias("track_id"), F.get(part, F.lit(1)).cast("double").alias("association_score"))


def track_summary(tracked: DataFrame) -> DataFrame:
    """Per track: first and last frame and time, and detections."""
    return tracked.groupBy("video_id", "track_id").agg(F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count("*").alias("detections"))
