"""Crops that follow the speaker: a fixed-size window per frame, moved to keep faces inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions import geometry as G
from framewell.functions.binding import let

FRAME = ["video_id", "frame_number"]


def speaker_crops(camera: DataFrame, faces: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """Per frame of ``camera`` (video_id, frame_number, timestamp, center_x, center_y): x, y, w, h and ``track``.

    The window is centered on the active speaker, else on the most important face, else where the camera points, and then
    moved to take in the speaker's padded face, or all faces without a speaker. ``faces`` carry track_id, active and place.
    """
    item = F.struct("place", "track_id", "active", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("b"))
    return frame_crops(camera, faces.groupBy(*FRAME).agg(F.collect_list(item).alias("f")), width, height, conf)


def frame_crops(camera: DataFrame, seen: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`speaker_crops` from the faces of each frame, the array ``f`` of ``seen`` (place, track_id, active and the box ``b``)."""
    out = camera.join(seen.select(*FRAME, held(conf).alias("held")), FRAME, "left")
    return place(out, width, height, conf).select(*FRAME, "timestamp", "crop.*", "track")


def held(conf: Settings = DEFAULTS) -> Column:
    """What a crop needs to know of a frame's faces ``f``: a struct of the center of the one to follow (``x``, ``y``), its ``track`` if it
    speaks, and the box ``content`` to take in."""
    ordered = F.array_sort(F.transform("f", lambda f: F.struct((~f.active).alias("order"), f.place.alias("place"), f.track_id.alias("track_id"), f.active.alias("active"), f.b.alias("b"))))

    def made(seen: Column) -> Column:
        first = F.get(seen, F.lit(0))
        track = F.when(first.active, first.track_id)
        inside = F.transform(F.filter(seen, lambda f: track.isNull() | f.active), lambda f: G.expand(f.b, conf.face_padding))
        return F.struct((first.b.x + first.b.w / 2).alias("x"), (first.b.y + first.b.h / 2 - first.b.h * 0.05).alias("y"), track.alias("track"), G.union(inside).alias("content"))

    return let(ordered, made)


def place(frames: DataFrame, width: float = 1920.0, height: float = 1080.0, conf: Settings = DEFAULTS) -> DataFrame:
    """``frames`` (center_x, center_y and :func:`held`, null without faces) with ``crop`` and ``track`` instead of ``held``."""
    w, h = G.largest_crop(F.lit(width), F.lit(height), conf.target_aspect)
    cx, cy = F.coalesce("held.x", "center_x"), F.coalesce("held.y", "center_y")
    out = frames.withColumns({"crop": G.crop_at(cx, cy, w, h, F.lit(width), F.lit(height)), "track": F.col("held.track"), "content": F.col("held.content")})
    moved = F.when(F.col("content").isNull(), F.col("crop")).otherwise(G.pan_to(F.col("crop"), F.col("content"), F.lit(width), F.lit(height)))
    return out.withColumn("crop", moved).drop("held", "content")
