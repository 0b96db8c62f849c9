"""Typed state: equal to the batch results over several triggers, after a restart and from a batch run's end."""

from __future__ import annotations

import pytest
from framewell.plans import camera, tracking
from framewell.streaming import keyed
from pyspark.sql import functions as F

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):  # noqa: ANN001, ANN201
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield spark
    spark.conf.set(STORE, before)


def triggers(spark, rows, parts: list, path, transform) -> list:  # noqa: ANN001
    """Run a stream over ``parts`` of ``rows``, one after the other; each is a new query that goes on from the checkpoint."""
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(path / "in"))
        stream = transform(spark.readStream.schema(rows.schema).parquet(str(path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(path / "out"))


def camera_frames(spark):  # noqa: ANN001, ANN201
    made = [(v, i, i * 0.5, float(i * 370 % 900), float(i * 110 % 500), 200.0 + i % 7 * 40, int(i in (9, 20))) for v in (1, 2) for i in range(30)]
    return spark.createDataFrame(made, "video_id long, frame_number long, timestamp double, center_x double, center_y double, zoom double, near int").withColumn("at", F.timestamp_seconds(F.col("timestamp") + 1000))


NAMES = ["video_id", "timestamp", "smooth_x", "smooth_y", "smooth_zoom", *(x.split()[0] for x in camera.MOTION.split(", "))]


def test_smoothing_over_triggers_and_from_a_batch(rocks, tmp_path) -> None:
    frames = camera_frames(rocks)
    batch = sorted(map(tuple, camera.smooth(frames).select(NAMES).collect()))
    parts = ["frame_number < 7", "frame_number BETWEEN 7 AND 19", "frame_number >= 20"]
    live = triggers(rocks, frames, parts, tmp_path / "a", keyed.keyed_smooth)
    assert sorted(map(tuple, live.select(NAMES).collect())) == batch
    began = rocks.createDataFrame(keyed.smooth_state(camera.smooth(frames.filter("frame_number < 12"))).toPandas())
    rest = triggers(rocks, frames, ["frame_number BETWEEN 12 AND 17", "frame_number > 17"], tmp_path / "b", lambda s: keyed.keyed_smooth(s, initial=began))
    assert sorted(map(tuple, rest.select(NAMES).collect())) == [r for r in batch if r[1] >= 6.0]


def test_frames_that_come_too_late_are_dropped(rocks, tmp_path) -> None:
    live = triggers(rocks, camera_frames(rocks), ["frame_number >= 5 AND frame_number < 9", "frame_number < 5 OR frame_number = 9"], tmp_path, keyed.keyed_smooth)
    assert sorted({r.timestamp for r in live.collect()}) == [2.5, 3.0, 3.5, 4.0, 4.5]


def test_a_silent_video_loses_its_state(rocks, tmp_path) -> None:
    """Video 2 comes back after its timer: it starts anew, while video 1 has gone on."""
    frames = camera_frames(rocks).withColumn("near", F.lit(0))
    late = frames.filter("video_id = 2 AND frame_number = 29").withColumns({"timestamp": F.lit(500.0), "at": F.timestamp_seconds(F.lit(1500.0))})
    rows = frames.filter("frame_number < 10").unionByName(frames.filter("video_id = 1 AND frame_number = 10").withColumns({"timestamp": F.lit(400.0), "at": F.timestamp_seconds(F.lit(1400.0))})).unionByName(frames.filter("video_id = 1 AND frame_number = 11").withColumns({"timestamp": F.lit(450.0), "at": F.timestamp_seconds(F.lit(1450.0))})).unionByName(late)
    live = triggers(rocks, rows, ["frame_number < 10", "frame_number = 10", "frame_number = 11", "frame_number = 29"], tmp_path, lambda s: keyed.keyed_smooth(s, "1 second", 60))
    last = live.filter("timestamp = 500.0").first()
    assert (last.smooth_x, last.velocity_x) == (pytest.approx(29 * 370 % 900), 0.0)


def test_tracks_over_triggers_and_from_a_batch(rocks, tmp_path) -> None:
    faces = [(v, i, i * 0.5, f, 100.0 * f + i * 7 % 40, 50.0 + i % 5, 60.0, 60.0, 0.9) for v in (1, 2) for i in range(24) for f in range(3) if (i + f * 3) % 11 < 8]
    frames = rocks.createDataFrame(faces, "video_id long, frame_number long, timestamp double, face_pos long, x double, y double, w double, h double, confidence double")
    rows = frames.groupBy("video_id", "frame_number", "timestamp").agg(F.collect_list(F.struct(*keyed.BOX)).alias("boxes")).withColumn("at", F.timestamp_seconds(F.col("timestamp") + 1000))
    names = ["video_id", "frame_number", "face_pos", "track_id", "association_score"]
    batch = sorted(map(tuple, tracking.track_faces(frames).select(names).collect()))
    live = triggers(rocks, rows, [f"frame_number div 8 = {k}" for k in range(3)], tmp_path / "a", keyed.keyed_tracks)
    assert sorted(map(tuple, live.select(names).collect())) == batch
    head = frames.filter("frame_number < 13")
    state = keyed.track_state(tracking.track_faces(head), head.select("video_id", "frame_number", "timestamp").distinct())
    began = rocks.createDataFrame(state.toPandas())
    rest = triggers(rocks, rows, ["frame_number >= 13"], tmp_path / "b", lambda s: keyed.keyed_tracks(s, initial=began))
    assert sorted(map(tuple, rest.select(names).collect())) == [r for r in batch if r[1] >= 13]
