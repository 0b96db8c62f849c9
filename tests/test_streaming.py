from __future__ import annotations

import pytest
from framewell.functions import render
from framewell.plans import camera, registry, tracking
from framewell.streaming import live
from pyspark.sql import functions as F


def _run(spark, df, path, transform, mode="append"):
    df.write.parquet(str(path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(path / "in"))
    query = transform(stream).writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return spark.table("t")


def test_pan_is_the_batch_pan(spark, tmp_path):
    frames = spark.createDataFrame([(v, i, i * 0.5, float(i * 37 % 90), float(i * 11 % 50), "ab"[i // 5 % 2]) for v in (1, 2) for i in range(20)], "video_id long, frame_number int, timestamp double, center_x double, center_y double, track string").withColumn("at", F.timestamp_seconds(F.col("timestamp") + 1000))
    live_rows = {(r.video_id, r.timestamp): (r.pan_x, r.pan_y) for r in _run(spark, frames.coalesce(1), tmp_path, live.live_pan).collect()}
    batch = {(r.video_id, r.timestamp): (r.pan_x, r.pan_y) for r in camera.pan(frames).collect()}
    assert {k: pytest.approx(v) for k, v in batch.items()} == live_rows


def test_pursuit_is_the_batch_pursuit(spark, tmp_path):
    frames = spark.createDataFrame([(v, i, i * 0.5, float(i * 370 % 900), float(i * 110 % 500), 1.0 + i % 3 / 4, int(i == 9)) for v in (1, 2) for i in range(20)], "video_id long, frame_number int, timestamp double, center_x double, center_y double, zoom double, near int").withColumn("at", F.timestamp_seconds(F.col("timestamp") + 1000))
    names = ["video_id", "timestamp", "path_x", "path_y", "path_zoom", *(x.split()[0] for x in camera.MOTION.split(", "))]
    live_rows = _run(spark, frames, tmp_path, live.live_pursuit).select(names)
    batch = camera.pursue(frames).select(names)
    assert sorted(map(tuple, live_rows.collect())) == sorted(map(tuple, batch.collect()))


def test_tracks_are_the_batch_tracks_over_triggers(spark, tmp_path):
    faces = [(v, i, i * 0.5, f, 100.0 * f + i * 7 % 40, 50.0 + i % 5, 60.0, 60.0, 0.9) for v in (1, 2) for i in range(24) for f in range(3) if (i + f * 3) % 11 < 8]
    frames = spark.createDataFrame(faces, "video_id long, frame_number long, timestamp double, face_pos long, x double, y double, w double, h double, confidence double")
    box = F.struct("face_pos", "x", "y", "w", "h", "confidence")
    rows = frames.groupBy("video_id", "frame_number", "timestamp").agg(F.collect_list(box).alias("boxes")).withColumn("at", F.timestamp_seconds(F.col("timestamp") + 1000))
    for k in range(3):  # three triggers, the files in order of time
        rows.filter(f"frame_number div 8 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.live_tracks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    names = ["video_id", "frame_number", "face_pos", "track_id", "association_score"]
    live_rows = spark.read.parquet(str(tmp_path / "out")).select(names)
    assert sorted(map(tuple, live_rows.collect())) == sorted(map(tuple, tracking.track_faces(frames).select(names).collect()))
    assert live_rows.select("track_id").distinct().count() >= 3


def test_islands_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 2.0, 0.5), (1, 4.0, 1.0, 0.9), (1, 30.0, 1.0, 0.2)], "video_id long, t double, seconds double, score double").withColumn("at", F.timestamp_seconds("t")).withColumn("text", F.lit("abc"))
    out = _run(spark, rows, tmp_path / "a", live.live_islands, "complete")
    assert sorted((r.score, r.n_signals) for r in out.collect()) == [(0.2, 1), (0.9, 2)]
    out = _run(spark, rows, tmp_path / "b", live.live_windows, "complete")
    assert out.agg(F.max("n_lines")).first()[0] == 3


def test_registry():
    assert registry.get("camera_planner", " Pursuit ") is camera.pursue
    with pytest.raises(registry.UnknownStage):
        registry.get("tracker", "none")
    with pytest.raises(registry.UnknownStage):
        registry.register("nothing", "x", camera.pan)


def test_render_texts(spark):
    n = [F.lit(float(x)) for x in (10.5, 20.5, 607.5, 1081)]
    row = spark.range(1).select(render.crop_filter(*n), render.center_crop_filter(F.lit(1920), F.lit(1080)), render.center_crop_filter(F.lit(500), F.lit(1080)), render.clip_index(F.lit("x/clip12_vertical.mp4")), render.cut_arguments(F.lit("a"), F.lit("b"), F.lit(1.0), F.lit(2.5))).first()
    assert row[0] == "crop=608:1080:10:20,scale=1080:1920:flags=lanczos"
    assert row[1].startswith("crop=ih*1080/1920:ih") and row[2].startswith("scale=1080:1920") and row[3] == 12
    assert row[4][:8] == ["-y", "-ss", "1.000", "-i", "a", "-t", "2.500", "-c"]
    log = spark.createDataFrame([(1, "x pts_time:4.5 scene:0.8\npts_time:9\nno")], "video_id int, content string")
    assert sorted((r.timestamp, r.confidence) for r in render.scene_log(log, 0.35).collect()) == [(4.5, 0.8), (9.0, 0.35)]
