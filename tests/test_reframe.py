"""Tracking, camera path and reframing against plain loops, and small cases of scenes and exports."""

from __future__ import annotations

import math
import random

import pytest
from framewell.config import DEFAULTS as C
from framewell.plans import camera, export, reframe, tracking
from framewell.queries.frames import ORACLE_SQL, _path
from pyspark.sql import functions as F

from tests.conftest import DATA


def plain_tracks(frames):
    """Greedy tracking of {frame: boxes}, one frame after the other: {(frame, place): track}."""
    tracks, made, out = {}, 0, {}
    for frame in sorted(frames):
        boxes, pairs = frames[frame], []
        for name, (box, _) in tracks.items():
            for d, b in enumerate(boxes):
                w = max(0, min(box[0] + box[2], b[0] + b[2]) - max(box[0], b[0]))
                h = max(0, min(box[1] + box[3], b[1] + b[3]) - max(box[1], b[1]))
                iou = w * h / (box[2] * box[3] + b[2] * b[3] - w * h)
                far = math.hypot(box[0] + box[2] / 2 - b[0] - b[2] / 2, box[1] + box[3] / 2 - b[1] - b[3] / 2)
                if iou >= C.tracking_iou or far <= C.tracking_distance:
                    pairs.append((-max(iou, 0.5 * max(0.0, 1 - far / C.tracking_distance)), name, d))
        taken, seen = set(), set()
        for _, name, d in sorted(pairs, key=lambda p: p[0]):
            if name not in seen and d not in taken:
                seen.add(name)
                taken.add(d)
                out[frame, d + 1] = name
                tracks[name] = (boxes[d], 0)
        tracks = {n: (b, m if n in seen else m + 1) for n, (b, m) in tracks.items()}
        tracks = {n: t for n, t in tracks.items() if t[1] <= C.tracking_max_age}
        for d, b in enumerate(boxes):
            if d not in taken:
                made += 1
                tracks[made] = (b, 0)
                out[frame, d + 1] = made
    return out


def test_tracks_are_those_of_a_plain_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for video in range(6):
        at, frames = [[rng.uniform(0, 1500), rng.uniform(0, 800)] for _ in range(4)], {}
        for frame in range(40):
            for p in at:
                p[0] += rng.uniform(-60, 60)
                p[1] += rng.uniform(-40, 40)
            frames[frame] = [(x, y, 80.0 + 10 * i, 90.0) for i, (x, y) in enumerate(at) if rng.random() < 0.8]
            rows += [(video, frame, frame * 0.5, d, *b, 0.9) for d, b in enumerate(frames[frame], 1)] or [(video, frame, frame * 0.5, None, None, None, None, None, None)]
        want |= {(video, *k): f"person_{v}" for k, v in plain_tracks(frames).items()}
    faces = spark.createDataFrame(rows, "video_id long, frame_number long, timestamp double, face_pos int, x double, y double, w double, h double, confidence double")
    assert {(r.video_id, r.frame_number, r.face_pos): r.track_id for r in tracking.track_faces(faces).collect()} == want


def test_pursuit_is_the_recurrence_of_the_sql(spark, oracle):
    """Unrounded: at six digits the engines round decimal ties differently, so the query has no SQL of its own."""
    body = ORACLE_SQL["camera_metrics"]
    head = body[: body.index(", g AS (SELECT")]
    theirs = {(v, f): tuple(x) for v, f, *x in oracle.sql(f"{head} SELECT video_id, frame_number, px, py, pz, vx, vy, vz, ax, ay, az FROM f").fetchall()}
    names = ["path_x", "path_y", "path_zoom", "velocity_x", "velocity_y", "zoom_velocity", "acceleration_x", "acceleration_y", "zoom_acceleration"]
    mine = {(r.video_id, r.frame_number): tuple(r[n] for n in names) for r in _path(spark, DATA).collect()}
    assert mine.keys() == theirs.keys()
    assert all(v == pytest.approx(theirs[k], rel=1e-9, abs=1e-7) for k, v in mine.items())


def test_reframing_keeps_a_lone_face_in_view(spark):
    """A frame without faces is shown whole; crops stay in the picture and on the face."""
    rows = [(1, i, i * 0.5, "person_1", 200.0 + 12 * i, 300.0, 120.0, 150.0, 0.9) for i in range(20)]
    faces = spark.createDataFrame(rows, "video_id long, frame_number long, timestamp double, track_id string, x double, y double, w double, h double, confidence double")
    frames = faces.select("video_id", "frame_number", "timestamp").unionByName(spark.createDataFrame([(1, 20, 10.0)], "video_id long, frame_number long, timestamp double"))
    segments = spark.createDataFrame([(1, 0, 0.0, "a", "some words"), (1, 1, 4.0, "a", "more")], "video_id long, pos int, seconds double, speaker string, text string")
    speech = reframe.speech_windows(segments).drop("speaker")
    energy = spark.createDataFrame([(1, 0.0, 0.8)], "video_id long, timestamp double, energy double")
    cuts = spark.createDataFrame([(1, 5.1)], "video_id long, timestamp double")
    ranked, rapid = reframe.rank_faces(faces, speech, energy)
    plan = {r.frame_number: r for r in reframe.composition(frames, ranked, rapid).collect()}
    assert (plan[20].shot_type, plan[20].zoom, plan[20].targets) == ("wide_table", 1920.0, [])
    assert all(plan[i].shot_type == "single_speaker" and plan[i].targets == ["person_1"] for i in range(20))
    path = reframe.camera_path(reframe.composition(frames, ranked, rapid), cuts)
    assert [r.frame_number for r in path.filter("near = 1").collect()] == [10]
    made = reframe.reframe(frames, faces, speech, energy, cuts)
    assert made.count() == 21 and made.filter("x < 0 OR y < 0 OR x + w > 1920 OR y + h > 1080").count() == 0
    m = reframe.metrics(made, faces, path).first()
    assert (m.frame_count, m.face_frame_count, m.average_visibility) == (21, 20, 1.0)
    none = reframe.reframe(frames.limit(0), faces.limit(0), speech, energy, cuts)
    assert none.count() == 0


def test_scene_of_a_time(spark):
    scenes = spark.createDataFrame([(1, 0, 1.0, 5.0), (1, 1, 5.0, 9.0)], "video_id long, index long, start_seconds double, end_seconds double")
    frames = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 5.0, 9.0, 40.0)] + [(2, 1.0)], "video_id long, timestamp double")
    got = {(r.video_id, r.timestamp): r.scene for r in camera.scene_at(frames, scenes).collect()}
    assert got == {(1, 0.5): None, (1, 1.0): 0, (1, 5.0): 1, (1, 9.0): 1, (1, 40.0): 1, (2, 1.0): None}


def test_reports_and_metadata(spark, tmp_path):
    episodes = spark.createDataFrame([(1, "v.mp4", "t.srt", 2), (2, "w.mp4", "u.srt", 0)], "video_id long, source string, transcript string, n_clips int")
    windows = spark.createDataFrame([(1, 2, 61.0, 90.0, 4.25, []), (1, 1, 5.0, 30.0, 8.0, ["a", "b"])], "video_id long, rank long, start_seconds double, end_seconds double, score double, labels array<string>")
    got = {r.video_id: r.report.split("\n") for r in export.reports(episodes, windows).collect()}
    assert got[1][6:] == ["## Candidate Windows", "", "- `00:00:05` → `00:00:30` score 8.0 (a, b)", "- `00:01:01` → `00:01:30` score 4.3 (candidate)", ""]
    assert got[2] == ["# Episode Export Report", "", "- Source video: `w.mp4`", "- Transcript: `u.srt`", "- Clips exported: 0", ""]
    meta = spark.createDataFrame([(1, 3, "t", "x.json")], "video_id long, index int, title string, json_path string")
    row = export.metadata_files(meta).first()
    assert (row.name, row.content) == ("clip3_metadata.json", '{"index":3,"title":"t"}')
    export.write_metadata(meta, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).select(F.col("value")).first().value == row.content
