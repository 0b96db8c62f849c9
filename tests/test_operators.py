"""Operators on hand-made rows and against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from framewell.config import DEFAULTS
from framewell.functions.scoring import emotion_intensity, length_score
from framewell.functions.time import format_srt_timestamp, format_timestamp, parse_timestamp
from framewell.operators.joins import as_of, contained
from framewell.plans import camera, quality, ranking, subtitles, tracking, windows
from framewell.sources import payloads, transcripts
from pyspark.sql import functions as F

SEGMENTS = [(1, 0, 10.0, "A", "Hello there."), (1, 1, 20.0, "B", "I disagree strongly."), (1, 2, 30.0, "A", "You're lying to everyone."), (1, 3, 60.0, "C", "Vote time."), (1, 4, 90.0, "D", "Shocking reveal.")]
SEGMENT = "video_id long, pos long, seconds double, speaker string, text string"
CLIP = "video_id long, pos long, start_seconds double, end_seconds double, duration_seconds double, viral_score double, emotion string"


def clips(spark, *rows):
    return spark.createDataFrame([(1, i, float(a), float(b), float(b - a), float(v), e) for i, (a, b, v, e) in enumerate(rows)], CLIP)


def test_scores(spark):
    row = spark.range(1).select(*[emotion_intensity(F.lit(e)).alias(f"e{i}") for i, e in enumerate(("betrayal", "pure betrayal moment", "calm", "belief"))], *[length_score(F.lit(float(x))).alias(f"l{x}") for x in (45, 10, 100)]).first()
    assert tuple(row) == (1.0, 1.0, 0.5, 0.85, 1.0, 0.0, 0.0)


def test_timestamps(spark):
    texts = ["00:01:23", "01:23,500", "1:02:03.5", "x", "1:2:03"]
    found = [parse_timestamp(F.lit(t)).alias(f"t{i}") for i, t in enumerate(texts)]
    assert tuple(spark.range(1).select(*found).first()) == (83.0, 83.5, 3723.5, None, None)
    assert tuple(spark.range(1).select(format_timestamp(F.lit(3725.9)), format_srt_timestamp(F.lit(83.5)), format_timestamp(F.lit(-1.0))).first()) == ("01:02:05", "00:01:23,500", None)


def test_dropped_clip_drops_no_other(spark):
    out = ranking.remove_overlaps(clips(spark, (0, 10, 9, "a"), (4, 14, 8, "a"), (8, 18, 7, "a")).withColumn("rank_score", F.col("viral_score")))
    assert sorted(r.pos for r in out.collect()) == [0, 2]


def test_ranking_prefers_variety(spark):
    out = ranking.rank_clips(clips(spark, (10, 50, 8.0, "betrayal"), (100, 140, 7.9, "betrayal"), (200, 240, 7.5, "humor")), spark.createDataFrame(SEGMENTS, SEGMENT), 2)
    assert "humor" in {r.emotion for r in out.collect()}
    empty = ranking.rank_clips(spark.createDataFrame([], CLIP), spark.createDataFrame(SEGMENTS, SEGMENT))
    assert empty.count() == 0


def test_variety_is_the_greedy_choice(spark):
    rng = random.Random(3)
    data = [(1, i, 0.0, 1.0, 1.0, rng.randrange(8) / 2, rng.choice("abc")) for i in range(30)]
    got = [r.pos for r in ranking.variety(spark.createDataFrame(data, CLIP).withColumn("rank_score", F.col("viral_score")), 9).orderBy("rank").collect()]
    left, seen, want = sorted(data, key=lambda r: (-r[5], r[1])), set(), []
    for _ in range(9):
        best = max(left, key=lambda r: (r[5] + (r[6] not in seen), r[5], -r[1]))
        left.remove(best)
        seen.add(best[6])
        want.append(best[1])
    assert sorted(got) == sorted(want)


def test_quality_issues(spark):
    lines = [(1, 0, 12.0, "A", "Hello there."), (1, 1, 18.0, "B", "You're lying."), (1, 2, 25.0, "A", "I didn't do it."), (1, 3, 35.0, "B", "Vote now."), (1, 4, 42.0, "A", "Fine.")]
    checked = quality.check_quality(clips(spark, (10, 50, 8, "a"), (10, 50, 8, "a"), (10, 15, 8, "a"), (10, 200, 3, "a")), spark.createDataFrame(lines, SEGMENT)).orderBy("index").collect()
    assert [r.passed for r in checked] == [True, False, False, False]
    assert [i.message for i in checked[1].issues] == ["Clip dialogue duplicates another clip in the batch"]
    assert {i.code for i in checked[3].issues} == {"too_long", "too_much_silence", "low_confidence", "repeated_dialogue"}
    one = quality.silence_ratio(clips(spark, (10, 50, 8, "a")), spark.createDataFrame(lines, SEGMENT)).first()
    assert one.silence_ratio == 0.375


def test_windows(spark):
    long = spark.createDataFrame([(1, i, 60.0 * i, None, f"Minute {i}") for i in range(25)], SEGMENT)
    out = [(r.start_seconds, r.end_seconds) for r in windows.transcript_windows(long).orderBy("index").collect()]
    assert out == [(0.0, 600.0), (540.0, 1140.0), (1080.0, 1445.0)]
    with pytest.raises(ValueError):
        windows.transcript_windows(long, DEFAULTS.__class__(window_seconds=60.0, window_overlap_seconds=60.0))


def test_candidates_are_one_island(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, "A", "I never lie!"), (1, 1, 25.0, "B", "That's crazy."), (1, 2, 60.0, "A", "Vote now everyone.")], SEGMENT)
    found = windows.candidate_windows(windows.transcript_signals(lines), 5).collect()
    assert [(r.start_seconds, r.end_seconds) for r in found] == [(10.0, 68.0)]


def test_bucketed_join_is_the_plain_one(spark):
    rng = random.Random(5)
    spans = spark.createDataFrame([(rng.randrange(3), float(a := rng.randrange(500)), float(a + rng.randrange(90)), i) for i in range(80)], "v int, a double, b double, i int")
    points = spark.createDataFrame([(rng.randrange(3), rng.random() * 600, j) for j in range(300)], "v int, t double, j int")
    pairs = [{(r.i, r.j) for r in contained(spans, points, ["v"], "a", "b", "t", bucket=k).select("i", "j").collect()} for k in (None, 50.0)]
    assert pairs[0] == pairs[1] and pairs[0]
    assert contained(spans, points, ["v"], "a", "b", "t", bucket=50.0).count() == len(pairs[0])


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 9.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b"), (1, 7.0, "c")], "k int, t double, v string")
    back = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect()}
    fore = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], "t", ["v"], direction="forward").collect()}
    assert back == {(1, 5.0): "b", (1, 0.5): None, (2, 9.0): None} and fore == {(1, 5.0): "b", (1, 0.5): "a", (2, 9.0): None}


def test_transcripts(spark):
    texts = [
        ("srt", "1\n00:00:13,000 --> 00:00:15,000\nPlayer A: I didn't kill him.\n\n2\n00:00:19,500 --> 00:00:22,000\nThen who did?\n"),
        ("multi", "00:00:13\n\nPlayer A:\nI didn't kill him.\nReally.\n\n00:00:19\n\n00:00:24\nThen who did?\n"),
        ("inline", "00:00:13 Player A: I didn't kill him.\n00:00:24 - Then who did?\n"),
        ("blank", " \n"),
    ]
    out = transcripts.parse_transcripts(spark.createDataFrame(texts, "video_id string, content string"))
    got = {}
    for r in out.orderBy("video_id", "pos").collect():
        got.setdefault(r.video_id, []).append((r.seconds, r.speaker, r.text))
    assert got == {
        "srt": [(13.0, "Player A", "I didn't kill him."), (19.5, None, "Then who did?")],
        "multi": [(13.0, "Player A", "I didn't kill him. Really."), (24.0, None, "Then who did?")],
        "inline": [(13.0, "Player A", "I didn't kill him."), (24.0, None, "Then who did?")],
    }


def test_answers(spark):
    body = '{"start":"00:00:13","end":"00:00:45","reason":"r","score":9.7,"emotion":"e","hook":"h","summary":" "}'
    data = [(1, f"```json\n[{body}]\n```"), (2, f'{{"clips":[{body}]}}'), (3, body), (4, "no json"), (5, body.replace("00:00:45", "00:00:13"))]
    out = payloads.clip_answers(spark.createDataFrame(data, "key int, content string")).orderBy("key").collect()
    assert [(r.key, r.start_seconds, r.end_seconds, r.viral_score, r.summary) for r in out] == [(k, 13.0, 45.0, 9.7, "r") for k in (1, 2, 3)]


def test_cues(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, "A", "Hello there."), (1, 1, 15.0, "B", "x"), (1, 2, 22.0, None, "y"), (1, 3, 60.0, "C", "z")], SEGMENT)
    out = subtitles.clip_cues(clips(spark, (8, 30, 1, "a")), lines).orderBy("index").collect()
    assert [(r.start_seconds, r.end_seconds, r.text) for r in out] == [(2.0, 7.0, "A: Hello there."), (7.0, 14.0, "B: x"), (14.0, 22.0, "y")]


def test_tracks_survive_gaps(spark):
    at = lambda frame, pos, x: (1, frame, frame / 2, pos, x, 200.0, 100.0, 100.0, 0.9)
    none = lambda frame: (1, frame, frame / 2, None, None, None, None, None, None)
    data = [at(0, 1, 200.0), at(0, 2, 800.0), none(1), none(2), at(3, 1, 806.0), at(3, 2, 203.0)]
    out = tracking.track_faces(spark.createDataFrame(data, "video_id int, frame_number int, timestamp double, face_pos int, x double, y double, w double, h double, confidence double"))
    names = {(r.frame_number, r.face_pos): r.track_id for r in out.collect()}
    assert names[0, 1] == names[3, 2] and names[0, 2] == names[3, 1] and names[0, 1] != names[0, 2]
    assert tracking.track_summary(out).filter("detections = 2").count() == 2


def _path(spark, n=40):
    rng = random.Random(9)
    data = [(v, i, i * 0.5, rng.random() * 900, rng.random() * 500, 300 + rng.random() * 300, int(i in (11, 12, 30)), rng.choice(["a", "b", None])) for v in (1, 2) for i in range(n)]
    return data, spark.createDataFrame(data, "video_id int, frame_number int, timestamp double, center_x double, center_y double, zoom double, near int, track string")


def test_pursuit_is_the_plain_loop(spark):
    data, frames = _path(spark)
    got = {(r.video_id, r.frame_number): (r.path_x, r.path_y, r.path_zoom) for r in camera.pursue(frames).collect()}
    for v in (1, 2):
        at = None
        for _, i, _, x, y, z, near, _ in [r for r in data if r[0] == v]:
            if at is None or near:
                at = (x, y, z)
            else:
                far, rest = math.hypot(x - at[0], y - at[1]), abs(z - at[2])
                p, q = min(1, 140 / far, 0.35), min(1, 250 / rest, 0.35)
                at = (at[0] + (x - at[0]) * p, at[1] + (y - at[1]) * p, at[2] + (z - at[2]) * q)
            assert got[v, i] == pytest.approx(at)


def test_smoothing_starts_anew_at_cuts_and_limits_jerk(spark):
    data, frames = _path(spark)
    out = camera.smooth(frames).orderBy("video_id", "frame_number").collect()
    for r, (_, _, _, x, y, z, near, _) in zip(out, data, strict=True):
        if near or r.frame_number == 0:
            assert (r.smooth_x, r.smooth_y, r.smooth_zoom) == pytest.approx((x, y, z))
            assert r.velocity_x == 0.0
        else:
            assert abs(r.acceleration_x) <= DEFAULTS.smoothing_max_jerk + 1e-6


def test_static_pan_stays(spark):
    frames = spark.createDataFrame([(1, i, i * 0.5, 100.0 + i % 3, 50.0, 1.0, 0, "a") for i in range(9)], "video_id int, frame_number int, timestamp double, center_x double, center_y double, zoom double, near int, track string")
    assert {(r.pan_x, r.pan_y) for r in camera.pan(frames).collect()} == {(100.0, 50.0)}


def test_boundary_anchor_moves(spark):
    data = [(1, 1.0, 0.4), (1, 1.4, 0.9), (1, 1.8, 0.5), (1, 3.0, 0.4)]
    out = camera.merge_boundaries(spark.createDataFrame(data, "video_id int, timestamp double, confidence double"))
    assert sorted((r.timestamp, r.confidence) for r in out.collect()) == [(1.4, 0.9), (3.0, 0.4)]
