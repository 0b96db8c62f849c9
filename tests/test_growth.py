"""What keeps the work of queries in proportion to their input."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from framewell.functions import geometry as G
from framewell.functions.time import format_srt_timestamp, format_timestamp
from framewell.operators.folds import values
from framewell.plans import camera, people, quality, reframe, subtitles, tracking
from framewell.queries import QUERIES
from framewell.sources import files, sound, transcripts
from pyspark.sql import functions as F

from tests.conftest import DATA


def optimized(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_timestamp_is_matched_once(spark) -> None:
    assert optimized(QUERIES["timestamp_parse"](spark, DATA)).count("RLIKE") <= 2
    row = spark.sql("SELECT 366125.0D AS a, 3599.9996D AS b, -0.5D AS c, CAST(NULL AS DOUBLE) AS d").select(*[f(F.col(c)).alias(f"{c}{i}") for c in "abcd" for i, f in enumerate((format_timestamp, format_srt_timestamp))]).first()
    assert tuple(row) == ("101:42:05", "101:42:05,000", "00:59:59", "01:00:00,000", None, None, None, None)


def test_crops_are_bound_once(spark) -> None:
    """The content of a crop is an array expression; a copy for each of its uses made plans of thousands of them."""
    assert optimized(QUERIES["face_safety"](spark, DATA)).count("array_min") <= 4
    b = F.array(G.box(*[F.lit(v) for v in (100.0, 50.0, 900.0, 60.0)]), G.box(*[F.lit(v) for v in (0.0, 10.0, 10.0, 20.0)]))
    crop = G.box(*[F.lit(v) for v in (0.0, 0.0, 607.5, 1080.0)])
    frame = F.lit(1920.0), F.lit(1080.0)
    empty = F.array().cast("array<struct<x: double, y: double, w: double, h: double>>")
    made = spark.range(1).select(G.face_safe(crop, b, *frame, 0.5625, 20.0).alias("s"), G.face_safe(crop, empty, *frame, 0.5625, 20.0).alias("e"), G.union(empty).alias("n")).first()
    assert tuple(made.s) == (0.0, 0.0, 1020.0, 1080.0) and tuple(made.e) == (0.0, 0.0, 607.5, 1080.0) and made.n is None


def test_a_transcript_is_classified_once_and_not_for_each_line(spark) -> None:
    raw = spark.range(1).select(F.col("id").alias("video_id"), F.concat(F.lit("00:0"), "id", F.lit("\n\nann:\nhello")).alias("content"))
    plan = optimized(transcripts.parse_transcripts(raw))
    assert plan.rindex("Generate posexplode") < plan.rindex("WEBVTT"), "the format is made below the rows of lines"
    assert [(r.speaker, r.text) for r in transcripts.parse_transcripts(raw).collect()] == [("ann", "hello")]


def test_many_short_sounds_share_tasks(tmp_path) -> None:
    for i in range(600):
        (tmp_path / f"{i:03d}.wav").write_bytes(b"x" * (10 if i else 35))
    parts = sound.WavReader(str(tmp_path), 20).partitions()
    ranges = [(r.path[-7:], r.first, r.last) for p in parts for r in p.ranges]
    assert len(parts) <= sound.TASKS and max(len(p.ranges) for p in parts) <= 3
    assert ranges == [("000.wav", 0, 20), ("000.wav", 20, 35), *[(f"{i:03d}.wav", 0, 10) for i in range(1, 600)]]


def test_files_are_listed_by_tasks_and_names_stay_out_of_the_driver(spark, tmp_path) -> None:
    rows = [(f"ep{i % 3}/subtitles/clip{i}.srt", b"%d" % i) for i in range(2500)] + [("ep1/other/x.srt", b"o"), ("ep1/subtitles/x.txt", b"t"), ("top.srt", b"")]
    files.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "out"))
    parts = files.FilesReader(str(tmp_path / "out"), "ep*/subtitles/*.srt").partitions()
    assert {p.folder for p in parts} == {f"ep{i}/subtitles/" for i in range(3)} and len(parts) == 3 * files.SHARES
    got = files.read_files(spark, str(tmp_path / "out"), "ep*/subtitles/*.srt").collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == sorted(rows[:2500])
    assert [tuple(r) for r in files.read_files(spark, str(tmp_path / "out")).collect()] == [("top.srt", b"")], "no sign of how it was written"
    assert files.read_files(spark, str(tmp_path / "out"), "none*/*").count() == 0
    put = files.FilesWriter(str(tmp_path / "more"), False)
    message = put.write(iter(spark.createDataFrame(rows[:50], "name string, content binary").toArrow().to_batches()))
    assert "clip" not in str(vars(message))
    put.abort([message, None])
    assert [p for p in (tmp_path / "more").rglob("*") if p.is_file()] == []


@pytest.mark.parametrize("made", ["clip_cues", "clip_files"])
def test_clips_of_one_span_share_its_cues(spark, made: str) -> None:
    clips = spark.range(3000).selectExpr("id % 2 AS video_id", "id AS pos", "0D AS start_seconds", "60D + id % 3 AS end_seconds")
    lines = spark.sql("SELECT v AS video_id, n AS pos, n * 8D AS seconds, 'ann' AS speaker, concat('l', n) AS text FROM (SELECT explode(sequence(0L, 9L)) AS n), (SELECT explode(array(0L, 1L)) AS v)")
    out = getattr(subtitles, made)(clips, lines)
    plan = optimized(out)
    assert plan.index("Join Inner") < plan.index("Window") and "Aggregate [video_id" in plan[plan.index("Window"):], "lines meet distinct spans"
    rows = out.collect()
    assert len(rows) == 3000 * (8 if made == "clip_cues" else 1) and len({tuple(r)[2:] for r in rows}) == (8 + 2 if made == "clip_cues" else 3)


@pytest.mark.parametrize("made", ["clip_cues", "clip_files"])
def test_rows_with_texts_grow_with_spans_and_not_with_clips(spark, monkeypatch, made: str) -> None:
    met, join = [], subtitles.contained
    monkeypatch.setattr(subtitles, "contained", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    lines = spark.range(10).selectExpr("0L AS video_id", "id AS pos", "id * 8D AS seconds", "'ann' AS speaker", "concat('l', id) AS text")
    for n in (60, 6000):
        clips = spark.range(n).selectExpr("0L AS video_id", "id AS pos", "id % 2 * 8D AS start_seconds", "60D + id % 3 AS end_seconds")
        assert getattr(subtitles, made)(clips, lines).count() == n * (7.5 if made == "clip_cues" else 1)
    assert [m.count() for m in met] == [6 * 7.5] * 2


def test_dialogue_of_a_span_is_joined_once_and_hashed(spark) -> None:
    clips = spark.range(400).selectExpr("0L AS video_id", "id AS pos", "0D AS start_seconds", "30D + id % 2 * 20.0D AS end_seconds", "30D + id % 2 * 20.0D AS duration_seconds", "9D AS viral_score", "'calm' AS emotion")
    lines = spark.sql("SELECT 0L AS video_id, n AS pos, n * 4D AS seconds, 'ann' AS speaker, concat(' L', n, repeat('x', 5000)) AS text FROM (SELECT explode(sequence(0L, 12L)) AS n)")
    facts = quality.dialogue_facts(clips, lines)
    assert {(r.n, r.long) for r in facts.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(F.length("fingerprint")).alias("long")).collect()} == {(200, 32)}
    assert sorted(r.pos for r in quality.passed_clips(clips, lines).collect()) == [0, 1], "one clip of each dialogue"
    blank = lines.filter("pos = 0").withColumn("text", F.lit(" "))
    assert [tuple(r) for r in quality.dialogue_facts(clips, blank).select(F.length("fingerprint"), "repeated").distinct().collect()] == [(0, False)]


def test_boxes_far_apart_are_not_scored(monkeypatch) -> None:
    calls, score = [], tracking.Tracker._score
    monkeypatch.setattr(tracking.Tracker, "_score", lambda self, a, b: calls.append(1) or score(self, a, b))
    tracker = tracking.Tracker()
    first = tracker.see([(600.0 * i, 0.0, 50.0, 50.0) for i in range(20)])
    assert [t for t, _ in tracker.see([(600.0 * i, 250.0, 50.0, 50.0) for i in range(20)])] == [t for t, _ in first] and len(calls) == 20
    assert tracker.see([(0.0, 500.1, 50.0, 50.0)]) == [(21, 1.0)] and len(calls) == 20


def test_values_are_those_of_to_pylist() -> None:
    rows = [[{"a": 1.5, "b": 2, "c": "x"}], [], [{"a": -0.0, "b": 3, "c": None}] * 3, [{"a": 0.1, "b": 4, "c": "y"}]]
    kind = pa.list_(pa.struct([("a", pa.float64()), ("b", pa.int32()), ("c", pa.string())]))
    for column in (pa.array(rows, kind), pa.array(rows, kind)[1:3], pa.array([*rows, None], kind), pa.array([], kind), pa.array([1.5, None]), pa.array([True]), pa.array(["x"]), pa.array([7, 8])[1:]):
        assert values(column) == column.to_pylist()


def _long_video(spark):  # noqa: ANN001, ANN202
    """Faces of one video over 40 buckets, its frames and sound."""
    rng = random.Random(3)
    rows = [(1, i, i * 100.0 + 0.5 * (i % 2), f"p{k}", rng.uniform(0, 1500), rng.uniform(0, 800), 100.0 + k, 120.0, 0.9) for i in range(1440) for k in range(1, rng.randint(2, 5)) if k < 4 or i % 97 == 0]
    faces = spark.createDataFrame(rows, "video_id long, frame_number long, timestamp double, track_id string, x double, y double, w double, h double, confidence double")
    speech = spark.createDataFrame([(1, 0.0, 60_000.0)], "video_id long, timestamp double, speech_end double")
    return rows, faces, speech, spark.createDataFrame([(1, 0.0, 0.6)], "video_id long, timestamp double, energy double")


def test_signals_of_a_long_video_spread_over_tasks_and_cross_buckets(spark) -> None:
    rows, faces, speech, energy = _long_video(spark)
    scored = people.speaker_scores(people.signals(faces, speech, energy))
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        mouth = r[4] + r[6] / 2, r[5] + r[7] * 0.75
        want[r[1], r[3]] = sum((a - b) ** 2 for a, b in zip(mouth, last.get(r[3], mouth), strict=True)) ** 0.5
        last[r[3]] = mouth
    got = scored.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.frame_number, r.track_id): r.mouth_delta for r in got} == pytest.approx(want) and len(got) == len(rows)
    assert len({r.task for r in got}) > 10, "one video is not one task"
    speakers = {r.frame_number: r.track_id for r in got if r.active}
    spans, before = {}, None
    for i in range(1440):
        if (now := speakers.get(i)) is not None:
            t = i * 100.0 + 0.5 * (i % 2)
            if now != before:
                spans.setdefault(now, []).append([t, t])
            spans[now][-1][1] = t
        before = now
    recent = people.recent_speaker(scored).withColumn("task", F.spark_partition_id()).collect()
    for r in recent:
        mine = [(a, max(b, a + 0.3)) for a, b in spans.get(r.track_id, []) if a <= r.timestamp]
        since = r.timestamp - mine[-1][1] if mine else None
        assert r.recent == pytest.approx(0.0 if since is None else 1.0 if since <= 0 else 2.718281828459045 ** (-since / 3), abs=1e-12)
    assert len(recent) == len(rows) and len({r.task for r in recent}) > 10


def test_landmarks_need_no_sound(spark) -> None:
    plan = optimized(QUERIES["landmark_signals"](spark, DATA))
    assert "Union" not in plan


def test_faces_of_a_frame_are_gathered_once_for_shots_and_framing(spark) -> None:
    ranked = people.importance(people.recent_speaker(people.speaker_scores(people.signals(*_long_video(spark)[1:])))).localCheckpoint()
    frames = ranked.select("video_id", "frame_number", "timestamp").distinct()
    plan = optimized(reframe.composition(frames, ranked, spark.createDataFrame([(1, True)], "video_id long, rapid boolean")))
    assert plan.count("collect_list") == 1


def test_pursuit_and_smoothing_are_one_scan_of_short_rows(spark) -> None:
    rng = random.Random(4)
    rows = [(v, i, i * 0.5, rng.uniform(0, 1900), rng.uniform(0, 1000), rng.uniform(300, 1900), int(rng.random() < 0.1), "long" * 50) for v in range(3) for i in range(60)]
    frames = spark.createDataFrame(rows, "video_id long, frame_number long, timestamp double, center_x double, center_y double, zoom double, near int, reason string")
    led = camera.pursue(frames).select("video_id", "frame_number", "timestamp", "near", F.col("path_x").alias("center_x"), F.col("path_y").alias("center_y"), F.col("path_zoom").alias("zoom"))
    names = ["video_id", "frame_number", "velocity_x", "velocity_y", "zoom_velocity", "acceleration_x", "acceleration_y", "zoom_acceleration"]
    two = camera.smooth(led).select(*names, "smooth_x", "smooth_y", "smooth_zoom").collect()
    one = reframe.camera_path(frames)
    plan = optimized(one)
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "reason" not in one.columns
    assert sorted(map(tuple, one.select(*names, "path_x", "path_y", "path_zoom").collect())) == sorted(map(tuple, two))


def test_crops_and_metrics_sort_short_rows_by_video_once(spark) -> None:
    _, faces, speech, energy = _long_video(spark)
    seen = faces.select("video_id", "frame_number", "timestamp").distinct()
    frames = seen.unionByName(seen.selectExpr("video_id", "frame_number + 10000 AS frame_number", "timestamp + 0.25 AS timestamp"))
    graph = reframe.stages(frames, faces, speech, energy, spark.createDataFrame([(1, 5000.1), (1, 90000.0)], "video_id long, timestamp double"))
    made, told = graph.results("crops", "metrics")
    assert not {"path", "crops"} & set(graph.written)
    for df in (made, told):
        plan = optimized(df)
        assert plan.count("RepartitionByExpression") == 1 and plan.count("MapInArrow") == 2 and "reasoning" not in plan[: plan.index("Join")]
    path = reframe.camera_path(graph.results("composition")[0])
    want, got = reframe.metrics(made, faces, path).first().asDict(), told.first().asDict()
    assert got == pytest.approx(want) and list(got) == list(want) and want["movement"] > 0


def test_arranged_scans_go_on_where_the_first_one_was(spark) -> None:
    rows = [(v, i, float(i), 100.0 * v + i * i, 50.0 - i, ["a", "b", None][i % 3]) for v in range(3) for i in range(30)]
    frames = spark.createDataFrame(rows, "video_id long, frame_number long, timestamp double, center_x double, center_y double, track string")
    twice = camera.pan(camera.pan(frames).drop("pan_x", "pan_y"), arranged=True)
    assert optimized(twice).count("RepartitionByExpression") == 1
    assert sorted(map(str, twice.collect())) == sorted(map(str, camera.pan(frames).collect()))
