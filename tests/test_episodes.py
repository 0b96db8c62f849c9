"""The export of episodes from end to end, file by file."""

from __future__ import annotations

import json
import os

from framewell.plans import episodes, subtitles, windows

EPISODES = "video_id long, episode string, source string, transcript string, duration double"
CLIPS = "video_id long, pos long, start_seconds double, end_seconds double, duration_seconds double, viral_score double, emotion string"
SEGMENTS = "video_id long, pos long, seconds double, speaker string, text string"


def test_export(spark, tmp_path) -> None:
    known = spark.createDataFrame([(1, "one", "a.mp4", "a.srt", 300.0), (2, "two", "b.mp4", "b.srt", 100.0), (3, "none", "c.mp4", "c.srt", 50.0)], EPISODES)
    lines = [(v, i, i * 4.0, "Ann" if i % 2 else None, f"line {v} {i} says something!") for v in (1, 2) for i in range(70)]
    segments = spark.createDataFrame(lines, SEGMENTS)
    clips = spark.createDataFrame(
        [(1, 0, 0.0, 40.0, 40.0, 9.0, "humor"), (1, 1, 100.0, 145.0, 45.0, 8.0, "shock"), (1, 2, 200.0, 205.0, 5.0, 9.5, "humor"), (1, 3, 110.0, 150.0, 40.0, 7.0, "shock"), (2, 0, 40.0, 80.0, 40.0, 8.0, "calm"), (2, 1, 70.0, 120.0, 50.0, 9.9, "calm")], CLIPS)
    metadata = spark.createDataFrame([(1, 1, "Title é", None), (2, 0, "Other", 3)], "video_id long, pos long, title string, views int")
    metrics = spark.createDataFrame([(1, 0, 0.5, 1e-7)], "video_id long, pos long, movement double, jitter double")
    found = windows.candidate_windows(windows.transcript_signals(segments), 2)
    graph = episodes.stages(known, clips, segments, found, metadata, metrics, top_n=5)
    made = {r.video_id: r for r in episodes.export_episodes(str(tmp_path / "out"), graph).collect()}
    got = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert {n for n in got if not n.startswith("_")} == {
        "one/subtitles/clip1.srt", "one/subtitles/clip2.srt", "one/metadata/clip1_metadata.json", "one/reframe/clip2_metrics.json", "one/analysis.json", "one/report.md", "one/manifest.json",
        "two/subtitles/clip1.srt", "two/metadata/clip1_metadata.json", "two/analysis.json", "two/report.md", "two/manifest.json", "none/report.md", "none/manifest.json",
    }
    assert (made[1].clips_analyzed, made[1].clips_ranked, made[1].clips_rejected, made[1].clips_exported) == (4, 3, 1, 2)
    assert (made[2].clips_ranked, made[2].clips_exported) == (2, 1), "a clip beyond the episode's end is not cut"
    assert (made[3].clips_analyzed, made[3].clips_exported) == (0, 0)
    assert got["one/subtitles/clip1.srt"].startswith("1\n00:00:00,000 --> 00:00:04,000\nAnn: line 1 25 says something!\n\n2\n00:00:04,000 --> 00:00:08,000\nline 1 26 says something!\n")
    assert got["one/metadata/clip1_metadata.json"] == '{\n  "index": 1,\n  "title": "Title \\u00e9",\n  "views": null\n}'
    assert got["one/reframe/clip2_metrics.json"] == '{\n  "movement": 0.5,\n  "jitter": 1e-07\n}'
    manifest = json.loads(got["one/manifest.json"])
    assert manifest["source_video"] == "a.mp4" and [c["rank"] for c in manifest["clips"]] == sorted(c["rank"] for c in manifest["clips"])
    assert [c["subtitles"] for c in manifest["clips"]] == ["one/subtitles/clip1.srt", "one/subtitles/clip2.srt"]
    assert [c["metadata"] for c in manifest["clips"]] == ["one/metadata/clip1_metadata.json", None]
    assert [r["issues"][0]["code"] for r in manifest["quality_rejections"]] == ["too_short"]
    assert json.loads(got["none/manifest.json"])["clips"] == [] and got["none/report.md"].endswith("- Clips exported: 0\n")
    assert json.loads(got["one/analysis.json"])["segment_count"] == 70 and "## Candidate Windows" in got["one/report.md"]
    assert "found" in graph.written and "cut" in graph.written, "ranking and checks run once for all files"


def test_single_writers_make_a_file_for_each_clip(spark, tmp_path) -> None:
    cues = spark.createDataFrame([(1, 2, 1, 0.0, 1.5, "a"), (1, 3, 1, 0.0, 2.0, "b")], "video_id long, pos long, index long, start_seconds double, end_seconds double, text string")
    subtitles.write_srt(cues, str(tmp_path / "s"))
    assert sorted(os.listdir(tmp_path / "s")) == ["1-clip2.srt", "1-clip3.srt", "_SUCCESS"]
    assert (tmp_path / "s" / "1-clip2.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\na\n"
