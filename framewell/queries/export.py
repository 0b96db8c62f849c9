"""Queries on texts that leave the pipeline and on raw platform texts that come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.functions import render
from framewell.plans import episodes, export, windows
from framewell.queries.clips import _ISLANDS, KEPT, SCORED, _facts_sql, _variety
from framewell.queries.domain import sql, table
from framewell.sources import payloads, transcripts

_DUR, _PASTE = "20.0e0 + video_id % 90", "CASE pos % 4 WHEN 0 THEN 'Chapter 1: x' WHEN 1 THEN concat('0:', lpad(CAST(pos % 60 AS STRING), 2, '0'), '07 seconds[music]') ELSE concat(CAST(pos AS STRING), ':', lpad(CAST(video_id % 60 AS STRING), 2, '0'), '2 minutes, 5 seconds', ' ', speaker) END"


def _durations(s, d):
    return table(s, d, "clips").select("video_id").distinct().selectExpr("video_id", f"{_DUR} AS duration")


def _pasted(s, d):
    rows = table(s, d, "segments").select("video_id", "pos", F.expr(_PASTE).alias("line")).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return rows.select("video_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))


def _video(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet")
    blank = lambda n, c: F.when(F.col("c_custkey") % n != 0, c)
    info = F.struct(blank(11, F.col("c_name")).alias("id"), blank(13, F.concat(F.lit(" "), "c_name")).alias("title"), blank(2, F.lit("chan")).alias("channel"), F.lit("up").alias("uploader"), blank(5, F.lit(7.5)).alias("duration"), blank(3, F.lit("http://p")).alias("webpage_url"), F.array(F.struct(F.lit("a").alias("url")), F.struct(F.lit("b").alias("url"))).alias("thumbnails"))
    return payloads.video_metadata(rows.select(F.col("c_custkey").alias("key"), F.to_json(info).alias("content"))).select("key", "video_id", "title", "channel", "duration_seconds", "webpage_url", "thumbnail_url")


def _report(s, d):
    top = windows.candidate_windows(table(s, d, "signals"), 3)
    return export.reports(top.select("video_id").distinct().selectExpr("video_id", "'v.mp4' AS source", "'t.txt' AS transcript", "video_id % 5 AS n_clips"), top.withColumn("labels", F.array_sort("labels")).withColumn("score", F.floor("score").cast("double")))


def _filters(s, d):
    box = [F.col("l_partkey") % 900 + 0.5, F.col("l_suppkey") % 500 + 0.25, F.col("l_quantity") * 10 + 1.5, F.col("l_linenumber") * 100 + 0.5]
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", render.crop_filter(*[c.cast("double") for c in box]).alias("crop"), render.center_crop_filter(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double") + 1).alias("center"))


def _exported(s, d):
    known = _durations(s, d).selectExpr("video_id", "concat('ep', video_id) AS episode", "'v.mp4' AS source", "'t.srt' AS transcript", "duration")
    made = episodes.stages(known, table(s, d, "clips"), table(s, d, "segments")).results("manifests")[0]
    clips = F.from_json("manifest", "clips array<struct<index: bigint, rank: bigint, subtitles: string>>").clips
    return made.select("video_id", "clips_analyzed", "clips_ranked", "clips_rejected", "clips_exported", F.array_join(F.transform(clips, lambda c: F.concat_ws(":", c["index"].cast("string"), c["rank"].cast("string"), c.subtitles)), ",").alias("clips"))


QUERIES = {
    "clip_prompt": lambda s, d: export.clip_prompts(table(s, d, "clips"), table(s, d, "segments")).select("video_id", "pos", F.md5("prompt").alias("prompt")),
    "episode_exports": _exported,
    "cuttable_clips": lambda s, d: export.cuttable(table(s, d, "clips"), _durations(s, d)).select("video_id", "pos", "index"),
    "pasted_transcript": lambda s, d: transcripts.tidy_pasted(_pasted(s, d)).select("video_id", F.md5("content").alias("content")),
    "video_metadata": _video,
    "episode_report": lambda s, d: _report(s, d).select("video_id", F.md5("report").alias("report")),
    "retry_decision": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", payloads.retry(F.expr("concat(CASE WHEN event_id % 2 = 0 THEN '429 ' ELSE '500 ' END, 'limit: ', event_id % 3, CASE WHEN event_id % 5 = 0 THEN '' ELSE ' retry in 4.5s' END)"), F.col("event_id") % 4, 3).alias("retry")),
    "filled_template": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", export.fill(F.lit("{{a}} of {{b}} in {{c}}"), {"a": F.col("p_name"), "b": F.col("p_brand")}).alias("text"), export.template_name(F.when(F.col("p_partkey") % 2 == 0, "clip_selection").otherwise("other")).alias("name"), F.array_join(export.listed(F.concat("p_type", F.lit(", ,"), "p_brand"), lower=True), "|").alias("items")),
    "render_filters": _filters,
}

_CLOCK = "printf('%02d:%02d:%02d', CAST({0} AS BIGINT) // 3600, CAST({0} AS BIGINT) // 60 % 60, CAST({0} AS BIGINT) % 60)"
ORACLE_SQL = {
    "clip_prompt": sql(f"SELECT c.video_id, c.pos, md5(coalesce(string_agg('[' || {_CLOCK.format('s.seconds')} || '] ' || s.speaker || ': ' || s.text, chr(10) ORDER BY s.seconds, s.pos), '')) AS prompt FROM clips c LEFT JOIN segments s ON s.video_id = c.video_id AND s.seconds >= c.start_seconds AND s.seconds < c.end_seconds GROUP BY 1, 2", "clips", "segments"),
    "episode_exports": sql(f"""WITH {SCORED}, {KEPT}, ranked AS (SELECT video_id, rank, pos, end_seconds FROM {_variety('kept', 10)}), {_facts_sql()},
own AS (SELECT r.video_id, r.rank, r.end_seconds, f.fingerprint, f.duration_seconds BETWEEN 20 AND 90 AND f.silence_ratio <= 0.6e0 AND f.viral_score >= 5 AND NOT f.repeated AS fine FROM ranked r JOIN facts f USING (video_id, pos)),
heads AS (SELECT *, min(CASE WHEN fine THEN rank END) OVER (PARTITION BY video_id, fingerprint) AS head FROM own),
judged AS (SELECT *, fine AND (fingerprint = '' OR head >= rank) AS passed FROM heads),
cut AS (SELECT video_id, rank, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS index FROM judged WHERE passed AND end_seconds <= {_DUR}),
told AS (SELECT video_id, count(*) AS clips_ranked, count(*) FILTER (NOT passed) AS clips_rejected FROM judged GROUP BY 1),
listed AS (SELECT video_id, count(*) AS clips_exported, string_agg(index || ':' || rank || ':ep' || video_id || '/subtitles/clip' || index || '.srt', ',' ORDER BY index) AS clips FROM cut GROUP BY 1)
SELECT video_id, clips_analyzed, coalesce(clips_ranked, 0) AS clips_ranked, coalesce(clips_rejected, 0) AS clips_rejected, coalesce(clips_exported, 0) AS clips_exported, coalesce(clips, '') AS clips
FROM (SELECT video_id, count(*) AS clips_analyzed FROM clips GROUP BY 1) LEFT JOIN told USING (video_id) LEFT JOIN listed USING (video_id)""", "segments", "clips", recursive=True),
    "episode_report": sql(f"""WITH {_ISLANDS.format(source='signals')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY least(10e0, score * 10) DESC, start_seconds, island) AS rank FROM merged)
SELECT video_id, md5('# Episode Export Report' || chr(10) || chr(10) || '- Source video: `v.mp4`' || chr(10) || '- Transcript: `t.txt`' || chr(10) || '- Clips exported: ' || video_id % 5 || chr(10) || chr(10) || '## Candidate Windows' || chr(10) || chr(10)
  || string_agg('- `' || {_CLOCK.format('start_seconds')} || '` → `' || {_CLOCK.format('end_seconds')} || '` score ' || printf('%.1f', floor(least(10e0, score * 10))) || ' (' || array_to_string(list_sort(list_distinct(ls)), ', ') || ')', chr(10) ORDER BY rank) || chr(10)) AS report
FROM ranked WHERE rank <= 3 GROUP BY video_id""", "signals"),
    "cuttable_clips": sql(f"SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS index FROM clips WHERE end_seconds <= {_DUR}", "clips"),
    "pasted_transcript": sql(f"WITH t AS (SELECT video_id, pos, {_CLOCK.format('(pos * 60 + video_id % 60)')} || ' ' || speaker AS line FROM segments WHERE pos % 4 > 1), v AS (SELECT DISTINCT video_id FROM segments) SELECT v.video_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos), '') || chr(10)) AS content FROM v LEFT JOIN t ON v.video_id = t.video_id GROUP BY 1", "segments"),
    "video_metadata": "SELECT c_custkey AS key, c_name AS video_id, c_name AS title, CASE WHEN c_custkey % 2 <> 0 THEN 'chan' ELSE 'up' END AS channel, CASE WHEN c_custkey % 5 <> 0 THEN 7.5e0 ELSE 0e0 END AS duration_seconds, CASE WHEN c_custkey % 3 <> 0 THEN 'http://p' ELSE 'https://www.youtube.com/watch?v=' || c_name END AS webpage_url, 'b' AS thumbnail_url FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0",
    "retry_decision": "SELECT event_id, event_id % 4 < 3 AND event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS retry FROM events",
    "filled_template": "SELECT p_partkey, p_name || ' of ' || p_brand || ' in {{c}}' AS text, CASE WHEN p_partkey % 2 = 0 THEN 'clip_analysis' ELSE 'other' END AS name, lower(trim(p_type)) || '|' || lower(trim(p_brand)) AS items FROM part",
    "render_filters": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_partkey % 900 + 0.5e0, 0) AS BIGINT) AS x, CAST(round_even(l_suppkey % 500 + 0.25e0, 0) AS BIGINT) AS y, CAST(round_even(l_quantity * 10 + 1.5e0, 0) AS BIGINT) AS w, CAST(round_even(l_linenumber * 100 + 0.5e0, 0) AS BIGINT) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, 'crop=' || greatest(2, w - w % 2) || ':' || greatest(2, h - h % 2) || ':' || x || ':' || y || ',scale=1080:1920:flags=lanczos' AS crop,
  CASE WHEN l_partkey / (l_suppkey + 1e0) > 0.5625e0 THEN 'crop=ih*1080/1920:ih:(iw-ih*1080/1920)/2:0,scale=1080:1920' ELSE 'scale=1080:1920:force_original_aspect_ratio=increase,crop=1080:1920' END AS center FROM b""",
}
