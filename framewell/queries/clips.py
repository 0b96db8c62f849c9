"""Queries on clips, transcript windows and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.functions.scoring import CHARGED, EMOTION_INTENSITY
from framewell.plans import analyzers, quality, ranking, windows
from framewell.queries.domain import sql, table

R = "CAST(round({}, 6) AS DOUBLE)"


def _intensity() -> str:
    exact = " ".join(f"WHEN lower(trim(emotion)) = '{k}' THEN {v}e0" for k, v in EMOTION_INTENSITY.items())
    part = " ".join(f"WHEN instr(lower(trim(emotion)), '{k}') > 0 THEN {v}e0" for k, v in EMOTION_INTENSITY.items())
    return f"CASE {exact} {part} ELSE 0.5e0 END"


SCORED = f"""
density AS (
  SELECT c.*, coalesce((SELECT sum(length(s.text)) FROM segments s WHERE s.video_id = c.video_id AND s.seconds >= c.start_seconds AND s.seconds < c.end_seconds), 0) / c.duration_seconds AS dialogue_density FROM clips c
), factors AS (
  SELECT *, {_intensity()} AS emotion_intensity,
    CASE WHEN duration_seconds < 20 OR duration_seconds > 90 THEN 0e0 WHEN duration_seconds BETWEEN 30 AND 60 THEN 1e0 WHEN duration_seconds < 30 THEN (duration_seconds - 20) / 10e0 ELSE (90e0 - duration_seconds) / 30e0 END AS length_score,
    max(dialogue_density) OVER (PARTITION BY video_id) AS most FROM density
), scored AS (
  SELECT *, round(viral_score * 0.4e0 + emotion_intensity * 10 * 0.25e0 + CASE WHEN most > 0 THEN dialogue_density / most ELSE 0e0 END * 10 * 0.2e0 + length_score * 10 * 0.15e0, 3) AS rank_score FROM factors
)"""
KEPT = """
lists AS (
  SELECT video_id, list({'pos': pos, 'a': start_seconds, 'b': end_seconds, 'd': duration_seconds} ORDER BY rank_score DESC, pos) AS items FROM scored GROUP BY video_id
), fold AS (
  SELECT video_id, items, 0 AS i, items[1:0] AS kept FROM lists
  UNION ALL
  SELECT video_id, items, i + 1, CASE WHEN len(list_filter(kept, lambda k: greatest(0e0, least(k.b, items[i + 1].b) - greatest(k.a, items[i + 1].a)) / least(k.d, items[i + 1].d) >= 0.5e0)) > 0 THEN kept ELSE list_append(kept, items[i + 1]) END
  FROM fold WHERE i < len(items)
), chosen AS (
  SELECT video_id, unnest(kept).pos AS pos FROM fold WHERE i = len(items)
), kept AS (
  SELECT s.* FROM scored s SEMI JOIN chosen USING (video_id, pos)
)"""


def _variety(source: str, n: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank_score + CASE WHEN own = 1 THEN 1e0 ELSE 0e0 END DESC, rank_score DESC, pos) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, lower(trim(emotion)) ORDER BY rank_score DESC, pos) AS own FROM {source})) WHERE rank <= {n}"""


def _clips(spark, d):
    return table(spark, d, "clips"), table(spark, d, "segments")


def _facts_sql() -> str:
    return """
met AS (
  SELECT c.video_id, c.pos, s.pos AS line, s.seconds, lower(trim(s.text)) AS said,
    greatest(0e0, coalesce(lead(s.seconds) OVER (PARTITION BY c.video_id, c.pos ORDER BY s.seconds, s.pos), c.end_seconds) - s.seconds) AS speech
  FROM clips c JOIN segments s ON s.video_id = c.video_id AND s.seconds >= c.start_seconds AND s.seconds < c.end_seconds
), agg AS (
  SELECT video_id, pos, sum(least(speech, 5e0)) AS speech, string_agg(said, ' ' ORDER BY seconds, line) AS fingerprint, count(*) <> count(DISTINCT said) AS repeated FROM met GROUP BY 1, 2
), facts AS (
  SELECT c.*, CASE WHEN speech IS NULL THEN 1e0 ELSE 1e0 - least(1e0, speech / duration_seconds) END AS silence_ratio, coalesce(fingerprint, '') AS fingerprint, coalesce(repeated, false) AS repeated
  FROM clips c LEFT JOIN agg USING (video_id, pos)
)"""


def issues_text(spark, d):
    out = quality.check_quality(*_clips(spark, d))
    return out.select("video_id", "pos", "index", "passed", F.array_join(F.transform("issues", lambda x: F.concat(x.code, F.lit(": "), x.message)), "; ").alias("issues"))


def _by_clock(text, start, end):
    """Lines of a text whose second is a multiple of five; some windows are refused, some answered badly."""
    if int(start) % 7 == 3:
        raise analyzers.Refused("not this window")
    if int(start) % 7 == 5:
        return "no clips"
    out = []
    for line in text.split("\n"):
        h, m, sec = map(int, line[1:9].split(":"))
        at = h * 3600 + m * 60 + sec
        out += [{"start_seconds": float(at), "end_seconds": at + 30.0, "viral_score": float(len(line) % 11)}] if at % 5 == 0 else []
    return out


def _analyzed(s, d):
    analyzers.register_analyzer(s, "clips_by_clock", _by_clock)
    return analyzers.analyzed(analyzers.window_texts(table(s, d, "long_segments")), "clips_by_clock").select("video_id", "window_index", "pos", "start_seconds", "end_seconds", "viral_score", "failure_kind")


QUERIES = {
    "dialogue_density": lambda s, d: ranking.dialogue_density(*_clips(s, d)).select("video_id", "pos", F.round("dialogue_density", 6).alias("dialogue_density")),
    "rank_score": lambda s, d: ranking.score_clips(*_clips(s, d)).select("video_id", "pos", "emotion_intensity", F.round("length_score", 6).alias("length_score"), "rank_score"),
    "overlap_dedup": lambda s, d: ranking.remove_overlaps(ranking.score_clips(*_clips(s, d))).select("video_id", "pos", "rank_score"),
    "variety_topk": lambda s, d: ranking.variety(ranking.score_clips(*_clips(s, d)), 3).select("video_id", "rank", "pos", "rank_score"),
    "rank_end_to_end": lambda s, d: ranking.rank_clips(*_clips(s, d)).select("video_id", "rank", "pos", "start_seconds", "end_seconds", "rank_score"),
    "silence_ratio": lambda s, d: quality.silence_ratio(*_clips(s, d)).select("video_id", "pos", F.round("silence_ratio", 6).alias("silence_ratio")),
    "quality_issues": issues_text,
    "quality_filter": lambda s, d: quality.passed_clips(*_clips(s, d)).select("video_id", "pos"),
    "transcript_windows": lambda s, d: windows.transcript_windows(table(s, d, "long_segments")),
    "window_analysis": _analyzed,
    "window_overlap_join": lambda s, d: windows.window_lines(table(s, d, "long_segments")).groupBy("video_id", "index").agg(F.count("*").alias("n_lines"), F.min("seconds").alias("first_line"), F.max("seconds").alias("last_line")),
    "merge_window_clips": lambda s, d: windows.merge_window_clips(table(s, d, "clips").withColumn("window_index", F.col("pos") % 4)).select("video_id", "start_seconds", "end_seconds", "window_index", "pos"),
    "signal_score": lambda s, d: windows.transcript_signals(table(s, d, "segments")).select("video_id", "pos", "start_seconds", F.round("end_seconds", 6).alias("end_seconds"), F.round("score", 6).alias("score"), "label", "details"),
    "signal_islands": lambda s, d: windows.merge_signals(table(s, d, "signals")).select("video_id", "start_seconds", "end_seconds", "score", F.array_join("labels", ",").alias("labels"), F.array_join("signal_types", ",").alias("signal_types"), "details"),
    "candidate_windows": lambda s, d: windows.candidate_windows(table(s, d, "signals").unionByName(windows.scene_signals(table(s, d, "clips")).withColumn("pos", F.col("pos") + 1000000)), 5).select("video_id", "rank", "start_seconds", "end_seconds", F.round("score", 6).alias("score")),
}

_ISLANDS = """
reach AS (
  SELECT *, max(end_seconds) OVER (PARTITION BY video_id ORDER BY start_seconds, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}
), marked AS (
  SELECT *, sum(CASE WHEN start_seconds - before > 3e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_seconds, pos ROWS UNBOUNDED PRECEDING) AS island FROM reach
), merged AS (
  SELECT video_id, island, min(start_seconds) AS start_seconds, min(start_seconds) + least(greatest(max(end_seconds) - min(start_seconds), 20e0), 90e0) AS end_seconds, max(score) AS score,
    list(label ORDER BY start_seconds, pos) AS ls, list(signal_type ORDER BY start_seconds, pos) AS ts, coalesce((list(details ORDER BY start_seconds, pos) FILTER (WHERE details <> ''))[1], '') AS details
  FROM marked GROUP BY 1, 2
)"""
_DISTINCT = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ',')"

ORACLE_SQL = {
    "dialogue_density": sql(f"WITH {SCORED} SELECT video_id, pos, round(dialogue_density, 6) AS dialogue_density FROM density", "segments", "clips"),
    "rank_score": sql(f"WITH {SCORED} SELECT video_id, pos, emotion_intensity, round(length_score, 6) AS length_score, rank_score FROM scored", "segments", "clips"),
    "overlap_dedup": sql(f"WITH {SCORED}, {KEPT} SELECT video_id, pos, rank_score FROM kept", "segments", "clips", recursive=True),
    "variety_topk": sql(f"WITH {SCORED} SELECT video_id, rank, pos, rank_score FROM {_variety('scored', 3)}", "segments", "clips"),
    "rank_end_to_end": sql(f"WITH {SCORED}, {KEPT} SELECT video_id, rank, pos, start_seconds, end_seconds, rank_score FROM {_variety('kept', 10)}", "segments", "clips", recursive=True),
    "silence_ratio": sql(f"WITH {_facts_sql()} SELECT video_id, pos, round(silence_ratio, 6) AS silence_ratio FROM facts", "segments", "clips"),
    "quality_issues": sql(f"""WITH {_facts_sql()}, own AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS index, list_filter([
    CASE WHEN duration_seconds < 20 THEN 'too_short: Clip duration ' || printf('%.1f', duration_seconds) || 's is below minimum 20s' END,
    CASE WHEN duration_seconds > 90 THEN 'too_long: Clip duration ' || printf('%.1f', duration_seconds) || 's exceeds maximum 90s' END,
    CASE WHEN silence_ratio > 0.6e0 THEN 'too_much_silence: Estimated silence ratio ' || CAST(CAST(round(silence_ratio * 100, 0) AS BIGINT) AS VARCHAR) || '% exceeds maximum 60%' END,
    CASE WHEN viral_score < 5 THEN 'low_confidence: Viral score ' || format('{{:.1f}}', round(viral_score, 1)) || ' is below minimum 5.0' END,
    CASE WHEN repeated THEN 'repeated_dialogue: Clip contains repeated dialogue lines' END], lambda x: x IS NOT NULL) AS own FROM facts
), again AS (
  SELECT *, fingerprint <> '' AND coalesce(min(CASE WHEN len(own) = 0 THEN index END) OVER (PARTITION BY video_id, fingerprint) < index, false) AS again FROM own
) SELECT video_id, pos, index, len(own) = 0 AND NOT again AS passed, array_to_string(CASE WHEN again THEN list_append(own, 'repeated_dialogue: Clip dialogue duplicates another clip in the batch') ELSE own END, '; ') AS issues FROM again""", "segments", "clips"),
    "quality_filter": sql(f"""WITH {_facts_sql()}, own AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS index, duration_seconds BETWEEN 20 AND 90 AND silence_ratio <= 0.6e0 AND viral_score >= 5 AND NOT repeated AS fine FROM facts
), first_ AS (SELECT *, min(CASE WHEN fine THEN index END) OVER (PARTITION BY video_id, fingerprint) AS head FROM own)
SELECT video_id, pos FROM first_ WHERE fine AND (fingerprint = '' OR head >= index)""", "segments", "clips"),
    "transcript_windows": sql("""WITH ends AS (SELECT video_id, min(seconds) AS head, max(seconds) + 5 AS total FROM long_segments GROUP BY 1),
numbered AS (SELECT *, unnest(range(0, CASE WHEN total <= 600 THEN 1 ELSE greatest(CAST(ceil((total - head - 600) / 540e0) AS BIGINT), 0) + 1 END)) AS index FROM ends)
SELECT video_id, index, head + index * 540e0 AS start_seconds, CASE WHEN total <= 600 THEN total ELSE least(head + index * 540e0 + 600, total) END AS end_seconds FROM numbered""", "long_segments"),
    "window_analysis": sql("""WITH ends AS (SELECT video_id, min(seconds) AS head, max(seconds) + 5 AS total FROM long_segments GROUP BY 1),
numbered AS (SELECT *, unnest(range(0, CASE WHEN total <= 600 THEN 1 ELSE greatest(CAST(ceil((total - head - 600) / 540e0) AS BIGINT), 0) + 1 END)) AS index FROM ends),
wins AS (SELECT video_id, index, head + index * 540e0 AS a, CASE WHEN total <= 600 THEN total ELSE least(head + index * 540e0 + 600, total) END AS b FROM numbered),
lines AS (SELECT *, coalesce(lead(seconds) OVER (PARTITION BY video_id ORDER BY seconds, pos), seconds + 5) AS e, length('[00:00:00] ' || speaker || ': ' || text) AS long FROM long_segments),
met AS (SELECT w.video_id, index, a, seconds, pos, long FROM wins w JOIN lines l ON l.video_id = w.video_id AND l.e > w.a AND l.seconds < w.b)
SELECT video_id, index AS window_index, row_number() OVER (PARTITION BY video_id, index ORDER BY seconds, pos) - 1 AS pos, seconds AS start_seconds, seconds + 30 AS end_seconds, CAST(long % 11 AS DOUBLE) AS viral_score, CAST(NULL AS VARCHAR) AS failure_kind
FROM met WHERE CAST(a AS BIGINT) % 7 NOT IN (3, 5) AND CAST(seconds AS BIGINT) % 5 = 0
UNION ALL SELECT DISTINCT video_id, index, NULL, NULL, NULL, NULL, CASE CAST(a AS BIGINT) % 7 WHEN 3 THEN 'refused' ELSE 'bad_answer' END FROM met WHERE CAST(a AS BIGINT) % 7 IN (3, 5)""", "long_segments"),
    "window_overlap_join": sql("""WITH ends AS (SELECT video_id, min(seconds) AS head, max(seconds) + 5 AS total FROM long_segments GROUP BY 1),
numbered AS (SELECT *, unnest(range(0, CASE WHEN total <= 600 THEN 1 ELSE greatest(CAST(ceil((total - head - 600) / 540e0) AS BIGINT), 0) + 1 END)) AS index FROM ends),
wins AS (SELECT video_id, index, head + index * 540e0 AS a, CASE WHEN total <= 600 THEN total ELSE least(head + index * 540e0 + 600, total) END AS b FROM numbered),
lines AS (SELECT *, coalesce(lead(seconds) OVER (PARTITION BY video_id ORDER BY seconds, pos), seconds + 5) AS e FROM long_segments)
SELECT w.video_id, index, count(*) AS n_lines, min(seconds) AS first_line, max(seconds) AS last_line FROM wins w JOIN lines l ON l.video_id = w.video_id AND l.e > w.a AND l.seconds < w.b GROUP BY 1, 2""", "long_segments"),
    "merge_window_clips": sql("SELECT video_id, start_seconds, end_seconds, pos % 4 AS window_index, pos FROM clips QUALIFY row_number() OVER (PARTITION BY video_id, start_seconds, end_seconds ORDER BY pos % 4, pos) = 1", "clips"),
    "signal_score": sql(rf"""SELECT video_id, pos, seconds AS start_seconds, round(coalesce(lead(seconds) OVER (PARTITION BY video_id ORDER BY seconds, pos), seconds + greatest(8e0, n * 0.4e0)), 6) AS end_seconds,
  round(least(1e0, 0.35e0 + least(1e0, n / 18e0) * 0.35e0 + CASE WHEN regexp_matches(text, '[!?]') THEN 0.15e0 ELSE 0e0 END + CASE WHEN regexp_matches(text, '{CHARGED}') THEN 0.2e0 ELSE 0e0 END), 6) AS score,
  'dialogue_peak' AS label, substring(text, 1, 120) AS details
FROM (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\s+')) END AS n FROM segments)""", "segments"),
    "signal_islands": sql(f"WITH {_ISLANDS.format(source='signals')} SELECT video_id, start_seconds, end_seconds, score, {_DISTINCT.format('ls')} AS labels, {_DISTINCT.format('ts')} AS signal_types, details FROM merged", "signals"),
    "candidate_windows": sql(f"""WITH every AS (
  SELECT video_id, pos, start_seconds, end_seconds, label, signal_type, score, details FROM signals UNION ALL
  SELECT video_id, pos + 1000000, (start_seconds + end_seconds) / 2 - least(15e0, (end_seconds - start_seconds) / 2), (start_seconds + end_seconds) / 2 + least(15e0, (end_seconds - start_seconds) / 2), 'scene', 'scene_change', 0.6e0, '' FROM clips
), {_ISLANDS.format(source='every')}, ranked AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY least(10e0, score * 10) DESC, start_seconds, island) AS rank, start_seconds, end_seconds, round(least(10e0, score * 10), 6) AS score FROM merged
) SELECT * FROM ranked WHERE rank <= 5""", "signals", "clips"),
}
