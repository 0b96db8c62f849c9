"""Queries on transcript text, payloads and subtitles. Inputs are texts rendered from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.config import Settings
from framewell.functions import render
from framewell.functions.time import format_srt_timestamp, format_timestamp, parse_timestamp
from framewell.operators.store import shared_folder
from framewell.plans import subtitles
from framewell.queries.domain import sql, table
from framewell.sources import payloads, sound, transcripts
from framewell.sources.files import read_files, write_files

SAID = r"concat('say ', trim(regexp_replace(text, '[\\s:]+', ' '{g})))"
SAID_SPARK, SAID_SQL = SAID.format(g=""), SAID.format(g=", 'g'").replace("\\\\", "\\")


def _lines(s, d, fmt: str):
    """Transcripts of one format: (video_id, content)."""
    rows = table(s, d, "segments").select("video_id", "pos", "seconds", "speaker", F.expr(SAID_SPARK).alias("said"))
    clock, stop = format_timestamp(F.col("seconds")), format_timestamp(F.col("seconds") + 4)
    line = {
        "bracket": F.format_string("[%s] %s: %s", clock, "speaker", "said"),
        "inline": F.format_string("%s - %s: %s", clock, "speaker", "said"),
        "multiline": F.format_string("%s\n\n%s:\n%s\nand more\n", clock, "speaker", "said"),
        "srt": F.format_string("%d\n%s,250 --> %s,000\n%s: %s\nand more\n", F.col("pos") + 1, clock, stop, "speaker", "said"),
        "vtt": F.format_string("%s.250 --> %s.000\n%s: %s\n", clock, stop, "speaker", "said"),
    }[fmt]
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    head = F.lit("WEBVTT\n\n" if fmt == "vtt" else "")
    return lists.select("video_id", F.concat(head, F.array_join(F.transform("lines", lambda x: x.line), "\n")).alias("content"))


def _parsed(s, d, fmt: str):
    return transcripts.parse_transcripts(_lines(s, d, fmt)).select("video_id", "pos", "start", "seconds", "speaker", "text")


def _parsed_sql(offset: str = "0e0", more: str = "") -> str:
    clock = "printf('%02d:%02d:%02d', CAST(seconds AS BIGINT) // 3600, CAST(seconds AS BIGINT) // 60 % 60, CAST(seconds AS BIGINT) % 60)"
    return sql(f"SELECT video_id, pos, {clock} AS start, seconds + {offset} AS seconds, speaker, concat(trim({SAID_SQL}), '{more}') AS text FROM segments", "segments")


def _formats(s, d):
    parts = [_lines(s, d, f).select("video_id", F.lit(f).alias("made"), transcripts.detect_format(F.col("content")).alias("format")) for f in ("bracket", "inline", "multiline", "srt", "vtt")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("made", "format").agg(F.count("*").alias("n"))


def _stamps(s, d):
    text = F.format_string("%02d:%02d.%d", F.col("l_orderkey") % 100, F.col("l_partkey") % 60, F.col("l_linenumber"))
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(text.alias("stamp")).withColumn("parsed", parse_timestamp(F.col("stamp")))
    seconds = F.col("parsed")
    return rows.select("stamp", F.round(seconds, 3).alias("seconds"), format_timestamp(seconds).alias("whole"), format_srt_timestamp(seconds).alias("srt"), parse_timestamp(F.concat(F.lit("x"), "stamp")).isNull().alias("refused"))


def _caption_texts(s, d):
    """Timed-caption JSON of each video: (video_id, content)."""
    event = F.struct((F.col("seconds") * 1000).alias("tStartMs"), F.array(F.struct(F.concat(F.col("speaker"), F.lit(" ")).alias("utf8")), F.struct(F.col("said").alias("utf8"))).alias("segs"))
    rows = table(s, d, "segments").select("video_id", "pos", "seconds", "speaker", F.expr(SAID_SPARK).alias("said"))
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", event.alias("e")))).alias("es"))
    return lists.select("video_id", F.to_json(F.struct(F.transform("es", lambda x: x.e).alias("events"))).alias("content"))


def _captions(s, d):
    return payloads.caption_segments(_caption_texts(s, d)).select("video_id", "pos", "seconds", "text")


def _payloads(s, d):
    """Subtitle payloads of three formats by video, and some of a format that is not read."""
    kinds = [("json3", _caption_texts(s, d)), ("vtt", _lines(s, d, "vtt")), (".TTML", _lines(s, d, "inline")), ("lrc", _lines(s, d, "inline"))]
    parts = [texts.filter(F.col("video_id") % 4 == i).select("video_id", F.lit(kind).alias("format"), "content") for i, (kind, texts) in enumerate(kinds)]
    return payloads.subtitle_segments(reduce(DataFrame.unionByName, parts))


def _written(s, files):
    """A new folder that holds ``files`` (name, content); it goes when the session's JVM ends."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    write_files(files, path)
    folder = s._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(s._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def _transcript_files(s, d):
    """Transcripts written as one file each, srt and vtt, and read back."""
    both = _lines(s, d, "srt").filter("video_id % 2 = 0").unionByName(_lines(s, d, "vtt").filter("video_id % 2 = 1"))
    path = _written(s, both.select(F.concat("video_id", F.lit(".txt")).alias("name"), "content"))
    found = transcripts.read_transcripts(s, f"{path}/*.txt")
    return found.withColumn("video_id", F.regexp_extract("video_id", r"(\d+)\.txt$", 1).cast("long")).select("video_id", "pos", "start", "seconds", "speaker", "text")


def _subtitle_files(s, d):
    """Subtitle files of clips under their names, read back as bytes."""
    made = subtitles.clip_files(table(s, d, "clips"), table(s, d, "segments"))
    path = _written(s, made.select(F.concat(F.lit("ep"), "video_id", F.lit("/subtitles/clip"), "pos", F.lit(".srt")).alias("name"), "content"))
    return read_files(s, path, "ep*/subtitles/*.srt").select("name", F.length("content").cast("long").alias("length"), F.md5("content").alias("content"))


def _sound_files(s, d):
    """A WAV file for each supplier, of 8000 samples a second, written and read in ranges of 3001 bytes."""
    value = F.col("l_extendedprice").cast("long") % 60000 - 30000
    little = lambda v, n: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(n)])
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", little(value, 2).alias("hex")).alias("x"))
    lists = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    size = F.size("xs").cast("long") * 2
    head = lambda: F.concat(F.lit("52494646"), little(size + 36, 4), F.lit("57415645666D74201000000001000100401F0000803E00000200100064617461"), little(size, 4))
    content = F.unhex(F.concat(head(), F.array_join(F.transform("xs", lambda x: x.hex), "")))
    path = _written(s, lists.select(F.concat("l_suppkey", F.lit(".wav")).alias("name"), content.alias("content")))
    found = sound.loudness(sound.read_wav(s, path, 3001), Settings(audio_window_seconds=0.025))
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("video_id"), F.round("timestamp", 6).alias("timestamp"), F.round("energy", 6).alias("energy"))


def _scene_log(s, d):
    line = F.format_string("%sframe %d", F.when(F.col("event_id") % 3 == 0, F.format_string("pts_time:%d.5 ", F.col("event_id") % 500)).otherwise(""), "event_id")
    line = F.concat(line, F.when(F.col("event_id") % 6 == 0, F.format_string(" scene:0.%d", F.col("event_id") % 90 + 10)).otherwise(""))
    logs = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("video_id")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return render.scene_log(logs, 0.35).select("video_id", "timestamp", "confidence")


def _answers(s, d):
    rows = table(s, d, "clips").filter("start_seconds < 60")
    clip = F.struct(format_timestamp(F.col("start_seconds")).alias("start"), format_timestamp(F.col("end_seconds") - F.col("pos") % 3 * 40).alias("end"), F.lit("why").alias("reason"), F.col("viral_score").alias("score"), "emotion", F.lit("h").alias("hook"), F.when(F.col("pos") % 2 == 0, "").otherwise("sum").alias("summary"))
    lists = rows.groupBy(F.col("video_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("pos", clip.alias("c")))).alias("cs")).withColumn("cs", F.transform("cs", lambda x: x.c))
    listed, held = F.to_json("cs"), F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("cs").alias("clips"))), F.lit("\n```"))
    content = F.when(F.col("key") % 3 == 0, listed).when(F.col("key") % 3 == 1, held).otherwise(F.to_json(F.get("cs", F.lit(0))))
    return payloads.clip_answers(lists.select("key", content.alias("content"))).select("key", "start_seconds", "end_seconds", "viral_score", "emotion", "summary")


def _metadata(s, d):
    rows = s.read.parquet(f"{d}/part.parquet")
    made = F.struct(F.col("p_name").alias("title"), F.array(F.concat(F.lit(" "), F.col("p_type")), F.lit(" "), F.col("p_brand")).alias("title_variations"), F.lit("h").alias("hook"), F.lit("d").alias("description"), F.array(F.col("p_brand"), F.concat(F.lit("#"), F.col("p_type")), F.lit("a")).alias("hashtags"), F.lit("go").alias("call_to_action"), F.array(F.lit("x"), F.lit("y"), F.when(F.col("p_size") % 2 == 0, "z")).alias("seo_keywords"))
    content = F.when(F.col("p_partkey") % 2 == 0, F.to_json(made)).otherwise(F.to_json(F.array(made)))
    out = payloads.clip_metadata(rows.select(F.col("p_partkey").alias("key"), content.alias("content")))
    return out.select("key", "index", "title", F.array_join("title_variations", "|").alias("titles"), F.array_join("hashtags", " ").alias("hashtags"))


def _video_ids(s, d):
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), F.substring(F.sha2("url", 256), 1, 11))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("http://www.youtube.com/watch?a=1&v="), F.substring(F.sha2("url", 256), 1, 14))).when(F.col("page_id") % 4 == 2, F.substring(F.sha2("url", 256), 1, 11)).otherwise(F.col("url"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", payloads.video_id(link).alias("video_id"))


def _tracks(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS video_id", "CASE WHEN l_returnflag = 'A' THEN 'manual' ELSE 'auto' END AS source", "CASE l_suppkey % 4 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'en' END AS language", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos", "CASE l_linenumber % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'json3' WHEN 2 THEN 'srv3' ELSE 'raw' END AS ext", "CASE WHEN l_quantity < 10 THEN NULL ELSE 'u' END AS url")
    return payloads.select_tracks(rows, ["en", "en-US"], ["vtt", "srv3", "json3", "ttml"]).select("video_id", "source", "language", "pos", "ext")


def _cues(s, d):
    return subtitles.clip_cues(table(s, d, "clips"), table(s, d, "segments"))


QUERIES = {
    "timestamp_parse": _stamps,
    "detect_format": _formats,
    "bracket_parse": lambda s, d: _parsed(s, d, "bracket"),
    "inline_parse": lambda s, d: _parsed(s, d, "inline"),
    "multiline_parse": lambda s, d: _parsed(s, d, "multiline"),
    "srt_parse": lambda s, d: _parsed(s, d, "srt"),
    "vtt_parse": lambda s, d: _parsed(s, d, "vtt"),
    "prompt_text": lambda s, d: transcripts.render_for_prompt(table(s, d, "segments")).select("video_id", F.md5("prompt").alias("prompt")),
    "caption_parse": _captions,
    "subtitle_payloads": _payloads,
    "transcript_files": _transcript_files,
    "subtitle_files": _subtitle_files,
    "sound_files": _sound_files,
    "scene_log": _scene_log,
    "clip_answers": _answers,
    "metadata_normalise": _metadata,
    "url_video_id": _video_ids,
    "track_selection": _tracks,
    "srt_cues": _cues,
    "srt_render": lambda s, d: subtitles.clip_files(table(s, d, "clips"), table(s, d, "segments")).select("video_id", "pos", F.md5("content").alias("content")),
    "subtitle_style": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", subtitles.force_style(F.lit("Arial"), F.col("p_size"), F.lit(2), F.when(F.col("p_partkey") % 3 == 0, F.lit(" White")).otherwise(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))), F.when(F.col("p_size") % 2 == 0, "top").otherwise("bottom")).alias("style")),
    "error_classes": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", payloads.classify_error(F.expr("concat(CASE WHEN event_id % 2 = 0 THEN '429 ' ELSE '500 ' END, 'limit: ', event_id % 3, ' retry in ', event_id % 50, '.5s')")).alias("c")).select("event_id", "c.*"),
}

_CUES = """
met AS (
  SELECT c.video_id, c.pos, row_number() OVER w AS index, greatest(0e0, s.seconds - c.start_seconds) AS a, coalesce(lead(s.seconds) OVER w - c.start_seconds, c.end_seconds - c.start_seconds) AS b0, c.end_seconds - c.start_seconds AS d, s.speaker || ': ' || s.text AS text
  FROM clips c JOIN segments s ON s.video_id = c.video_id AND s.seconds >= c.start_seconds AND s.seconds < c.end_seconds WINDOW w AS (PARTITION BY c.video_id, c.pos ORDER BY s.seconds, s.pos)
), one AS (SELECT *, CASE WHEN b0 - a < 0.5e0 THEN least(a + 2.5e0, d) ELSE b0 END AS b1 FROM met),
cues AS (SELECT video_id, pos, index, round(a, 3) AS start_seconds, round(CASE WHEN b1 <= a THEN least(a + 0.5e0, d) ELSE b1 END, 3) AS end_seconds, text FROM one)"""
_CLOCK = "printf('%02d:%02d:%02d', CAST(seconds AS BIGINT) // 3600, CAST(seconds AS BIGINT) // 60 % 60, CAST(seconds AS BIGINT) % 60)"
_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"

ORACLE_SQL = {
    "timestamp_parse": f"""WITH t AS (SELECT printf('%02d:%02d.%d', l_orderkey % 100, l_partkey % 60, l_linenumber) AS stamp, l_orderkey % 100 * 60000 + l_partkey % 60 * 1000 + CAST(rpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS BIGINT) AS ms FROM lineitem)
SELECT stamp, round(ms / 1000e0, 3) AS seconds, printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) AS whole, {_SRT.format('ms')} AS srt, true AS refused FROM t""",
    "detect_format": "SELECT * FROM (SELECT count(DISTINCT conv_id) AS n FROM conversations), (VALUES ('bracket', 'inline_bracket'), ('inline', 'inline_timestamp'), ('multiline', 'multiline'), ('srt', 'srt'), ('vtt', 'vtt')) AS v(made, format)",
    "bracket_parse": _parsed_sql(),
    "inline_parse": _parsed_sql(),
    "multiline_parse": _parsed_sql(more=" and more"),
    "srt_parse": _parsed_sql("0.25e0", " and more"),
    "vtt_parse": _parsed_sql("0.25e0"),
    "prompt_text": sql("SELECT video_id, md5(string_agg('[' || printf('%02d:%02d:%02d', CAST(seconds AS BIGINT) // 3600, CAST(seconds AS BIGINT) // 60 % 60, CAST(seconds AS BIGINT) % 60) || '] ' || speaker || ': ' || text, chr(10) ORDER BY seconds, pos)) AS prompt FROM segments GROUP BY 1", "segments"),
    "subtitle_payloads": sql(f"""SELECT video_id, pos, {_CLOCK} AS start, seconds + CASE WHEN video_id % 4 = 1 THEN 0.25e0 ELSE 0e0 END AS seconds, CASE WHEN video_id % 4 <> 0 THEN speaker END AS speaker,
  CASE WHEN video_id % 4 = 0 THEN speaker || ' ' ELSE '' END || trim({SAID_SQL}) AS text FROM segments WHERE video_id % 4 <> 3""", "segments"),
    "transcript_files": sql(f"SELECT video_id, pos, {_CLOCK} AS start, seconds + 0.25e0 AS seconds, speaker, concat(trim({SAID_SQL}), CASE WHEN video_id % 2 = 0 THEN ' and more' ELSE '' END) AS text FROM segments", "segments"),
    "subtitle_files": sql(f"""WITH {_CUES}, told AS (SELECT video_id, pos, string_agg(index || chr(10) || {_SRT.format('CAST(round(start_seconds * 1000) AS BIGINT)')} || ' --> ' || {_SRT.format('CAST(round(end_seconds * 1000) AS BIGINT)')} || chr(10) || text, chr(10) || chr(10) ORDER BY index) || chr(10) AS content FROM cues GROUP BY 1, 2)
SELECT 'ep' || video_id || '/subtitles/clip' || pos || '.srt' AS name, CAST(strlen(content) AS BIGINT) AS length, md5(content) AS content FROM told""", "segments", "clips"),
    "sound_files": """WITH v AS (SELECT l_suppkey AS video_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS n, CAST(floor(l_extendedprice) AS BIGINT) % 60000 - 30000 AS value FROM lineitem),
r AS (SELECT video_id, n // 200 AS w, sqrt(avg(value * value)) AS rms FROM v GROUP BY 1, 2)
SELECT video_id, round(w * 0.025e0, 6) AS timestamp, round(rms / max(rms) OVER (PARTITION BY video_id), 6) AS energy FROM r""",
    "scene_log": "SELECT user_id AS video_id, event_id % 500 + 0.5e0 AS timestamp, CASE WHEN event_id % 6 = 0 THEN (event_id % 90 + 10) / 100e0 ELSE 0.35e0 END AS confidence FROM events WHERE event_id % 3 = 0",
    "caption_parse": sql(f"SELECT video_id, pos, seconds, speaker || ' ' || trim({SAID_SQL}) AS text FROM segments", "segments"),
    "clip_answers": sql("""WITH made AS (SELECT video_id AS key, pos, start_seconds, end_seconds - pos % 3 * 40 AS end_seconds, viral_score, emotion, CASE WHEN pos % 2 = 0 THEN 'why' ELSE 'sum' END AS summary, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS n FROM clips)
SELECT key, start_seconds, end_seconds, viral_score, emotion, summary FROM made WHERE end_seconds >= 0 AND end_seconds > start_seconds AND (key % 3 <> 2 OR n = 1)""", "clips"),
    "metadata_normalise": "SELECT p_partkey AS key, 1 AS index, p_name AS title, trim(p_type) || '|' || trim(p_brand) AS titles, '#' || p_brand || ' #' || p_type || ' #a' AS hashtags FROM part",
    "url_video_id": "SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE substring(sha256(url), 1, 11) END AS video_id FROM pages",
    "track_selection": """WITH t AS (SELECT l_orderkey AS video_id, CASE WHEN l_returnflag = 'A' THEN 'manual' ELSE 'auto' END AS source, CASE l_suppkey % 4 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'en' END AS language, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'json3' WHEN 2 THEN 'srv3' ELSE 'raw' END AS ext, l_quantity >= 10 AS ok FROM lineitem),
o AS (SELECT *, CASE language WHEN 'en' THEN 0 WHEN 'en-GB' THEN 1 ELSE 5 END AS lang, CASE WHEN NOT ok THEN 0 WHEN ext = 'vtt' THEN -4 WHEN ext = 'srv3' THEN -3 WHEN ext = 'json3' THEN -2 ELSE 0 END AS f FROM t)
SELECT video_id, source, language, pos, ext FROM o QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE source WHEN 'manual' THEN 0 ELSE 1 END, lang, language, f, CASE WHEN f < 0 THEN -pos ELSE pos END) = 1""",
    "srt_cues": sql(f"WITH {_CUES} SELECT * FROM cues", "segments", "clips"),
    "srt_render": sql(f"WITH {_CUES}, ms AS (SELECT *, CAST(round(start_seconds * 1000) AS BIGINT) AS x, CAST(round(end_seconds * 1000) AS BIGINT) AS y FROM cues) SELECT video_id, pos, md5(string_agg(index || chr(10) || {_SRT.format('x')} || ' --> ' || {_SRT.format('y')} || chr(10) || text, chr(10) || chr(10) ORDER BY index) || chr(10)) AS content FROM ms GROUP BY 1, 2", "segments", "clips"),
    "subtitle_style": """SELECT p_partkey, 'FontName=Arial,FontSize=' || p_size || ',Outline=2,PrimaryColour=' || CASE WHEN p_partkey % 3 = 0 THEN '&H00FFFFFF' ELSE '&H00' || upper(substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2)) END || ',Alignment=' || CASE WHEN p_size % 2 = 0 THEN 8 ELSE 2 END AS style FROM (SELECT *, md5(p_name) AS h FROM part)""",
    "error_classes": "SELECT event_id, event_id % 2 = 0 AS rate_limited, event_id % 3 = 0 AS no_quota, event_id % 50 + 0.5e0 AS retry_seconds FROM events",
}
