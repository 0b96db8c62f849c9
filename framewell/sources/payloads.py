"""JSON payloads: timed captions, model answers with clips, clip metadata; and video links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.functions.time import format_timestamp, parse_timestamp
from framewell.sources.transcripts import parse_transcripts

CAPTIONS = "struct<events: array<struct<tStartMs: double, segs: array<struct<utf8: string>>>>>"
CLIP = "struct<start: string, end: string, reason: string, viral_score: double, score: double, emotion: string, hook: string, summary: string>"
METADATA = "struct<title: string, title_variations: array<string>, hook: string, description: string, hashtags: array<string>, call_to_action: string, seo_keywords: array<string>>"
#: The forms of links that name a video, in the order in which they are tried.
LINKS = [
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/watch\?(?:[^#\s]*&)?v=([A-Za-z0-9_-]{11})",
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/shorts/([A-Za-z0-9_-]{11})",
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/live/([A-Za-z0-9_-]{11})",
    r"(?i)(?:https?://)?youtu\.be/([A-Za-z0-9_-]{11})",
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/embed/([A-Za-z0-9_-]{11})",
]


def video_id(link: Column) -> Column:
    """The 11-character id of a link or bare id; null if there is none."""
    bare = F.trim(link)
    found = [F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in LINKS]
    return F.coalesce(F.when(bare.rlike("^[A-Za-z0-9_-]{11}$"), bare), *found)


def watch_link(id_: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), id_)


def caption_segments(raw: DataFrame) -> DataFrame:
    """Segments of timed-caption JSON (video_id, content): an event's fragments joined; blank events go, order is kept."""
    events = raw.select("video_id", F.posexplode(F.from_json("content", CAPTIONS).events).alias("n", "event"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("event.segs", lambda s: F.coalesce(s.utf8, F.lit(""))), ""), r"\s+", " "))
    out = events.select("video_id", "n", (F.coalesce("event.tStartMs", F.lit(0.0)) / 1000).alias("seconds"), text.alias("text")).filter("text <> ''")
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("n")) - 1
    return out.select("video_id", pos.cast("long").alias("pos"), format_timestamp(F.col("seconds")).alias("start"), "seconds", "text")


def subtitle_segments(raw: DataFrame) -> DataFrame:
    """Segments of subtitle files (video_id, format, content): video_id, pos, start, seconds, speaker, text.

    Timed-caption JSON is read as such, vtt, srv3 and ttml as transcript text; files of another format give no rows.
    """
    kind = F.ltrim(F.lower("format"), F.lit("."))
    columns = ["video_id", "pos", "start", "seconds", "speaker", "text"]
    timed = caption_segments(raw.filter(kind == "json3")).withColumn("speaker", F.lit(None).cast("string"))
    return timed.select(*columns).unionByName(parse_transcripts(raw.filter(kind.isin("vtt", "srv3", "ttml")).select("video_id", "content")).select(*columns))


def video_metadata(raw: DataFrame) -> DataFrame:
    """Metadata of videos from a downloader's JSON (key, content). Rows without an id or a title go.

    The uploader stands in for the channel, the original link or one made from the id for the page, and the last of
    several thumbnails for the thumbnail.
    """
    info = F.from_json("content", "struct<id: string, title: string, channel: string, uploader: string, duration: double, view_count: long, upload_date: string, webpage_url: string, original_url: string, thumbnail: string, thumbnails: array<struct<url: string>>, description: string, language: string>")
    full = lambda c: F.nullif(c, F.lit(""))
    rows = raw.select("key", info.alias("i")).filter(F.coalesce(full(F.col("i.id")), F.lit("")) != "").withColumn("title", full(F.trim("i.title"))).filter("title IS NOT NULL")
    link = F.coalesce(full(F.col("i.webpage_url")), full(F.col("i.original_url")), watch_link(F.col("i.id")))
    return rows.select("key", F.col("i.id").alias("video_id"), "title", F.coalesce(full(F.col("i.channel")), "i.uploader").alias("channel"), F.coalesce("i.duration", F.lit(0.0)).alias("duration_seconds"), "i.view_count", "i.upload_date", link.alias("webpage_url"), F.coalesce("i.thumbnail", F.element_at("i.thumbnails", -1).url).alias("thumbnail_url"), "i.description", "i.language")


#: Fixed value: a code fence at the start or the end of an answer.
FENCE = r"(?m)^```(?:json)?\s*|\s*```$"


def strip_fences(text: Column) -> Column:
    """A model's answer without the code fences around it."""
    bare = F.trim(text)
    return F.when(F.startswith(bare, F.lit("```")), F.trim(F.regexp_replace(bare, FENCE, ""))).otherwise(bare)


def clip_answers(answers: DataFrame) -> DataFrame:
    """Clips of model answers (key, content): key, pos (by falling score), start, end, their seconds, viral_score, emotion, hook, reason, summary.

    An answer is a list of clips, an object with ``clips``, or one clip. ``score`` stands for ``viral_score``; a blank
    summary becomes the reason; times are cut to whole seconds; clips that do not end after they start go.
    """
    body = strip_fences(F.col("content"))
    listed = F.from_json(body, f"array<{CLIP}>")
    held = F.from_json(body, f"struct<clips: array<{CLIP}>>").clips
    single = F.from_json(body, CLIP)
    items = F.when(F.startswith(body, F.lit("[")), listed).when(held.isNotNull(), held).when(single.start.isNotNull() & single.end.isNotNull(), F.array(single))
    rows = answers.select("key", F.posexplode(items).alias("n", "c"))
    start, end = F.floor(parse_timestamp(F.col("c.start"))).cast("double"), F.floor(parse_timestamp(F.col("c.end"))).cast("double")
    rows = rows.select("key", "n", start.alias("start_seconds"), end.alias("end_seconds"), F.coalesce("c.viral_score", "c.score").alias("viral_score"), "c.emotion", "c.hook", "c.reason", F.coalesce(F.nullif(F.trim("c.summary"), F.lit("")), F.col("c.reason")).alias("summary"))
    rows = rows.filter("end_seconds > start_seconds AND viral_score BETWEEN 0 AND 10")
    pos = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("viral_score"), "n")) - 1
    return rows.withColumn("pos", pos.cast("long")).withColumn("start", format_timestamp(F.col("start_seconds"))).withColumn("end", format_timestamp(F.col("end_seconds"))).drop("n")


def clip_metadata(answers: DataFrame) -> DataFrame:
    """Clip metadata of answers (key, content): a list, or an object keyed by index, or one object, with 1-based index.

    Hashtags get one ``#``; blank titles go; rows with under three hashtags or keywords or two titles are dropped.
    """
    body = strip_fences(F.col("content"))
    first = F.from_json(body, METADATA)
    keyed = F.from_json(body, f"map<string, {METADATA}>")
    by_index = F.transform(F.array_sort(F.transform(F.map_entries(keyed), lambda e: F.struct(e.key.try_cast("int").alias("k"), e.value.alias("v")))), lambda e: e.v)
    items = F.when(F.startswith(body, F.lit("[")), F.from_json(body, f"array<{METADATA}>")).when(first.title.isNotNull(), F.array(first)).otherwise(by_index)
    rows = answers.select("key", F.posexplode(items).alias("n", "m"))
    tags = F.transform("m.hashtags", lambda t: F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), F.ltrim(t, F.lit("#")))))
    titles = F.filter(F.transform("m.title_variations", lambda t: F.trim(t)), lambda t: t != "")
    rows = rows.filter("size(m.hashtags) >= 3 AND size(m.seo_keywords) >= 3 AND size(m.title_variations) >= 2")
    return rows.select("key", (F.col("n") + 1).cast("long").alias("index"), "m.title", titles.alias("title_variations"), "m.hook", "m.description", tags.alias("hashtags"), "m.call_to_action", "m.seo_keywords")


def select_tracks(tracks: DataFrame, preferred: list[str], formats: list[str]) -> DataFrame:
    """The subtitle track of each video from ``tracks`` (video_id, source manual or auto, language, pos, ext, url).

    Manual ones come first. Languages go by preference, each followed by the available ones that share its prefix, then
    the rest. Of a language's tracks the best format with a link wins, the last of that format; else its first track.
    """
    language = F.col("language")
    ranks = []
    for i, want in enumerate(preferred):
        want = want.strip()
        ranks += [F.when(language == want, F.lit(2 * i)), F.when(F.startswith(language, F.lit(want.split("-")[0])), F.lit(2 * i + 1))]
    exact = [F.when(language == want.strip(), F.lit(2 * i)) for i, want in enumerate(preferred)]
    order = F.least(*exact, *ranks, F.lit(2 * len(preferred) + 1)) if ranks else F.lit(0)
    ext = F.lower(F.coalesce("ext", F.lit("")))
    usable = (ext != "") & F.col("url").isNotNull() & (F.col("url") != "")
    by_format = sum((F.when(usable & (ext == f), F.lit(i - len(formats))).otherwise(F.lit(0)) for i, f in enumerate(formats)), F.lit(0))
    place = F.when(by_format < 0, -F.col("pos")).otherwise(F.col("pos"))
    best = Window.partitionBy("video_id").orderBy(F.when(F.col("source") == "manual", 0).otherwise(1), order, "language", by_format, place)
    return tracks.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def retry(message: Column, attempt: Column, attempts: int) -> Column:
    """Whether a failed call is tried again: a rate limit that says how long to wait, with attempts left and some quota."""
    e = classify_error(message)
    return (attempt < attempts) & e.rate_limited & ~e.no_quota & e.retry_seconds.isNotNull()


#: How a model service's messages tell a rate limit, a wait and that there is no quota.
LIMITED = ("429", "RESOURCE_EXHAUSTED")
WAIT = r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s"
NO_QUOTA = r"(?i)limit:\s*0"


def classify_error(message: Column) -> Column:
    """Whether a model service's error is a rate limit, has no quota at all, and how long it says to wait."""
    limited = F.contains(message, F.lit(LIMITED[0])) | F.contains(message, F.lit(LIMITED[1]))
    delay = F.regexp_extract(message, WAIT, 1).try_cast("double")
    return F.struct(limited.alias("rate_limited"), message.rlike(NO_QUOTA).alias("no_quota"), delay.alias("retry_seconds"))
