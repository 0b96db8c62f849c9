"""Who speaks and who matters in each frame: signals, weighted fusion, shots.

``faces``: video_id, frame_number, timestamp, track_id, x, y, w, h, confidence, and, where a detector gives them, the
landmarks left_eye, right_eye and mouth (structs of x and y, or null). Frames are 1920 by 1080 unless said otherwise.
All faces of a frame have its timestamp. All signals and factors are columns beside a face, so fusion needs no join, and rows
stay partitioned by video and time bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.config import DEFAULTS, Settings
from framewell.functions.geometry import box, frontal
from framewell.operators.islands import run_ids
from framewell.operators.joins import look_up

FRAME = ["video_id", "frame_number"]
BUCKET = "bucket"
#: Tasks that buckets are dealt out to: several sorts of one task's faces are in memory at once, and their shuffled files say little
#: about that, since they compress well.
TASKS = 256
FACTORS = [("currently_speaking", "currently speaking"), ("facial_expression", "expressive face"), ("detection_confidence", "high detection confidence"), ("frame_center", "center of frame"), ("screen_presence", "large screen presence"), ("recent_speaker", "recent speaker"), ("reaction_target", "reaction focus")]


def landmark(faces: DataFrame, name: str) -> Column:
    """A landmark column, or null where ``faces`` has none."""
    return F.col(name) if name in faces.columns else F.lit(None).cast("struct<x: double, y: double>")


def bucket_of(time: str, conf: Settings = DEFAULTS) -> Column:
    """The number of the time bucket that holds a time."""
    return F.floor(F.col(time) / conf.look_up_bucket_seconds)


def within_frame(faces: DataFrame) -> Window:
    """Windows over a frame's faces. The bucket, which follows from the frame, keeps rows where they are."""
    return Window.partitionBy(*[c for c in ("video_id", BUCKET, "frame_number") if c in faces.columns])


def is_first(faces: DataFrame, score: str) -> Column:
    """Whether a face has its frame's best score; of several the first by track."""
    place = F.struct(~F.isnan(score), -F.col(score), "track_id")
    return place == F.min(place).over(within_frame(faces))


def framed(faces: DataFrame) -> DataFrame:
    """One row for each frame: video_id, frame_number, timestamp and ``faces``, an array of the other columns."""
    rest = [c for c in faces.columns if c not in (*FRAME, "timestamp")]
    return faces.groupBy(*FRAME, "timestamp").agg(F.collect_list(F.struct(*rest)).alias("faces"))


def carried(last: DataFrame, name: str) -> DataFrame:
    """From ``last`` (video_id, bucket, track_id, value; value is null where a track is only present) the last value of each track
    before a bucket: video_id, bucket and ``name``, an array of track_id and value for the tracks of ``last`` in that bucket."""
    before = Window.partitionBy("video_id", "track_id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    rows = last.withColumn("value", F.last("value", ignorenulls=True).over(before)).filter("value IS NOT NULL")
    return rows.groupBy("video_id", BUCKET).agg(F.collect_list(F.struct("track_id", "value")).alias(name))


def of_track(values: str, track: Column) -> Column:
    """A track's value in an array that :func:`carried` made, or null."""
    return F.get(F.filter(values, lambda c: c.track_id.eqNullSafe(track)), F.lit(0)).getField("value")


def mouth_at(faces: DataFrame) -> Column:
    """Where a face's mouth is; without a landmark it is guessed low in its box."""
    mouth = landmark(faces, "mouth")
    return F.struct(F.coalesce(mouth.x, F.col("x") + F.col("w") / 2).alias("x"), F.coalesce(mouth.y, F.col("y") + F.col("h") * 0.75).alias("y"))


def movement(frames: DataFrame, faces: DataFrame, at: Column, conf: Settings = DEFAULTS) -> DataFrame:
    """The faces of ``frames`` (see :func:`framed`, with their bucket), one row each, with ``mouth_delta``: how far a track's mouth
    (``at``) moved since the track was last seen, 0 at first.

    Tracks are sorted within a bucket only; where a track was last seen before it comes from its last mouth in each bucket of
    ``faces``, one short row each.
    """
    last = faces.select("video_id", bucket_of("timestamp", conf).alias(BUCKET), "track_id", F.struct("timestamp", "frame_number", mouth_at(faces).alias("at")).alias("m"))
    last = last.groupBy("video_id", BUCKET, "track_id").agg(F.max("m").getField("at").alias("value"))
    rows = frames.join(carried(last, "_left"), ["video_id", BUCKET], "left")
    rows = rows.withColumn("faces", F.transform("faces", lambda f: F.struct(f.alias("_face"), of_track("_left", f.track_id).alias("_from")))).drop("_left")
    rest = [c for c in rows.columns if c != "faces"]
    rows = rows.select(*rest, F.inline("faces")).select(*rest, "_face.*", "_from")
    before = F.coalesce(F.lag(at).over(Window.partitionBy("video_id", BUCKET, "track_id").orderBy("timestamp", "frame_number")), F.col("_from"))
    rows = rows.withColumns({"_at": at, "_before": before})
    dx, dy = F.col("_at.x") - F.col("_before.x"), F.col("_at.y") - F.col("_before.y")
    return rows.withColumn("mouth_delta", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).drop("_at", "_before", "_from")


def heard(frames: DataFrame, speech: DataFrame, energy: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``frames`` with their bucket, ``talking``, whether a spoken span holds the time, and ``audio_energy`` of the nearest audio
    window, the earlier of two, 0 without any. One look-up serves all three: the last speech, the last and the next window."""
    sound = speech.select("video_id", "timestamp", F.col("speech_end").alias("until"))
    sound = sound.unionByName(energy.select("video_id", "timestamp", F.struct(F.col("timestamp").alias("at"), "energy").alias("window")), allowMissingColumns=True)
    wanted = {"_talk": ("until", "backward"), "_back": ("window", "backward"), "_on": ("window", "forward")}
    out = look_up(frames, sound, ["video_id"], "timestamp", wanted, bucket=conf.look_up_bucket_seconds, bucket_as=BUCKET, tasks=TASKS)
    later = F.col("_back").isNull() | ((F.col("_on.at") - F.col("timestamp")) < (F.col("timestamp") - F.col("_back.at")))
    nearest = F.coalesce(F.when(F.col("_on").isNotNull() & later, F.col("_on.energy")).otherwise(F.col("_back.energy")), F.lit(0.0))
    return out.select(*frames.columns, BUCKET, F.coalesce(F.col("timestamp") < F.col("_talk"), F.lit(False)).alias("talking"), nearest.alias("audio_energy"))


def mouth_movement(moved: DataFrame, conf: Settings = DEFAULTS) -> Column:
    """How much a mouth moves, 1 for the one that moves most in its frame."""
    most = F.max("mouth_delta").over(within_frame(moved))
    return F.when((most > 0) & (F.col("mouth_delta") == most), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("mouth_delta") / conf.mouth_scale))


def orientation(faces: DataFrame, width: int, height: int) -> Column:
    return frontal(box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), landmark(faces, "left_eye"), landmark(faces, "right_eye"), F.lit(float(width * height)))


def landmark_signals(faces: DataFrame, width: int = 1920, height: int = 1080, conf: Settings = DEFAULTS) -> DataFrame:
    """The signals that follow from landmarks alone: video_id, frame_number, timestamp, track_id, mouth_delta, mouth_movement and
    face_orientation. Only mouths and orientations are dealt out by bucket, not the boxes that they come from."""
    short = faces.select(*FRAME, "timestamp", "track_id", mouth_at(faces).alias("mouth"), orientation(faces, width, height).alias("face_orientation"))
    frames = framed(short).withColumn(BUCKET, bucket_of("timestamp", conf)).repartition(TASKS, "video_id", BUCKET)
    out = movement(frames, faces, F.col("mouth"), conf)
    return out.withColumn("mouth_movement", mouth_movement(out, conf)).drop("mouth", BUCKET)


def signals(faces: DataFrame, speech: DataFrame, energy: DataFrame, width: int = 1920, height: int = 1080, conf: Settings = DEFAULTS) -> DataFrame:
    """``faces`` with speaker signals and the factors that need no speaker.

    ``speech``: video_id, timestamp, speech_end of spoken spans that do not overlap. ``energy``: video_id, timestamp, energy
    of audio windows; a frame takes the nearest, the earlier of two. ``bucket`` numbers the time buckets: rows are dealt out by
    video and bucket, and what follows (speakers, importance) works within them, so a long video spreads over tasks.
    """
    out = movement(heard(framed(faces), speech, energy, conf), faces, mouth_at(faces), conf)
    frame, area = within_frame(out), F.col("w") * F.col("h")
    out = out.withColumns({"mouth_movement": mouth_movement(out, conf), "_area": F.max(area).over(frame), "_n": F.count("*").over(frame)})
    made = {"expression": F.least(F.lit(1.0), F.col("mouth_delta") / conf.mouth_scale), "face_orientation": orientation(faces, width, height)}
    made["presence"] = F.coalesce(F.try_divide(area, F.col("_area")), F.lit(0.0))
    made["center"] = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("x") + F.col("w") / 2 - width / 2) / (width / 2))
    out = out.withColumns(made)
    timing = F.when(~F.col("talking"), F.lit(0.0)).when((F.col("_n") == 1) | is_first(out, "mouth_movement"), F.lit(1.0)).otherwise(F.lit(0.2))
    return out.withColumn("transcript_timing", timing).drop("talking", "_area", "_n")


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean; a missing part counts 0 with its weight."""
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def speaker_scores(found: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``speaker_score`` of each face, and ``active``: whether it is its frame's speaker, the best score if that suffices."""
    score = weighted([(F.col("transcript_timing"), conf.speaker_weight_transcript), (F.col("mouth_movement"), conf.speaker_weight_mouth), (F.col("face_orientation"), conf.speaker_weight_orientation), (F.col("audio_energy"), conf.speaker_weight_audio)])
    out = found.withColumn("speaker_score", score)
    return out.withColumn("active", is_first(out, "speaker_score") & (F.col("speaker_score") >= conf.speaker_min_confidence))


def speaker_runs(scored: DataFrame) -> DataFrame:
    """Runs of frames with the same speaker: video_id, track_id, confidence, start_time, last. Only frames, in short rows, are sorted
    by video."""
    keys = [c for c in ("video_id", BUCKET, "frame_number") if c in scored.columns]
    frames = scored.groupBy(*keys).agg(F.min("timestamp").alias("timestamp"), F.max(F.when(F.col("active"), F.struct("track_id", "speaker_score"))).alias("best")).select(*FRAME, "timestamp", "best")
    runs = run_ids(frames, ["video_id"], ["timestamp", "frame_number"], F.col("best.track_id")).filter("best IS NOT NULL")
    return runs.groupBy("video_id", "run", F.col("best.track_id").alias("track_id")).agg(F.avg("best.speaker_score").alias("confidence"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("last")).drop("run")


def _end(start: Column, last: Column, conf: Settings) -> Column:
    return F.when(last - start < conf.speaker_min_segment, start + conf.speaker_min_segment).otherwise(last)


def speaker_segments(scored: DataFrame, conf: Settings = DEFAULTS, runs: DataFrame | None = None) -> DataFrame:
    """Runs of frames with the same speaker: video_id, track_id, confidence, start_time, end_time (at least a minimum later)."""
    runs = speaker_runs(scored) if runs is None else runs
    return runs.select("video_id", "track_id", "confidence", "start_time", _end(F.col("start_time"), F.col("last"), conf).alias("end_time"))


def recent_speaker(scored: DataFrame, conf: Settings = DEFAULTS, runs: DataFrame | None = None) -> DataFrame:
    """``recent``: 1 while a track speaks (ends included), else falling with the time since it last did; 0 before.

    A track's spoken spans are its runs of frames with it as speaker, each at least ``speaker_min_segment`` long. Within a time
    bucket they follow from the track's own rows and the numbers of the frames; the last span that a track began before a bucket
    comes from ``runs`` (see :func:`speaker_runs`), one short row for each bucket.
    """
    runs = speaker_runs(scored) if runs is None else runs
    scored = scored if BUCKET in scored.columns else scored.withColumn(BUCKET, bucket_of("timestamp", conf))
    began = runs.select("video_id", bucket_of("start_time", conf).alias(BUCKET), "track_id", F.struct("start_time", "last").alias("value"))
    present = scored.select("video_id", BUCKET, "track_id").distinct().unionByName(began, allowMissingColumns=True)
    was = carried(present.groupBy("video_id", BUCKET, "track_id").agg(F.max("value").alias("value")), "_earlier")
    rows = scored.repartition(TASKS, "video_id", BUCKET).join(was, ["video_id", BUCKET], "left").withColumn("_was", of_track("_earlier", F.col("track_id"))).drop("_earlier")
    rows = rows.withColumn("_frame", F.dense_rank().over(Window.partitionBy("video_id", BUCKET).orderBy("timestamp", "frame_number")))
    along = Window.partitionBy("video_id", BUCKET, "track_id").orderBy("timestamp", "frame_number")
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    spoke = lambda c: F.when(F.col("active"), F.col(c))
    gap = F.col("_frame") - F.last(spoke("_frame"), ignorenulls=True).over(before)
    goes_on = F.coalesce(F.col("_was.last") >= F.col("timestamp"), F.lit(False))
    out = rows.withColumn("_opens", F.when(F.col("active") & (gap.isNull() | (gap > 1)) & ~goes_on, F.col("timestamp")))
    out = out.withColumns({"_start": F.coalesce(F.last("_opens", ignorenulls=True).over(upto), "_was.start_time"), "_last": F.coalesce(F.last(spoke("timestamp"), ignorenulls=True).over(upto), "_was.last")})
    since = F.col("timestamp") - _end(F.col("_start"), F.col("_last"), conf)
    value = F.when(F.col("_last").isNull(), F.lit(0.0)).when(since <= 0, F.lit(1.0)).otherwise(F.exp(-since / conf.recent_decay_seconds))
    return out.withColumn("recent", value).drop("_frame", "_opens", "_was", "_start", "_last")


def importance(scored: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """``score`` and ``reasoning`` of each face, and its ``place`` in the frame, from faces with signals, speaker and ``recent``."""
    frame = within_frame(scored)
    animated = (F.col("expression") >= 0.5).cast("int")
    others = F.sum(animated).over(frame) - animated
    reaction = F.when((F.count("*").over(frame) < 2) | (F.col("expression") >= 0.4) | (others == 0) | (F.col("presence") < 0.5), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("presence") * 0.7 + 0.3))
    values = [F.when(F.col("active"), F.lit(1.0)).otherwise(F.col("speaker_score")), F.col("expression"), F.col("confidence"), F.col("center"), F.col("presence"), F.col("recent"), F.col("reaction")]
    weights = [conf.importance_weight_speaking, conf.importance_weight_expression, conf.importance_weight_detection, conf.importance_weight_center, conf.importance_weight_presence, conf.importance_weight_recent, conf.importance_weight_reaction]
    out = scored.withColumn("reaction", reaction).withColumn("score", weighted(list(zip(values, weights, strict=True))))
    items = F.array(*[F.struct((-v).alias("order"), F.lit(i).alias("i"), F.lit(label).alias("label"), v.alias("v")) for i, (v, (_, label)) in enumerate(zip(values, FACTORS, strict=True))])
    out = out.withColumn("_items", items).withColumn("_strong", F.transform(F.array_sort(F.filter("_items", lambda x: x.v >= conf.reasoning_threshold)), lambda x: x.label))
    out = out.withColumn("reasoning", F.when(F.size("_strong") > 0, F.array_join("_strong", "; ")).otherwise(F.array_min("_items").label)).drop("_items", "_strong")
    return out.withColumn("place", F.row_number().over(frame.orderBy(F.desc("score"), "track_id")).cast("long"))


def rapid_discussion(segments: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Videos whose speakers change often at the end: video_id, rapid."""
    last = F.max(F.struct("start_time", "end_time")).over(Window.partitionBy("video_id")).end_time
    late = segments.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).withColumn("from", last - conf.rapid_seconds).filter(F.col("end_time") >= F.col("from"))
    previous = F.lag("track_id").over(Window.partitionBy("video_id").orderBy("start_time", "track_id"))
    changes = late.withColumn("change", (F.col("track_id") != previous).cast("int")).groupBy("video_id", "n").agg(F.coalesce(F.sum("change"), F.lit(0)).alias("changes"))
    return changes.select("video_id", ((F.col("n") >= conf.rapid_changes) & (F.col("changes") >= conf.rapid_changes - 1)).alias("rapid"))


def by_frame(ranked: DataFrame) -> DataFrame:
    """One row for each frame with faces: video_id, frame_number, ``f``, its faces by place (place, track_id, score, reasoning, active
    and the box ``b``), and ``speaker``."""
    keys = [c for c in ("video_id", BUCKET, "frame_number") if c in ranked.columns]
    item = F.struct("place", "track_id", "score", "reasoning", "active", box(*map(F.col, "xywh")).alias("b"))
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("f"))
    return rows.select(*FRAME, "f", F.array_max(F.transform(F.filter("f", lambda x: x.active), lambda x: x.track_id)).alias("speaker"))


def shots(scored: DataFrame, rapid: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Shot type, target tracks and reason of each frame with faces, by the first rule that holds."""
    return frame_shots(by_frame(scored), rapid, conf).drop("f")


def frame_shots(frames: DataFrame, rapid: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """:func:`shots` of frames as :func:`by_frame` gives them; their faces stay as ``f``."""
    frames = frames.join(rapid, "video_id", "left")
    names = F.transform("f", lambda x: x.track_id)
    size = F.size("f")
    visible = F.array_sort(names)
    group = F.transform(F.filter("f", lambda x: x.score >= conf.group_min), lambda x: x.track_id)
    reacting = F.get(F.filter("f", lambda x: ~x.active & F.contains(x.reasoning, F.lit("reaction focus"))), F.lit(0)).track_id
    top, second = F.get("f", F.lit(0)).score, F.coalesce(F.get("f", F.lit(1)).score, F.lit(0.0))
    pair = F.slice(names, 1, 2)
    rules = [
        (F.col("speaker").isNotNull(), "single_speaker", F.array("speaker"), "follow active speaker"),
        (size >= conf.vote_faces, "vote_reveal", visible, "many participants visible; show the full table"),
        (size >= conf.group_faces, "group_reaction", F.when(F.size(group) > 0, group).otherwise(visible), "group reaction; widen to include multiple faces"),
        (reacting.isNotNull(), "silent_reaction", F.array(reacting), "silent reaction; prioritize the reacting participant"),
        (F.coalesce("rapid", F.lit(False)) & (size >= 2), "conversation", pair, "rapid back-and-forth discussion; include both participants"),
        ((size >= 2) & (top - second <= conf.conversation_gap), "conversation", pair, "balanced importance between two participants"),
        ((size >= 2) & (second >= conf.secondary_min), "conversation", pair, "secondary participant remains conversation-relevant"),
        (F.lit(True), "single_speaker", F.slice(names, 1, 1), "single dominant speaker focus"),
    ]
    cases = None
    for condition, shot, targets, reason in rules:
        value = F.struct(F.lit(shot).alias("shot_type"), targets.alias("targets"), F.lit(reason).alias("reason"))
        cases = F.when(condition, value) if cases is None else cases.when(condition, value)
    return frames.withColumn("s", cases).select(*FRAME, "s.shot_type", "s.targets", "s.reason", "f")


def zoom_of(shot: Column, conf: Settings = DEFAULTS) -> Column:
    zoom = {"single_speaker": conf.zoom_single, "silent_reaction": conf.zoom_single, "conversation": conf.zoom_conversation, "group_reaction": conf.zoom_group, "vote_reveal": conf.zoom_vote, "wide_table": conf.zoom_vote}
    out = F.when(shot == "wide_table", zoom["wide_table"])
    for name, value in zoom.items():
        out = out.when(shot == name, F.lit(value))
    return out.otherwise(F.lit(1.0))
