"""Settings: all thresholds and weights, passed explicitly to the functions that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # joins of spans with points: seconds of a bucket, a little more than most clips
    join_bucket_seconds: float = 120.0
    # look-ups of the nearest row in time: seconds that one sort takes in
    look_up_bucket_seconds: float = 3600.0
    # clips
    max_clips: int = 10
    min_clip_seconds: int = 20
    max_clip_seconds: int = 90
    ideal_min_seconds: float = 30.0
    ideal_max_seconds: float = 60.0
    overlap_threshold: float = 0.5
    variety_bonus: float = 1.0
    weight_viral: float = 0.40
    weight_emotion: float = 0.25
    weight_dialogue: float = 0.20
    weight_length: float = 0.15
    # quality
    min_viral_score: float = 5.0
    max_silence_ratio: float = 0.6
    max_line_seconds: float = 5.0
    # windows
    window_seconds: float = 600.0
    window_overlap_seconds: float = 60.0
    tail_seconds: float = 5.0
    candidate_min_seconds: float = 20.0
    candidate_max_seconds: float = 90.0
    candidate_merge_gap: float = 3.0
    candidate_min_score: float = 0.35
    # subtitles
    min_cue_seconds: float = 0.5
    default_cue_seconds: float = 2.5
    # faces and tracking
    tracking_iou: float = 0.3
    tracking_distance: float = 250.0
    tracking_max_age: int = 5
    # scenes
    scene_threshold: float = 0.35
    scene_min_gap: float = 0.5
    # speakers
    speaker_weight_transcript: float = 0.20
    speaker_weight_mouth: float = 0.40
    speaker_weight_orientation: float = 0.20
    speaker_weight_audio: float = 0.20
    speaker_min_confidence: float = 0.4
    speaker_min_segment: float = 0.3
    audio_window_seconds: float = 0.25
    mouth_scale: float = 12.0
    # importance
    importance_weight_speaking: float = 0.45
    importance_weight_expression: float = 0.15
    importance_weight_detection: float = 0.10
    importance_weight_center: float = 0.10
    importance_weight_presence: float = 0.15
    importance_weight_recent: float = 0.10
    importance_weight_reaction: float = 0.10
    recent_decay_seconds: float = 3.0
    reasoning_threshold: float = 0.55
    # composition
    min_padding: float = 40.0
    forehead_ratio: float = 0.35
    thirds_offset: float = 0.08
    conversation_gap: float = 0.15
    secondary_min: float = 0.45
    group_faces: int = 3
    vote_faces: int = 4
    group_min: float = 0.35
    rapid_seconds: float = 2.0
    rapid_changes: int = 3
    zoom_single: float = 1.0
    zoom_conversation: float = 1.25
    zoom_group: float = 1.45
    zoom_vote: float = 1.7
    target_aspect: float = 9.0 / 16.0
    # camera
    max_pan_speed: float = 280.0
    max_zoom_speed: float = 500.0
    camera_smoothing: float = 0.35
    boundary_tolerance: float = 0.15
    smoothing_strength: float = 0.12
    smoothing_max_jerk: float = 800.0
    zoom_damping: float = 0.5
    # crops
    face_padding: float = 20.0
    visibility_threshold: float = 0.95
    render_fps: float = 30.0
    segment_merge_threshold: float = 20.0
    pan_strength: float = 0.10
    pan_switch_strength: float = 0.22
    pan_deadband: float = 4.0
    cut_pixels: float = 250.0
    cut_zoom: float = 200.0


DEFAULTS = Settings()
