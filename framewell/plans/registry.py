"""Stages by name, so that a model or tool can stand in for one. A stage is a function from DataFrames to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from framewell.plans import camera, people, ranking, reframe, tracking, windows

Stage = Callable[..., DataFrame]


class UnknownStage(ValueError):
    """No stage of that kind and name is registered."""


_STAGES: dict[str, dict[str, Stage]] = {
    "ranker": {"default": ranking.rank_clips},
    "tracker": {"iou": tracking.track_faces},
    "scene_detector": {"histogram": camera.scene_cuts},
    "speaker_estimator": {"fusion": people.speaker_scores},
    "importance_scorer": {"fusion": people.importance},
    "composition_planner": {"heuristic": reframe.composition},
    "camera_planner": {"pursuit": camera.pursue},
    "temporal_smoother": {"ema": camera.smooth},
    "enrichment": {"transcript": windows.transcript_signals, "scene": windows.scene_signals},
    "analyzer": {},
    "face_detector": {},
    "renderer": {},
}


def register(kind: str, name: str, stage: Stage) -> None:
    """Add or replace a stage of a known kind."""
    if kind not in _STAGES:
        raise UnknownStage(f"unknown kind of stage: {kind}")
    _STAGES[kind][name.strip().lower()] = stage


def get(kind: str, name: str) -> Stage:
    try:
        return _STAGES[kind][name.strip().lower()]
    except KeyError:
        raise UnknownStage(f"no {kind} is called {name!r}; there are: {', '.join(sorted(_STAGES.get(kind, {}))) or 'none'}") from None


def all_signals(inputs: dict[str, tuple]) -> DataFrame:
    """The signals of the named enrichment stages, in order; each name comes with its stage's arguments."""
    return reduce(DataFrame.unionByName, [get("enrichment", name)(*args) for name, args in inputs.items()])
