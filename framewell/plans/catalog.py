"""Catalogue of projects, jobs and clips: pages, summaries, upserts and replacement.

``projects``: project_id, title, channel, updated_at. ``jobs``: job_id, project_id, status, created_at. ``clips``: job_id,
rank, rank_score, viral_score, emotion and columns that break ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.operators.islands import first_rows


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; Spark takes the first ``offset + limit`` rows of each partition only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def filter_clips(clips: DataFrame, job_id: int | None = None, emotion: str | None = None, min_score: float | None = None) -> DataFrame:
    """Clips that meet all filters given; emotions are compared without case."""
    if job_id is not None:
        clips = clips.filter(F.col("job_id") == job_id)
    if emotion is not None:
        clips = clips.filter(F.lower("emotion") == emotion.strip().lower())
    if min_score is not None:
        clips = clips.filter(F.col("viral_score") >= min_score)
    return clips


def clip_page(clips: DataFrame, order: list[Column], limit: int, offset: int = 0, **filters) -> DataFrame:
    """A page of the filtered clips, with the number of all that match as ``total``."""
    found = filter_clips(clips, **filters)
    total = found.agg(F.count("*").alias("total"))
    return page(found, order, limit, offset).withColumn("total", total.scalar())


def project_summaries(projects: DataFrame, jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """Projects with the number of clips of all their jobs and the status of their latest job: two grouped joins."""
    per_job = clips.groupBy("job_id").agg(F.count("*").alias("n"))
    counts = jobs.join(per_job, "job_id").groupBy("project_id").agg(F.sum("n").alias("clip_count"))
    latest = first_rows(jobs, ["project_id"], [F.desc("created_at"), F.desc("job_id")]).select("project_id", F.col("status").alias("latest_status"))
    return projects.join(counts, "project_id", "left").join(latest, "project_id", "left").withColumn("clip_count", F.coalesce("clip_count", F.lit(0)).cast("long"))


def project_clips(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """Each project's clips: those of its latest completed job, or those of all its jobs if none has completed."""
    done = first_rows(jobs.filter("status = 'completed'"), ["project_id"], [F.desc("created_at"), F.desc("job_id")]).select("project_id", F.col("job_id").alias("latest"))
    owned = jobs.select("job_id", "project_id").join(done, "project_id", "left").filter("latest IS NULL OR latest = job_id")
    return clips.join(owned.select("job_id", "project_id"), "job_id")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same key, and the others added."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def replace_by(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without any row of a key that ``new`` has, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def bundles(clips: DataFrame, artifacts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``clips`` with a column for each kind of artifact (key, path), joined by the clip's own key and never by its place."""
    for name, table in artifacts.items():
        clips = clips.join(table.select(*key, F.col("path").alias(name)), key, "left")
    return clips


def manifest(bundled: DataFrame, artifacts: list[str]) -> DataFrame:
    """One row of counts per video and its bundles as JSON."""
    counts = [F.count(a).alias(f"{a}_count") for a in artifacts]
    return bundled.groupBy("video_id").agg(F.count("*").alias("total"), *counts, F.to_json(F.array_sort(F.collect_list(F.struct("pos", *artifacts)))).alias("bundles"))
