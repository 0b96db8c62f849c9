"""Queries on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.plans import catalog
from framewell.queries.domain import sql, table


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


def _clip_page(s, d):
    (clips,) = _t(s, d, "job_clips")
    order = [F.desc("rank_score"), F.col("rank"), F.col("job_id"), F.col("clip_key"), F.col("tie")]
    return catalog.clip_page(clips, order, 100, 50, emotion=" shock", min_score=4.0).select("job_id", "rank", "clip_key", "tie", "rank_score", "viral_score", "total")


def _upsert(s, d):
    projects, jobs = _t(s, d, "projects", "jobs")
    new = jobs.groupBy("project_id").agg(F.count("*").alias("n"), F.max("job_id").alias("m")).filter("n % 2 = 0")
    new = new.select((F.col("project_id") * 2).alias("project_id"), F.lit("new").alias("title"), F.lit(0).cast("int").alias("channel"), F.col("m").cast("double").alias("updated_at"))
    return catalog.upsert(projects, new, ["project_id"])


def _replace(s, d):
    (clips,) = _t(s, d, "job_clips")
    new = clips.filter("job_id % 3 = 0 AND rank <= 2").withColumn("emotion", F.lit("redone"))
    return catalog.replace_by(clips, new, ["job_id"]).groupBy("emotion").agg(F.count("*").alias("n"), F.sum("clip_key").alias("keys"))


def _bundles(s, d):
    (clips,) = _t(s, d, "clips")
    art = lambda name, cond: clips.filter(cond).select("video_id", "pos", F.concat(F.lit(f"{name}/clip"), F.col("pos").cast("string")).alias("path"))
    out = catalog.bundles(clips.select("video_id", "pos"), {"video": art("video", "pos % 2 = 0"), "subtitles": art("subtitles", "pos % 3 = 0")}, ["video_id", "pos"])
    return catalog.manifest(out, ["video", "subtitles"]).select("video_id", "total", "video_count", "subtitles_count", F.md5("bundles").alias("bundles"))


QUERIES = {
    "clip_catalog_page": _clip_page,
    "project_page": lambda s, d: catalog.page(table(s, d, "projects"), [F.desc("updated_at"), F.col("project_id")], 100, 20),
    "recent_jobs": lambda s, d: catalog.page(table(s, d, "jobs"), [F.desc("created_at"), F.col("job_id")], 50),
    "project_summary": lambda s, d: catalog.project_summaries(*_t(s, d, "projects", "jobs", "job_clips")),
    "latest_job_clips": lambda s, d: catalog.project_clips(*_t(s, d, "jobs", "job_clips")).groupBy("project_id").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("n_jobs")),
    "project_upsert": _upsert,
    "replace_clips": _replace,
    "export_manifest": _bundles,
}

ORACLE_SQL = {
    "clip_catalog_page": sql("""WITH f AS (SELECT * FROM job_clips WHERE lower(emotion) = 'shock' AND viral_score >= 4)
SELECT job_id, rank, clip_key, tie, rank_score, viral_score, (SELECT count(*) FROM f) AS total FROM f ORDER BY rank_score DESC, rank, job_id, clip_key, tie LIMIT 100 OFFSET 50""", "job_clips"),
    "project_page": sql("SELECT * FROM projects ORDER BY updated_at DESC, project_id LIMIT 100 OFFSET 20", "projects"),
    "recent_jobs": sql("SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 50", "jobs"),
    "project_summary": sql("""WITH n AS (SELECT project_id, count(*) AS clip_count FROM jobs JOIN job_clips USING (job_id) GROUP BY 1), l AS (SELECT project_id, status AS latest_status FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1)
SELECT p.*, coalesce(clip_count, 0) AS clip_count, latest_status FROM projects p LEFT JOIN n USING (project_id) LEFT JOIN l USING (project_id)""", "projects", "jobs", "job_clips"),
    "latest_job_clips": sql("""WITH l AS (SELECT project_id, job_id AS latest FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1),
o AS (SELECT j.job_id, j.project_id FROM jobs j LEFT JOIN l USING (project_id) WHERE latest IS NULL OR latest = j.job_id)
SELECT project_id, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM job_clips JOIN o USING (job_id) GROUP BY 1""", "jobs", "job_clips"),
    "project_upsert": sql("""WITH n AS (SELECT project_id * 2 AS project_id, 'new' AS title, 0 AS channel, CAST(max(job_id) AS DOUBLE) AS updated_at FROM jobs GROUP BY jobs.project_id HAVING count(*) % 2 = 0)
SELECT * FROM projects WHERE project_id NOT IN (SELECT project_id FROM n) UNION ALL SELECT * FROM n""", "projects", "jobs"),
    "replace_clips": sql("""WITH n AS (SELECT * FROM job_clips WHERE job_id % 3 = 0 AND rank <= 2), a AS (SELECT emotion, clip_key FROM job_clips WHERE job_id NOT IN (SELECT job_id FROM n) UNION ALL SELECT 'redone', clip_key FROM n)
SELECT emotion, count(*) AS n, CAST(sum(clip_key) AS BIGINT) AS keys FROM a GROUP BY 1""", "job_clips"),
    "export_manifest": sql("""WITH b AS (SELECT video_id, pos, CASE WHEN pos % 2 = 0 THEN 'video/clip' || pos END AS video, CASE WHEN pos % 3 = 0 THEN 'subtitles/clip' || pos END AS subtitles FROM clips)
SELECT video_id, count(*) AS total, count(video) AS video_count, count(subtitles) AS subtitles_count,
  md5('[' || string_agg('{"pos":' || pos || coalesce(',"video":"' || video || '"', '') || coalesce(',"subtitles":"' || subtitles || '"', '') || '}', ',' ORDER BY pos) || ']') AS bundles FROM b GROUP BY 1""", "clips"),
}
