"""Domain tables derived from the given ones. Their definitions are read by both engines, word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name: (given table, projection).
DOMAIN: dict[str, tuple[str, list[str]]] = {
    "segments": ("conversations", ["conv_id AS video_id", "turn AS pos", "turn * 8.0e0 AS seconds", "role AS speaker", "text"]),
    "long_segments": ("events", ["user_id AS video_id", "event_id AS pos", "event_id % 4000 * 1.0e0 AS seconds", "event_type AS speaker", "concat(event_type, ' ', props) AS text"]),
    "clips": (
        "events",
        ["user_id % 120 AS video_id", "event_id AS pos", "event_id * 7 % 60 * 1.0e0 AS start_seconds", "event_id * 7 % 60 + 10.0e0 + event_id % 83 AS end_seconds", "10.0e0 + event_id % 83 AS duration_seconds", "least(10.0e0, value / 10.0e0) AS viral_score",
         "CASE event_type WHEN 'view' THEN 'shock' WHEN 'click' THEN 'Belief' WHEN 'error' THEN 'betrayal ' WHEN 'purchase' THEN 'calm' ELSE 'humor' END AS emotion"],
    ),
    "signals": ("events", ["user_id AS video_id", "event_id AS pos", "event_id * 7 % 600 * 1.0e0 AS start_seconds", "event_id * 7 % 600 + event_id % 5 * 1.0e0 AS end_seconds", "event_type AS label", "CASE WHEN event_id % 3 = 0 THEN 'scene' ELSE 'dialogue' END AS signal_type", "value / 500.0e0 AS score", "CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS details"]),
    "faces": (
        "lineitem",
        ["l_orderkey % 50 AS video_id", "l_orderkey AS frame_number", "l_orderkey * 0.5e0 AS timestamp", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS face_pos", "l_partkey % 1800 * 1.0e0 AS x", "l_suppkey % 900 * 1.0e0 AS y", "40.0e0 + 4 * l_quantity AS w", "40.0e0 + 5 * l_quantity AS h", "0.5e0 + l_discount AS confidence"],
    ),
    "frames": (
        "events",
        ["user_id AS video_id", "event_id AS frame_number", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.5e0 AS timestamp", "100.0e0 + value * 3.5e0 AS center_x", "100.0e0 + value * 1.5e0 % 700 AS center_y", "200.0e0 + event_id % 37 * 10 AS zoom", "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS near", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS track"],
    ),
    "projects": ("customer", ["c_custkey AS project_id", "c_name AS title", "c_nationkey AS channel", "c_acctbal AS updated_at"]),
    "jobs": ("orders", ["o_orderkey AS job_id", "o_custkey AS project_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status", "o_orderdate AS created_at"]),
    "job_clips": ("lineitem", ["l_orderkey AS job_id", "l_linenumber AS rank", "l_partkey AS clip_key", "l_suppkey AS tie", "l_extendedprice / 10000.0e0 AS rank_score", "l_quantity / 5.0e0 AS viral_score", "CASE l_returnflag WHEN 'A' THEN 'humor' WHEN 'N' THEN 'Shock' ELSE 'calm' END AS emotion"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table from its definition."""
    source, columns = DOMAIN[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` behind the definitions of the domain tables that it uses; ``body`` may start with further ones."""
    heads = [f"{n} AS (SELECT {', '.join(DOMAIN[n][1])} FROM {DOMAIN[n][0]})" for n in names]
    body = body.strip()
    joined = f"{body[5:]}" if body[:5].upper() == "WITH " else None
    with_ = "WITH RECURSIVE" if recursive else "WITH"
    return f"{with_} {', '.join(heads)}, {joined}" if joined else f"{with_} {', '.join(heads)} {body}"
