"""Tables of the engine: enums, and the mapping of raw tables onto the memory schema.

``observations``, ``sessions``, ``prompts``, ``tool_usage``, ``relations`` and
``queue`` each take (spark, folder) and read only the columns they map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed sets of the data model.
TYPES = ["bugfix", "decision", "architecture", "discovery", "pattern", "config", "preference", "passive", "session"]
VERBS = ["related", "compatible", "scoped", "conflicts_with", "supersedes", "not_conflict"]
STATUSES = ["pending", "judged", "orphaned", "ignored"]

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.lower(F.concat(strip(title), F.lit("|"), strip(content))), 256)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text", "lang")
    kinds = ",".join(f"'{t}'" for t in TYPES)
    return d.selectExpr(
        "doc_id AS id", "md5(CAST(doc_id AS STRING)) AS sync_id", "CAST(doc_id % 100 AS STRING) AS session_id",
        f"element_at(array({kinds}), CAST(doc_id % 9 AS INT) + 1) AS type", "substring(text, 1, 80) AS title", "text AS content",
        "lang AS project", "CASE WHEN doc_id % 50 = 0 THEN 'global' ELSE 'project' END AS scope",
        "CASE WHEN doc_id % 5 = 0 THEN concat('t/', doc_id % 7) ELSE '' END AS topic_key", "1 AS revision_count", "1 AS duplicate_count",
        f"{EPOCH} + doc_id * INTERVAL '1' MINUTE AS created_at", f"{EPOCH} + make_dt_interval(CAST(doc_id % 13 AS INT)) + doc_id * INTERVAL '1' MINUTE AS updated_at",
        f"{EPOCH} + doc_id * INTERVAL '1' MINUTE AS last_seen_at", f"CASE WHEN doc_id % 17 = 0 THEN {EPOCH} + INTERVAL '1' DAY + doc_id * INTERVAL '1' MINUTE END AS deleted_at",
    ).withColumn("normalized_hash", content_hash(F.col("title"), F.col("content")))


def tool_usage(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.selectExpr("event_id AS id", "CAST(user_id AS STRING) AS session_id", "concat('p', user_id % 10) AS project", "event_type AS tool_name", "ts AS created_at")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("search_count"))
    return e.selectExpr("CAST(user_id AS STRING) AS id", "concat('p', user_id % 10) AS project", "started_at", "last_activity_at", "CASE WHEN user_id % 2 = 0 THEN last_activity_at END AS ended_at", "search_count")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").filter("role = 'user'")
    at = f"{EPOCH} + (conv_id * 3600 + turn * 60) * INTERVAL '1' SECOND"
    return c.selectExpr("conv_id * 1000 + turn AS id", "CAST(conv_id AS STRING) AS session_id", "text AS content", "concat('p', conv_id % 10) AS project", f"{at} AS created_at", f"CASE WHEN (conv_id + turn) % 19 = 0 THEN {at} END AS deleted_at")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id")
    verbs = ",".join(f"'{v}'" for v in VERBS)
    return e.selectExpr(
        "vec_id AS id", "concat('r', vec_id) AS sync_id", "md5(CAST(vec_id AS STRING)) AS source_id", "md5(CAST(vec_id + 1 AS STRING)) AS target_id",
        f"CASE WHEN vec_id % 3 = 1 THEN element_at(array({verbs}), CAST(vec_id % 6 AS INT) + 1) ELSE 'pending' END AS relation", "CASE WHEN vec_id % 4 <> 0 THEN concat('because ', vec_id) END AS reason",
        "CASE WHEN vec_id % 3 = 1 THEN (vec_id % 10) / 10D END AS confidence", "CASE WHEN vec_id % 3 = 1 THEN 'judged' ELSE 'pending' END AS judgment_status",
        "CASE WHEN vec_id % 3 = 1 THEN concat('seen ', vec_id) END AS evidence", "CASE WHEN vec_id % 3 = 1 THEN concat('a', vec_id % 4) END AS marked_by_actor", "CASE WHEN vec_id % 3 = 1 THEN 'agent' END AS marked_by_kind",
        "CASE WHEN vec_id % 3 = 1 THEN 'm0' END AS marked_by_model", "CASE WHEN vec_id % 3 = 1 THEN CAST(vec_id % 100 AS STRING) END AS session_id",
        f"{EPOCH} + vec_id * INTERVAL '1' HOUR AS created_at", f"{EPOCH} + vec_id * INTERVAL '1' HOUR AS updated_at", f"CASE WHEN vec_id % 23 = 0 THEN {EPOCH} + INTERVAL '1' DAY + vec_id * INTERVAL '1' HOUR END AS deleted_at",
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("event_id AS id", "event_type AS entity_type", "to_json(named_struct('user', user_id, 'value', value)) AS payload", "ts AS created_at")


# The same mapping in SQL, for the queries' SQL twins.
_AT = "TIMESTAMP '2024-01-01' + to_minutes(doc_id)"
CTE = {
    "obs": f"""obs AS (SELECT *, sha256(lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g') || '|' || regexp_replace(content, '^\\s+|\\s+$', '', 'g'))) AS normalized_hash FROM (
  SELECT doc_id AS id, md5(CAST(doc_id AS VARCHAR)) AS sync_id, CAST(doc_id % 100 AS VARCHAR) AS session_id, list_extract({TYPES}, CAST(doc_id % 9 + 1 AS INT)) AS type, substr(text, 1, 80) AS title, text AS content,
    lang AS project, CASE WHEN doc_id % 50 = 0 THEN 'global' ELSE 'project' END AS scope, CASE WHEN doc_id % 5 = 0 THEN 't/' || (doc_id % 7) ELSE '' END AS topic_key, 1 AS revision_count, 1 AS duplicate_count,
    {_AT} AS created_at, {_AT} + to_days(CAST(doc_id % 13 AS INT)) AS updated_at, {_AT} AS last_seen_at, CASE WHEN doc_id % 17 = 0 THEN {_AT} + to_days(1) END AS deleted_at FROM documents))""",
    "tools": "tools AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, 'p' || (user_id % 10) AS project, event_type AS tool_name, ts AS created_at FROM events)",
    "sess": "sess AS (SELECT CAST(user_id AS VARCHAR) AS id, 'p' || (user_id % 10) AS project, min(ts) AS started_at, max(ts) AS last_activity_at, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS ended_at, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS search_count FROM events GROUP BY user_id)",
    "prom": "prom AS (SELECT *, CASE WHEN gone THEN created_at END AS deleted_at FROM (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, text AS content, 'p' || (conv_id % 10) AS project, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS created_at, (conv_id + turn) % 19 = 0 AS gone FROM conversations WHERE role = 'user'))",
    "rel": f"rel AS (SELECT vec_id AS id, 'r' || vec_id AS sync_id, md5(CAST(vec_id AS VARCHAR)) AS source_id, md5(CAST(vec_id + 1 AS VARCHAR)) AS target_id, CASE WHEN vec_id % 3 = 1 THEN list_extract({VERBS}, CAST(vec_id % 6 + 1 AS INT)) ELSE 'pending' END AS relation, CASE WHEN vec_id % 4 <> 0 THEN 'because ' || vec_id END AS reason, CASE WHEN vec_id % 3 = 1 THEN (vec_id % 10) / 10.0::DOUBLE END AS confidence, CASE WHEN vec_id % 3 = 1 THEN 'judged' ELSE 'pending' END AS judgment_status, CASE WHEN vec_id % 3 = 1 THEN 'seen ' || vec_id END AS evidence, CASE WHEN vec_id % 3 = 1 THEN 'a' || (vec_id % 4) END AS marked_by_actor, CASE WHEN vec_id % 3 = 1 THEN 'agent' END AS marked_by_kind, CASE WHEN vec_id % 3 = 1 THEN 'm0' END AS marked_by_model, CASE WHEN vec_id % 3 = 1 THEN CAST(vec_id % 100 AS VARCHAR) END AS session_id, TIMESTAMP '2024-01-01' + to_hours(vec_id) AS created_at, TIMESTAMP '2024-01-01' + to_hours(vec_id) AS updated_at, CASE WHEN vec_id % 23 = 0 THEN TIMESTAMP '2024-01-02' + to_hours(vec_id) END AS deleted_at FROM embeddings)",
    "que": "que AS (SELECT event_id AS id, event_type AS entity_type, user_id, value, ts AS created_at FROM events)",
}


def sql(body: str, *names: str) -> str:
    """A query over the mapped tables it names; ``body`` may begin with further CTEs after WITH or WITH RECURSIVE."""
    given = ", ".join(CTE[n] for n in names)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {given}, {body[15:]}"
    return f"WITH {given}, {body[5:]}" if body.startswith("WITH ") else f"WITH {given} {body}"
