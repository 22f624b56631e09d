"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import activity as act
from ..operators import neighbours as kn
from ..operators import observations as ob
from ..operators import relations as rl
from ..operators import saves as sv
from ..operators import search as se
from ..operators import vectors as ve
from ..sources import mirror, sync
from ..sources import tables as t
from ..sources import transcripts
from ..sources.scratch import children, drop_path, scratch, spool, spread
from ..sources.tables import sql
from ..streaming import exchange as ex
from ..streaming import ordered as od
from ..streaming import replay as rp
from ..streaming import streams

QUERIES: dict = {}
SQL: dict = {}
FIELDS = "type, title, content, id"


def query(twin: str | None, *needs: str):
    """Register the function under its name; ``twin`` is its SQL over the mapped tables it names."""
    def register(f):
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = sql(twin, *needs) if needs else twin
        return f
    return register


# --- lookups, filters, lists ---------------------------------------------------------------------


@query("SELECT id, title, deleted_at FROM obs WHERE id = 17", "obs")
def obs_get_by_id(s, d):
    return t.observations(s, d).filter("id = 17").select("id", "title", "deleted_at")


@query("SELECT id, sync_id FROM obs WHERE sync_id = md5('42')", "obs")
def obs_get_by_sync_id(s, d):
    return t.observations(s, d).filter("sync_id = md5('42')").select("id", "sync_id")


@query("SELECT project, topic_key, id FROM (SELECT *, row_number() OVER (PARTITION BY project, topic_key ORDER BY created_at DESC, id DESC) AS rn FROM obs WHERE deleted_at IS NULL AND topic_key <> '') WHERE rn = 1", "obs")
def obs_by_topic_key_latest(s, d):
    return ob.by_topic_key(t.observations(s, d)).select("project", "topic_key", "id")


@query("SELECT project, normalized_hash, min(id) AS id FROM obs WHERE deleted_at IS NULL GROUP BY ALL", "obs")
def obs_by_hash(s, d):
    return ob.by_hash(t.observations(s, d)).select("project", "normalized_hash", "id")


@query("SELECT id, project, started_at FROM sess WHERE id = '7'", "sess")
def session_get(s, d):
    return t.sessions(s, d).filter("id = '7'").select("id", "project", "started_at")


@query("SELECT id, coalesce(reason, '') AS reason, coalesce(confidence, 0) AS confidence FROM rel WHERE id = 8", "rel")
def relation_get(s, d):
    return t.relations(s, d).filter("id = 8").select("id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("SELECT id, project, scope FROM obs WHERE deleted_at IS NULL AND (project = 'fr' OR scope = 'global')", "obs")
def visible_filter(s, d):
    return ob.visible(t.observations(s, d), "fr").select("id", "project", "scope")


@query("SELECT id FROM obs WHERE deleted_at IS NULL", "obs")
def soft_delete_filter(s, d):
    return ob.live(t.observations(s, d)).select("id")


@query("SELECT id, session_id FROM tools WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-06'", "tools")
def time_range_filter(s, d):
    return act.in_range(t.tool_usage(s, d), "2024-01-05", "2024-01-06").select("id", "session_id")


@query("SELECT id FROM obs WHERE deleted_at IS NULL AND last_seen_at < TIMESTAMP '2024-01-01 08:00:00'", "obs")
def gc_stale(s, d):
    return ob.stale(t.observations(s, d), "2024-03-31 08:00:00", 90).select("id")


@query("SELECT id, created_at FROM obs WHERE deleted_at IS NULL AND (project = 'de' OR scope = 'global') ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20", "obs")
def list_observations_page(s, d):
    return ob.page(ob.visible(t.observations(s, d), "de"), 50, 20, F.desc("created_at"), F.desc("id")).select("id", "created_at")


@query("SELECT id, project FROM obs WHERE deleted_at IS NULL", "obs")
def list_all(s, d):
    return ob.live(t.observations(s, d)).select("id", "project").orderBy("project", "id")


@query("SELECT id FROM obs WHERE deleted_at IS NULL AND session_id = '3'", "obs")
def list_session_observations(s, d):
    return ob.live(t.observations(s, d)).filter("session_id = '3'").select("id", "created_at").orderBy("created_at", "id").select("id")


@query("SELECT id, updated_at FROM obs WHERE deleted_at IS NULL ORDER BY updated_at DESC, id DESC LIMIT 200", "obs")
def list_recent(s, d):
    return ob.page(ob.live(t.observations(s, d)), 200, 0, F.desc("updated_at"), F.desc("id")).select("id", "updated_at")


@query("SELECT id, started_at FROM sess ORDER BY started_at DESC, id LIMIT 20", "sess")
def list_sessions(s, d):
    return ob.page(t.sessions(s, d), 20, 0, F.desc("started_at"), F.asc("id")).select("id", "started_at")


@query("SELECT project, id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started_at DESC, id) AS rn FROM sess WHERE ended_at IS NULL) WHERE rn = 1", "sess")
def active_session(s, d):
    return ob.latest(t.sessions(s, d).filter("ended_at IS NULL"), ["project"], F.desc("started_at"), F.asc("id")).select("project", "id")


@query("SELECT id, session_id FROM prom WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 10", "prom")
def list_prompts(s, d):
    return ob.page(ob.live(t.prompts(s, d)), 10, 0, F.desc("created_at"), F.desc("id")).select("id", "session_id")


@query("SELECT id, entity_type FROM que ORDER BY id LIMIT 200", "que")
def queue_fifo_batch(s, d):
    return t.queue(s, d).orderBy("id").limit(200).select("id", "entity_type")


@query("SELECT project, id, rn FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) AS rn FROM obs) WHERE rn <= 14", "obs")
def retain_newest_n(s, d):
    return ob.newest_n(t.observations(s, d), ["project"], 14).select("project", "id", F.col("rn").cast("long").alias("rn"))


@query("SELECT id, title, updated_at < TIMESTAMP '2024-01-10' AS stale FROM obs WHERE deleted_at IS NULL AND (project = 'es' OR scope = 'global') ORDER BY created_at DESC, id DESC LIMIT 10", "obs")
def mem_context(s, d):
    p = ob.page(ob.visible(t.observations(s, d), "es"), 10, 0, F.desc("created_at"), F.desc("id"))
    return p.select("id", "title", (F.col("updated_at") < F.expr("TIMESTAMP_NTZ '2024-01-10'")).alias("stale"))


@query("SELECT id, project IN ('fr', 'es') AS local_only FROM obs", "obs")
def local_only_split(s, d):
    return t.observations(s, d).select("id", tx.project_name(F.col("project")).isin("fr", "es").alias("local_only"))


# --- writes ---------------------------------------------------------------------------------------


@query("SELECT project, topic_key, min(id) AS id, max_by(title, id) AS title, count(*) AS revision_count FROM obs WHERE topic_key <> '' GROUP BY ALL", "obs")
def upsert_by_topic_key(s, d):
    return ob.upsert_by_topic(t.observations(s, d))


@query("SELECT project, normalized_hash, min(id) AS id, count(*) AS duplicate_count, max(created_at) AS last_seen_at FROM obs WHERE topic_key = '' GROUP BY project, normalized_hash", "obs")
def dedup_by_hash(s, d):
    return ob.dedup_by_hash(t.observations(s, d).filter("topic_key = ''"))


def fold_sql(events: str, then: str) -> str:
    """Saves and deletes (project, k, id, op, topic_key, digest, sync) followed one by one: a list of the rows of each project as state."""
    row = "STRUCT(id BIGINT, topic VARCHAR, digest VARCHAR, sync VARCHAR, revision BIGINT, duplicates BIGINT, cur BIGINT, last BIGINT)"
    put = lambda digest, revision, duplicates, cur: f"struct_pack(id := r.id, topic := r.topic, digest := {digest}, sync := r.sync, revision := {revision}, duplicates := {duplicates}, cur := {cur}, last := e)"
    change = lambda at, new: f"list_transform(rows, lambda r, i: CASE WHEN i = {at} THEN {new} ELSE r END)"
    return f"""WITH RECURSIVE ev AS MATERIALIZED ({events}), st(project, k, rows) AS (
  SELECT DISTINCT project, 0::BIGINT, CAST([] AS {row}[]) FROM ev
  UNION ALL
  SELECT project, k, CASE WHEN op = 'delete' THEN list_filter(rows, lambda r, i: i <> CASE WHEN t > 0 THEN t ELSE h END)
    WHEN t > 0 THEN {change('t', put('d', 'r.revision + 1', 'r.duplicates', 'e'))} WHEN h > 0 THEN {change('h', put('r.digest', 'r.revision', 'r.duplicates + 1', 'r.cur'))}
    WHEN taken THEN rows ELSE list_append(rows, struct_pack(id := e, topic := topic_key, digest := d, sync := sync, revision := 1::BIGINT, duplicates := 1::BIGINT, cur := e, last := e)) END
  FROM (SELECT ev.project, ev.k, op, id AS e, topic_key, digest AS d, sync, rows, CASE WHEN topic_key = '' THEN 0 ELSE coalesce(list_position(list_transform(rows, lambda r: r.topic), topic_key), 0) END AS t,
    coalesce(list_position(list_transform(rows, lambda r: r.digest), digest), 0) AS h, list_contains(list_transform(rows, lambda r: r.sync), sync) AS taken FROM st JOIN ev ON ev.project = st.project AND ev.k = st.k + 1)),
left_over AS (SELECT project, r.* FROM (SELECT project, unnest(rows) AS r FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY project ORDER BY k DESC) = 1))) {then}"""


def log_sql(op: str) -> str:
    return f"SELECT project, row_number() OVER (PARTITION BY project ORDER BY id) AS k, id, {op} AS op, topic_key, normalized_hash AS digest, sync_id AS sync FROM obs"


@query(fold_sql(log_sql("'save'"), "SELECT project, count(*) AS n, CAST(sum(revision) AS BIGINT) AS revisions, CAST(sum(duplicates) AS BIGINT) AS duplicates FROM left_over GROUP BY project"), "obs")
def save_fold_counts(s, d):
    log = t.observations(s, d).select("id", "project", "topic_key", "normalized_hash", "title", F.lit("save").alias("op"))
    return ob.fold_saves(log).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("revision_count").alias("revisions"), F.sum("duplicate_count").alias("duplicates"))


SAVED = """SELECT l.id, l.project, l.sync AS sync_id, l.topic, l.digest AS normalized_hash, l.revision AS revision_count, l.duplicates AS duplicate_count, a.created_at, c.created_at AS updated_at, z.created_at AS last_seen_at, c.type,
CASE WHEN c.id % 2 = 0 THEN 'Edit' ELSE '' END AS tool_name FROM left_over l JOIN obs a ON a.id = l.id JOIN obs c ON c.id = l.cur JOIN obs z ON z.id = l.last"""


@query(fold_sql("""SELECT 'all' AS project, row_number() OVER (ORDER BY id) AS k, id, 'save' AS op, CASE WHEN topic_key = '' THEN '' ELSE project || '|' || topic_key END AS topic_key, project || '|' || normalized_hash AS digest,
  CASE WHEN id % 11 = 0 THEN 's' || (id % 5) ELSE md5('save ' || id) END AS sync FROM obs WHERE coalesce(content, '') <> '' AND id % 13 <> 0""", f"SELECT * REPLACE (split_part(normalized_hash, '|', 1) AS project, split_part(normalized_hash, '|', 2) AS normalized_hash, CASE WHEN topic = '' THEN '' ELSE split_part(topic, '|', 2) END AS topic) FROM ({SAVED})"), "obs")
def save_batches(s, d):
    """Three batches, each merged onto the table that those before left: some titles are empty, project names are untidy, sync ids meet."""
    pick = lambda when, one, other: F.when(F.expr(when), one).otherwise(other)
    saves = t.observations(s, d).select(
        "id", "created_at", pick("id % 11 = 0", F.concat(F.lit("s"), F.expr("id % 5")), "").alias("sync_id"), "session_id", "type", pick("id % 13 = 0", "", F.col("title")).alias("title"), "content",
        pick("id % 2 = 0", "Edit", "").alias("tool_name"), pick("id % 4 = 0", F.concat(F.lit(" "), F.upper("project"), F.lit(" ")), F.col("project")).alias("project"), "topic_key",
    )
    top = saves.agg(F.max("id")).first()[0] or 0
    table = s.createDataFrame([], sv.TABLE)
    for k in range(3):
        table = spool(sv.merged(table, sv.save_batch(table, saves.filter(f"id * 3 div {top + 1} = {k}"))), "saved")
    return table.select("id", "project", "sync_id", F.col("topic_key").alias("topic"), "normalized_hash", "revision_count", "duplicate_count", "created_at", "updated_at", "last_seen_at", "type", "tool_name")


@query("SELECT sync_id, id FROM obs WHERE id % 3 = 0 UNION ALL SELECT sync_id, id FROM obs WHERE id % 3 <> 0 AND id % 2 = 0", "obs")
def insert_or_ignore_sync_id(s, d):
    o = t.observations(s, d)
    return ob.insert_or_ignore(o.filter("id % 3 = 0"), o.filter("id % 2 = 0")).select("sync_id", "id")


@query("SELECT id, CASE WHEN hit THEN 'new ' || id ELSE title END AS title, revision_count + hit::INT AS revision_count FROM (SELECT *, id % 4 = 0 AND deleted_at IS NULL AS hit FROM obs)", "obs")
def partial_update_coalesce(s, d):
    o = t.observations(s, d)
    patch = o.filter("id % 4 = 0").select("id", F.concat(F.lit("new "), "id").alias("new_title"), F.lit(None).cast("string").alias("new_content"), F.lit(None).cast("string").alias("new_type"))
    return ob.partial_update(o, patch).select("id", "title", "revision_count")


@query("SELECT id, CASE WHEN deleted_at IS NULL AND project = 'fr' THEN 'en' ELSE project END AS project FROM obs", "obs")
def merge_projects(s, d):
    return ob.rename_project(t.observations(s, d), "fr", " EN ").select("id", "project")


@query("SELECT id, CASE WHEN id % 10 = 1 THEN TIMESTAMP '2024-02-01' ELSE last_seen_at END AS last_seen_at FROM obs", "obs")
def touch_last_seen(s, d):
    o = t.observations(s, d)
    return ob.touch(o, o.filter("id % 10 = 1"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("id", "last_seen_at")


@query("WITH a AS (SELECT * FROM obs WHERE id % 3 = 0), b AS (SELECT * FROM obs WHERE id % 2 = 0) SELECT id, 0 AS src FROM a UNION ALL SELECT id, 1 FROM b WHERE id NOT IN (SELECT id FROM a)", "obs")
def primary_buffer_coalesce(s, d):
    o = t.observations(s, d)
    return ob.prefer_primary(o.filter("id % 3 = 0"), o.filter("id % 2 = 0")).select("id", "src")


@query("SELECT id, last_activity_at AS ended_at, CASE WHEN search_count % 2 = 0 THEN 's' || search_count ELSE 'old' END AS summary FROM sess", "sess")
def session_end_fold(s, d):
    se_ = t.sessions(s, d).withColumn("new", F.when(F.col("search_count") % 2 == 0, F.concat(F.lit("s"), "search_count")).otherwise(""))
    return se_.select("id", F.col("last_activity_at").alias("ended_at"), F.coalesce(F.nullif("new", F.lit("")), F.lit("old")).alias("summary"))


@query("SELECT id, session_id IN (SELECT id FROM sess) OR session_id = '' AS kept FROM obs", "obs", "sess")
def import_orphan_filter(s, d):
    o, se_ = t.observations(s, d), t.sessions(s, d)
    ok = sync.import_new(o.limit(0), o, se_).select("id", F.lit(True).alias("k"))
    return o.select("id").join(ok, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("kept"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'title' WHEN id % 7 = 0 THEN 'content' ELSE '' END AS error FROM obs", "obs")
def import_validate_split(s, d):
    o = t.observations(s, d).withColumn("title", F.when(F.col("id") % 5 == 0, " ").otherwise("x")).withColumn("content", F.when(F.col("id") % 7 == 0, None).otherwise("x"))
    return sync.split_valid(o).select("id", "error")


@query("SELECT id, '[\"' || id || '\",\"x\"]' AS ids, 2 AS n FROM obs", "obs")
def json_array_roundtrip(s, d):
    made = t.observations(s, d).select("id", F.to_json(F.array(F.col("id").cast("string"), F.lit("x"))).alias("ids"))
    return made.select("id", "ids", F.size(F.from_json("ids", "array<string>")).alias("n"))


@query("SELECT id, TRUE AS same FROM obs", "obs")
def aes_roundtrip(s, d):
    key = F.lit("0123456789abcdef0123456789abcdef")
    o = t.observations(s, d)
    return o.select("id", (F.aes_decrypt(F.unbase64(F.base64(F.aes_encrypt("content", key, F.lit("GCM")))), key, F.lit("GCM")).cast("string") == F.col("content")).alias("same"))


# --- counts and sessions ---------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM obs WHERE deleted_at IS NULL) AS observations, (SELECT count(*) FROM sess) AS sessions, (SELECT count(*) FROM prom WHERE deleted_at IS NULL) AS prompts", "obs", "sess", "prom")
def vault_stats(s, d):
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return one(ob.live(t.observations(s, d)), "observations").crossJoin(one(t.sessions(s, d), "sessions")).crossJoin(one(ob.live(t.prompts(s, d)), "prompts"))


@query("SELECT DISTINCT project FROM obs WHERE deleted_at IS NULL AND project <> ''", "obs")
def distinct_projects(s, d):
    return ob.live(t.observations(s, d)).filter("project <> ''").select("project").distinct()


@query("SELECT project, count(*) AS n FROM obs WHERE deleted_at IS NULL GROUP BY project", "obs")
def count_observations(s, d):
    return ob.live(t.observations(s, d)).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tool_name, count(*) AS n FROM tools WHERE project = 'p1' GROUP BY tool_name ORDER BY n DESC, tool_name LIMIT 5", "tools")
def tool_usage_topk(s, d):
    return t.tool_usage(s, d).filter("project = 'p1'").groupBy("tool_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tool_name").limit(5)


@query("SELECT session_id, count(*) AS n FROM prom WHERE deleted_at IS NULL GROUP BY session_id", "prom")
def session_prompt_count(s, d):
    return ob.live(t.prompts(s, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, count(*) AS n FROM obs WHERE deleted_at IS NULL AND type NOT IN ('passive', 'session') GROUP BY session_id", "obs")
def session_obs_count(s, d):
    return ob.live(t.observations(s, d)).filter("type NOT IN ('passive', 'session')").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


SINCE = "WITH l AS (SELECT session_id, max(created_at) AS m FROM obs WHERE deleted_at IS NULL AND type NOT IN ('passive', 'session') GROUP BY session_id) SELECT session_id, CAST(sum(CASE WHEN m IS NULL OR created_at > m THEN 1 ELSE 0 END) AS BIGINT) AS n FROM prom LEFT JOIN l USING (session_id) WHERE deleted_at IS NULL GROUP BY session_id"


@query(SINCE, "obs", "prom")
def prompts_since_last_save(s, d):
    return act.since_last_save(t.prompts(s, d), t.observations(s, d))


@query(SINCE + " HAVING n > 0 AND n % 3 = 0", "obs", "prom")
def nudge_sessions(s, d):
    return act.since_last_save(t.prompts(s, d), t.observations(s, d)).filter("n > 0 AND n % 3 = 0")


@query("SELECT session_id, max(created_at) AS last_activity FROM (SELECT session_id, created_at FROM tools UNION ALL SELECT session_id, created_at FROM prom WHERE deleted_at IS NULL) GROUP BY session_id", "tools", "prom")
def session_last_activity(s, d):
    return act.activity_events(t.tool_usage(s, d), t.prompts(s, d)).groupBy("session_id").agg(F.max("created_at").alias("last_activity"))


@query("SELECT session_id, count(*) AS n FROM tools WHERE tool_name = 'view' GROUP BY session_id", "tools")
def session_search_count(s, d):
    return t.tool_usage(s, d).filter("tool_name = 'view'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN ended_at IS NOT NULL THEN 'cerrada' WHEN last_activity_at < TIMESTAMP '2024-01-30 11:30:00' THEN 'inactiva' ELSE 'activa' END AS status FROM sess", "sess")
def session_status(s, d):
    return t.sessions(s, d).select("id", act.status(F.col("last_activity_at"), F.col("ended_at"), "2024-01-30 12:00:00").alias("status"))


@query("SELECT id, CASE WHEN m < 1 THEN 'ahora' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS age FROM (SELECT id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_activity_at)) // 60000000 AS m FROM sess)", "sess")
def format_age(s, d):
    return t.sessions(s, d).select("id", act.age_label(F.col("last_activity_at"), "2024-01-31 00:00:00").alias("age"))


@query("SELECT t.id, t.session_id FROM tools t JOIN sess s ON s.id = t.session_id WHERE t.tool_name IN ('click', 'purchase') AND s.search_count % 5 = 0", "tools", "sess")
def gate_violations(s, d):
    few = t.sessions(s, d).withColumn("search_count", F.col("search_count") % 5)
    return act.gate_violations(t.tool_usage(s, d), few, ["click", "purchase"]).select("id", "session_id")


@query("SELECT count(*) AS n FROM que", "que")
def queue_depth(s, d):
    return t.queue(s, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, created_at, kind, id FROM (SELECT session_id, created_at, 'tool' AS kind, id FROM tools UNION ALL SELECT session_id, created_at, 'prompt', id FROM prom WHERE deleted_at IS NULL)", "tools", "prom")
def activity_events(s, d):
    return act.activity_events(t.tool_usage(s, d), t.prompts(s, d))


@query("SELECT id FROM sess WHERE id IN (SELECT session_id FROM tools WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-07')", "sess", "tools")
def sessions_in_range(s, d):
    return act.sessions_in_range(t.sessions(s, d), t.tool_usage(s, d), "2024-01-05", "2024-01-07").select("id")


def gap_sql(keys: str, then: str, source: str = "tools") -> str:
    part, cols = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    return f"WITH e AS (SELECT {cols}epoch_us(created_at) AS us, lag(epoch_us(created_at)) OVER ({part}ORDER BY created_at, id) AS pu FROM {source}), g AS (SELECT * FROM e WHERE us > pu AND us - pu <= 1800000000), s AS (SELECT {cols}d, least(us, (d + 1) * 86400000000) - greatest(pu, d * 86400000000) AS part FROM g, unnest(range(pu // 86400000000, us // 86400000000 + 1)) AS t(d)) {then}"


DAY = "strftime(DATE '1970-01-01' + CAST(d AS INT), '%Y-%m-%d')"


@query(gap_sql("", f"SELECT {DAY} AS day, CAST(sum(part) // 60000000 AS BIGINT) AS minutes FROM s GROUP BY d"), "tools")
def timesheet_daily(s, d):
    return act.daily_minutes(t.tool_usage(s, d), [])


@query(gap_sql("session_id", f"SELECT session_id, {DAY} AS day, CAST(sum(part) // 60000000 AS BIGINT) AS minutes FROM s GROUP BY session_id, d"), "tools")
def timesheet_session_day(s, d):
    return act.daily_minutes(t.tool_usage(s, d), ["session_id"])


@query(gap_sql("session_id", "SELECT session_id, CAST(sum(us - pu) // 60000000 AS BIGINT) AS minutes FROM g GROUP BY session_id"), "tools")
def active_minutes_total(s, d):
    return act.total_minutes(t.tool_usage(s, d), ["session_id"])


RANGED = "(SELECT * FROM tools WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-09')"


@query(gap_sql("session_id", f"SELECT f.session_id, 'p' || (CAST(f.session_id AS BIGINT) % 10) AS project, coalesce({DAY}, first_day) AS day, coalesce(m, 0) AS minutes FROM (SELECT session_id, strftime(min(created_at), '%Y-%m-%d') AS first_day FROM {RANGED} GROUP BY session_id) f LEFT JOIN (SELECT session_id, d, CAST(sum(part) // 60000000 AS BIGINT) AS m FROM s GROUP BY session_id, d) x USING (session_id)", RANGED), "tools")
def timesheet_report(s, d):
    return act.timesheet(t.sessions(s, d), t.tool_usage(s, d), "2024-01-05", "2024-01-09")


OVERLAP = f"""
o AS (SELECT {DAY} AS day, CAST(sum(m) AS BIGINT) AS own FROM (SELECT session_id, d, CAST(sum(part) // 60000000 AS BIGINT) AS m FROM so GROUP BY session_id, d) GROUP BY d), w AS (SELECT {DAY} AS day, CAST(sum(part) // 60000000 AS BIGINT) AS minutes FROM sw GROUP BY d)"""


def parts_sql(name: str, keys: str, source: str) -> str:
    """CTEs e, g and s of ``gap_sql`` under other names."""
    return gap_sql(keys, "", source)[5:].replace("e AS (SELECT", f"e{name} AS (SELECT", 1).replace("g AS (SELECT * FROM e ", f"g{name} AS (SELECT * FROM e{name} ").replace("s AS (SELECT", f"s{name} AS (SELECT").replace("FROM g, unnest", f"FROM g{name}, unnest").strip()


@query(f"WITH {parts_sql('o', 'session_id', 'tools')}, {parts_sql('w', '', 'tools')}, {OVERLAP} SELECT day, own, minutes, own > minutes AS overlap FROM o JOIN w USING (day)", "tools")
def timesheet_overlap(s, d):
    return act.overlapping(t.tool_usage(s, d))


ALL_EVENTS = "(SELECT session_id, created_at, id FROM tools WHERE session_id IN (SELECT id FROM sess) AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-09' UNION ALL SELECT session_id, created_at, id FROM prom WHERE deleted_at IS NULL AND session_id IN (SELECT id FROM sess) AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-09')"


@query(f"""WITH ev AS {ALL_EVENTS}, {parts_sql('o', 'session_id', 'ev')}, {parts_sql('w', '', 'ev')},
f AS (SELECT session_id, strftime(min(created_at), '%Y-%m-%d') AS first_day FROM ev GROUP BY session_id),
x AS (SELECT session_id, {DAY} AS day, CAST(sum(part) // 60000000 AS BIGINT) AS m FROM so GROUP BY session_id, d), w AS (SELECT {DAY} AS day, CAST(sum(part) // 60000000 AS BIGINT) AS m FROM sw GROUP BY d),
n AS (SELECT session_id, list(id ORDER BY id) AS ids FROM obs WHERE deleted_at IS NULL GROUP BY session_id),
r AS (SELECT f.session_id, coalesce(x.day, first_day) AS day, coalesce(x.m, 0) AS minutes, first_day FROM f LEFT JOIN x USING (session_id))
SELECT r.day, r.session_id, minutes, coalesce(w.m, 0) AS day_minutes, (SELECT CAST(sum(us - pu) // 60000000 AS BIGINT) FROM gw) AS total_minutes, CASE WHEN r.day = first_day AND ids IS NOT NULL THEN array_to_string(ids, ',') ELSE '' END AS observations
FROM r LEFT JOIN w ON w.day = r.day LEFT JOIN n ON n.session_id = r.session_id""", "tools", "prom", "sess", "obs")
def timesheet_full(s, d):
    events = act.activity_events(t.tool_usage(s, d), t.prompts(s, d))
    out = act.report(t.sessions(s, d), events, t.observations(s, d), "2024-01-05", "2024-01-09")
    return out.withColumn("observations", F.array_join(F.col("observations").cast("array<string>"), ","))


@query("SELECT id FROM sess WHERE id IN (SELECT session_id FROM tools WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-05 03:00:00' UNION SELECT session_id FROM prom WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-05 03:00:00')", "sess", "tools", "prom")
def sessions_in_range_all(s, d):
    return act.sessions_in_range(t.sessions(s, d), act.activity_events(t.tool_usage(s, d), t.prompts(s, d)), "2024-01-05", "2024-01-05 03:00:00").select("id")


LIMITED = """WITH RECURSIVE ev AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY created_at, id) AS k, id, epoch_us(created_at) AS us FROM tools),
st(project, k, id, admitted, taken) AS (SELECT DISTINCT project, 0::BIGINT, NULL::BIGINT, FALSE, CAST([] AS BIGINT[]) FROM ev
  UNION ALL SELECT project, k, id, len(t) < 3, CASE WHEN len(t) < 3 THEN list_append(t, us) ELSE t END FROM (SELECT ev.project, ev.k, ev.id, us, list_filter(taken, lambda x: x > us - 86400000000) AS t FROM st JOIN ev ON ev.project = st.project AND ev.k = st.k + 1))
SELECT id, admitted FROM st WHERE k > 0"""


@query(LIMITED, "tools")
def rate_limit_exact(s, d):
    """Calls of each project, three in a day."""
    return act.rate_limited(t.tool_usage(s, d), ["project"], 3, 86_400)


@query(LIMITED, "tools")
def rate_limit_stream(s, d):
    """The same from a stream in four slices of time, some calls a while late."""
    calls = t.tool_usage(s, d).select("project", "id", "created_at")
    return od.through(calls, 4, lambda e: od.limited(e, ["project"], 3, 86_400, "1 hour")).select("id", (F.col("verdict") == "admitted").alias("admitted"))


REMINDED = """WITH RECURSIVE ev AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, id) AS k, id, kind, us FROM (
    SELECT session_id, id, CASE tool_name WHEN 'purchase' THEN 'save' WHEN 'click' THEN 'action' ELSE CASE WHEN id % 40 = 0 THEN 'end' WHEN id % 40 = 1 THEN 'start' ELSE 'check' END END AS kind, epoch_us(created_at) AS us FROM tools
    UNION ALL SELECT id, -1, 'start', epoch_us(started_at) FROM sess)),
st(session_id, k, id, started, saved, done, reason) AS (SELECT DISTINCT session_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0, NULL::VARCHAR FROM ev
  UNION ALL SELECT session_id, k, id, CASE kind WHEN 'start' THEN us WHEN 'end' THEN NULL ELSE started END, CASE WHEN kind = 'start' OR kind = 'save' AND started IS NOT NULL THEN us ELSE saved END,
    CASE WHEN kind = 'start' OR r = 'actions' THEN 0 WHEN kind = 'action' AND started IS NOT NULL THEN done + 1 ELSE done END, r
  FROM (SELECT ev.session_id, ev.k, ev.id, kind, us, started, saved, done, CASE WHEN kind = 'check' AND us - started >= 120000000 THEN CASE WHEN done >= 2 AND us - saved > 300000000 THEN 'actions' WHEN us - saved > 600000000000 THEN 'time' END END AS r
    FROM st JOIN ev ON ev.session_id = st.session_id AND ev.k = st.k + 1))
SELECT session_id, id, reason FROM st WHERE reason IS NOT NULL"""


def _session_events(s, d):
    """Each session starts at its first call; purchases are saves, clicks significant actions, of the views some end or start it and the others are checks."""
    view = F.when(F.col("id") % 40 == 0, "end").when(F.col("id") % 40 == 1, "start").otherwise("check")
    kinds = F.when(F.col("tool_name") == "purchase", "save").when(F.col("tool_name") == "click", "action").otherwise(view)
    calls = t.tool_usage(s, d).select("session_id", "id", "created_at", kinds.alias("kind"))
    starts = t.sessions(s, d).select(F.col("id").alias("session_id"), F.lit(-1).cast("bigint").alias("id"), F.col("started_at").alias("created_at"), F.lit("start").alias("kind"))
    return calls.unionByName(starts)


@query(REMINDED, "tools", "sess")
def activity_nudges(s, d):
    return act.nudges(_session_events(s, d), 2, 10_000)


@query(REMINDED, "tools", "sess")
def nudge_stream(s, d):
    """The same from a stream in four slices of time, some events a while late; the end of a session removes its state."""
    return od.through(_session_events(s, d), 4, lambda e: od.reminders(e, 2, 10_000))


@query("SELECT id, project, started_at, last_activity_at FROM sess UNION ALL SELECT 'n' || id, project || '-x', started_at, started_at FROM sess WHERE CAST(id AS BIGINT) % 5 = 0", "sess")
def session_create(s, d):
    now = t.sessions(s, d)
    new = now.filter("CAST(id AS BIGINT) % 5 = 0").select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit(" "), F.upper("project"), F.lit("/x")).alias("project"), "started_at")
    return act.started(now, new.unionByName(now.select("id", "project", F.col("last_activity_at").alias("started_at")))).select("id", "project", "started_at", "last_activity_at")


@query("WITH e AS (SELECT session_id, created_at, CASE WHEN tool_name = 'purchase' THEN 'bought ' || id ELSE '' END AS summary FROM tools WHERE tool_name IN ('purchase', 'click')) SELECT sess.id, coalesce(x.e, ended_at) AS ended_at, coalesce(x.said, 'old') AS summary FROM sess LEFT JOIN (SELECT session_id, max(created_at) AS e, max_by(summary, created_at) FILTER (WHERE summary <> '') AS said FROM e GROUP BY session_id) x ON x.session_id = sess.id", "sess", "tools")
def session_end_events(s, d):
    ends = t.tool_usage(s, d).filter("tool_name IN ('purchase', 'click')").select("session_id", "created_at", F.when(F.col("tool_name") == "purchase", F.concat(F.lit("bought "), "id")).otherwise("").alias("summary"))
    return act.ended(t.sessions(s, d).withColumn("summary", F.lit("old")), ends).select("id", "ended_at", "summary")


@query("SELECT id, session_id, project FROM prom WHERE id % 2 = 0 UNION ALL SELECT id + 1000000000, session_id, project FROM prom WHERE content <> '' AND id % 3 > 0", "prom")
def prompt_append(s, d):
    p = t.prompts(s, d).select("id", "session_id", "project", "content")
    new = p.withColumn("id", F.col("id") + 1_000_000_000).withColumn("project", F.when(F.expr("(id - 1000000000) % 3 > 0"), F.col("project")).otherwise(""))
    return p.filter("id % 2 = 0").unionByName(act.valid_prompts(new)).select("id", "session_id", "project")


@query("SELECT id, session_id, tool_name FROM tools UNION ALL SELECT id + 1000000000, session_id, 'mem_search' FROM tools WHERE tool_name = 'view'", "tools")
def tool_use_append(s, d):
    u = t.tool_usage(s, d)
    calls = u.filter("tool_name = 'view'").select("session_id", "project", F.lit("mem_search").alias("tool_name"), F.col("id").alias("n"))
    return act.with_calls(u, calls, F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'"), F.lit(1_000_000_000)).select("id", "session_id", "tool_name")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN TIMESTAMP '2024-05-01' ELSE deleted_at END AS again, CASE WHEN id % 7 = 0 AND deleted_at IS NULL THEN TIMESTAMP '2024-05-01' ELSE deleted_at END AS once FROM obs", "obs")
def soft_delete(s, d):
    o = t.observations(s, d)
    gone, at = o.filter("id % 7 = 0"), F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'")
    once = ob.mark_deleted(o, gone, at, again=False).select("id", F.col("deleted_at").alias("once"))
    return ob.mark_deleted(o, gone, at).select("id", F.col("deleted_at").alias("again")).join(once, "id")


@query("SELECT id, md5(content) AS stored, CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN id ELSE -1 END AS n FROM obs", "obs")
def nul_strip_lenient_int(s, d):
    o = t.observations(s, d).withColumn("c", F.concat(F.lit("\0"), "content", F.lit("\0")))
    raw = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.concat("id", F.lit(".75"))).otherwise("none")
    return o.select("id", F.md5(ob.without_nul(F.col("c"))).alias("stored"), ob.lenient_int(raw, -1).alias("n"))


@query(fold_sql(log_sql("CASE WHEN id % 100 = 99 THEN 'delete' ELSE 'save' END"), f"SELECT id, project, topic AS topic_key, normalized_hash, revision_count, duplicate_count, created_at, updated_at, last_seen_at, type FROM ({SAVED})"), "obs")
def save_fold_rows(s, d):
    """The rows that all saves leave, with a delete after each hundred."""
    o = t.observations(s, d).select("id", "project", "topic_key", "normalized_hash", "title", "content", "type", "created_at")
    return ob.fold_saves(o.withColumn("op", F.when(F.col("id") % 100 == 99, "delete").otherwise("save"))).drop("content", "title")




@query("WITH r AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS rn FROM obs WHERE deleted_at IS NULL), p AS (SELECT * FROM r WHERE id = 505) SELECT r.id, r.session_id, r.rn - p.rn AS step FROM r JOIN p USING (session_id) WHERE abs(r.rn - p.rn) <= 3", "obs")
def timeline_window(s, d):
    return act.timeline(t.observations(s, d), 505, 3)


@query("SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY created_at RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM tools", "tools")
def rate_limit_window(s, d):
    return act.trailing_count(t.tool_usage(s, d), ["session_id"], 3600).select("id", "in_window")


# --- text ------------------------------------------------------------------------------------------

KEYED = "replace(content, 'token = ', 'api_token = ')"
_RULES = {k: p.replace("'", "''") for k, p in tx.SECRET_RULES.items()}


def redact_sql(x: str) -> str:
    for rule, pattern in _RULES.items():
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED:{rule}]', 'g')"
    return x


@query(f"SELECT id, md5({redact_sql(KEYED)}) AS redacted FROM obs", "obs")
def redact_secrets(s, d):
    return spread(t.observations(s, d).select("id", "content")).select("id", F.md5(tx.redact(F.expr(KEYED))).alias("redacted"))


@query(" UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n FROM obs WHERE regexp_matches({KEYED}, '{p}')" for r, p in _RULES.items()), "obs")
def secret_rule_hits(s, d):
    o = spread(t.observations(s, d).select("content")).select(F.expr(KEYED).alias("c"))
    flags = o.agg(*(F.count(F.when(F.col("c").rlike(p), 1)).alias(r) for r, p in tx.SECRET_RULES.items()))
    return flags.select(F.explode(F.map_from_arrays(F.array(*(F.lit(r) for r in tx.SECRET_RULES)), F.array(*(F.col(f"`{r}`") for r in tx.SECRET_RULES)))).alias("rule", "n"))


@query("SELECT id, CASE WHEN octet_length(encode(content)) > 200 THEN substr(content, 1, 197) || '...' ELSE content END AS preview FROM obs", "obs")
def search_preview(s, d):
    return t.observations(s, d).select("id", tx.preview(F.col("content")).alias("preview"))


SLUG_CUT = "CASE WHEN length(s) > 60 THEN regexp_replace(substr(s, 1, 60), '-+$', '') ELSE s END"
SLUG = "regexp_replace(regexp_replace(translate(lower({0}), 'áéíóúäëïöüñç', 'aeiouaeiounc'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT id, CASE WHEN length(s) > 60 THEN regexp_replace(substr(s, 1, 60), '-+$', '') ELSE s END AS slug FROM (SELECT id, {SLUG.format('title')} AS s FROM obs)", "obs")
def slugify(s, d):
    return t.observations(s, d).select("id", tx.slug(F.col("title")).alias("slug"))


@query(r"WITH w AS (SELECT id, type, list_filter(list_transform(regexp_split_to_array(lower(title), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '' AND x NOT IN ('the','a','an','el','la','los','las','de','en','con','por','para','que','y','o'))[1:3] AS k FROM obs) SELECT id, type || '/' || CASE WHEN len(k) = 0 THEN 'general' ELSE array_to_string(k, '-') END AS topic FROM w", "obs")
def topic_key_suggest(s, d):
    return t.observations(s, d).select("id", tx.topic_key(F.col("title"), F.col("type")).alias("topic"))


@query(r"SELECT id, substr(regexp_replace(split_part(content, chr(10), 1), '^[0-9.\-) \t]+', ''), 1, 80) AS title FROM obs", "obs")
def passive_title(s, d):
    return t.observations(s, d).select("id", tx.passive_title(F.col("content")).alias("title"))


@query("SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(content)), '[^a-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS project FROM obs", "obs")
def normalize_project(s, d):
    return t.observations(s, d).select("id", tx.project_name(F.expr("trim(content)")).alias("project"))


@query("SELECT page_id, list_last(string_split(regexp_replace(url, '\\.git$', ''), '/')) AS repo FROM pages")
def repo_name_from_url(s, d):
    return t.table(s, d, "pages").select("page_id", tx.repo_name(F.col("url")).alias("repo"))


@query("SELECT id, normalized_hash FROM obs", "obs")
def normalized_hash(s, d):
    return t.observations(s, d).select("id", "normalized_hash")


@query("SELECT id, translate(content, '/\\: ', '---_') || '.json' AS file FROM obs", "obs")
def checkpoint_filename(s, d):
    return t.observations(s, d).select("id", tx.checkpoint_name(F.col("content")).alias("file"))


@query("SELECT sync_id, 'session/summary/' || substr(sync_id, 1, 8) AS key FROM obs", "obs")
def session_topic_key(s, d):
    return t.observations(s, d).select("sync_id", F.concat(F.lit("session/summary/"), F.substring("sync_id", 1, 8)).alias("key"))


@query("SELECT id, (id * 1000003) // 4194304 + 1735689600000 AS ms, (id * 1000003) // 4096 % 1024 AS salt, (id * 1000003) % 4096 AS seq FROM obs", "obs")
def snowflake_decode(s, d):
    return t.observations(s, d).select("id", tx.snowflake(F.col("id") * 1000003).alias("x")).select("id", "x.*")


@query("SELECT id, CASE WHEN type IN ('passive', 'session', 'preference') THEN '' WHEN id % 2 = 0 THEN 'format' WHEN type IN ('decision', 'architecture', 'pattern', 'config') AND topic_key = '' THEN 'topic_key' ELSE '' END AS missing FROM obs", "obs")
def validate_save_params(s, d):
    o = t.observations(s, d).withColumn("content", F.when(F.col("id") % 2 == 1, F.concat(F.lit("What: x\nWhy: "), "content")).otherwise(F.lit("plain")))
    return o.select("id", tx.missing_parts(F.col("content"), F.col("type"), F.col("topic_key")).alias("missing"))


@query("SELECT id, CAST((id % 2 = 0)::INT + (id % 3 = 0)::INT AS INT) AS missing FROM obs", "obs")
def validate_summary(s, d):
    made = F.concat(F.when(F.col("id") % 2 == 0, "").otherwise("## Objetivo "), F.when(F.col("id") % 3 == 0, "").otherwise("## COMPLETADO"))
    return t.observations(s, d).select("id", F.size(tx.missing_sections(made)).alias("missing"))


@query(r"WITH i AS (SELECT id, list_filter(list_transform(string_split(content, '.'), lambda x: regexp_replace(replace(x, chr(10), ' '), '^\s+|\s+$', '', 'g')), lambda x: octet_length(encode(x)) >= 20 AND len(regexp_split_to_array(x, '\s+')) >= 4) AS v FROM obs) SELECT id, CAST(len(list_distinct(list_transform(v, lambda x: lower(x)))) AS INT) AS n FROM i", "obs")
def extract_learnings(s, d):
    lines = F.transform(F.split("content", r"\."), lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("\n"), F.lit(" "))))
    made = F.concat(F.lit("intro\n## Key Learnings:\n"), F.array_join(lines, "\n"), F.lit("\n## Next\n- not one of the learnings here"))
    return t.observations(s, d).select("id", F.size(tx.learnings(made)).alias("n"))


@query(r"""WITH i AS (SELECT id, list_transform(string_split(content, '.'), lambda x: regexp_replace(replace(x, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS v FROM obs),
u AS (SELECT id, k, v[k] AS item FROM i, unnest(range(1, len(v) + 1)) AS t(k) WHERE octet_length(encode(v[k])) >= 20 AND len(regexp_split_to_array(v[k], '\s+')) >= 4 AND k % 2 = 1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos, md5(item) AS item, substr(regexp_replace(item, '^[0-9.\-) \t]+', ''), 1, 80) AS title FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id, lower(item) ORDER BY k) = 1)""".replace("'\\", "'\\"), "obs")
def learning_items(s, d):
    """Sentences as items of a section, every second one without its mark, which is no item."""
    marks = lambda x, i: F.concat(F.when(i % 2 == 0, "* ").otherwise("-\n~ "), F.replace(x, F.lit("\n"), F.lit(" ")))
    lines = F.transform(F.split("content", r"\."), marks)
    made = F.concat(F.lit("## Learnings\n"), F.array_join(lines, "\n"))
    rows = tx.captured(t.observations(s, d).select("id", made.alias("content")))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), F.md5("learning").alias("item"), "title")


TURNS = "SELECT conv_id, turn, role || ': ' || text AS said FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role <> 'system') WHERE text <> ''"


def transcript_lines(s, d):
    c = t.table(s, d, "conversations")
    block = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, block).otherwise(plain).alias("line"))


@query(TURNS)
def transcript_turns(s, d):
    return transcript_lines(s, d).select("conv_id", "turn", tx.turn_text(F.col("line")).alias("said")).filter("said IS NOT NULL")


@query(f"SELECT conv_id, right(string_agg(said, chr(10) ORDER BY turn), 500) AS tail FROM ({TURNS}) GROUP BY conv_id")
def transcript_tail_excerpt(s, d):
    said = transcript_lines(s, d).select("conv_id", "turn", tx.turn_text(F.col("line")).alias("said")).filter("said IS NOT NULL")
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("x"))
    return whole.select("conv_id", F.expr("right(array_join(x.said, '\n'), 500)").alias("tail"))


@query(f"SELECT conv_id, right(string_agg(said, chr(10) ORDER BY turn), 300) AS tail FROM ({TURNS}) GROUP BY conv_id")
def transcript_file_tails(s, d):
    """The transcripts are written as files of JSON lines first."""
    path = scratch(s, "transcripts")
    lines = transcript_lines(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    lines.select("conv_id", F.expr("array_join(x.line, '\n')").alias("value")).write.partitionBy("conv_id").text(path)
    return transcripts.tails(s, path, 300).filter("tail <> ''").select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("bigint").alias("conv_id"), "tail")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE 'related' END AS relation, CASE WHEN id % 3 = 0 THEN NULL ELSE 0.5 END AS confidence FROM obs", "obs")
def parse_judge_json(s, d):
    good = F.concat(F.lit('sure: {"relation": "related", "confidence": 0.5} '), F.lit("end"))
    answer = F.when(F.col("id") % 3 == 0, "no json").otherwise(good)
    return t.observations(s, d).select("id", tx.verdict_json(answer).alias("v")).select("id", "v.relation", "v.confidence")


WAITS = "CASE WHEN tries = 0 THEN 0 WHEN tries <= 3 THEN 60 WHEN tries <= 6 THEN 300 WHEN tries <= 9 THEN 600 WHEN tries <= 12 THEN 1200 WHEN tries <= 15 THEN 1800 ELSE 3600 END"


@query(f"SELECT id, tries, coalesce(last, created_at) + to_seconds({WAITS}) AS next_at FROM (SELECT id, created_at, id % 20 AS tries, CASE WHEN id % 20 > 0 THEN created_at + to_minutes(id % 20) END AS last FROM que)", "que")
def retry_schedule(s, d):
    """When each queued entry may be tried again, by its log of failed tries."""
    q = t.queue(s, d)
    failed = q.filter("id % 20 > 0").select("id", "created_at", F.explode(F.expr("sequence(1L, id % 20)")).alias("try"))
    return streams.due_entries(q, failed.select("id", (F.col("created_at") + F.make_dt_interval(mins=F.col("try").cast("int"))).alias("at")))


@query(r"""WITH i AS (SELECT id, project, created_at, list_transform(string_split(content, '.'), lambda x: regexp_replace(replace(x, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS v FROM obs),
u AS (SELECT id, project, created_at, k, v[k] AS item FROM i, unnest(range(1, least(len(v), 900) + 1)) AS t(k) WHERE octet_length(encode(v[k])) >= 20 AND len(regexp_split_to_array(v[k], '\s+')) >= 4),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS pos FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id, lower(item) ORDER BY k) = 1)),
n AS (SELECT *, substr(regexp_replace(item, '^[0-9.\-) \t]+', ''), 1, 80) AS title FROM c),
h AS (SELECT *, sha256(lower(regexp_replace(title, '^\s+|\s+$', '', 'g') || '|' || regexp_replace(item, '^\s+|\s+$', '', 'g'))) AS digest FROM n WHERE title <> '')
SELECT project, digest AS normalized_hash, count(*) AS duplicate_count, min(created_at) AS created_at FROM h GROUP BY project, digest""", "obs")
def passive_saved(s, d):
    """Learnings of answers are saved like any notes: those that say the same are one."""
    lines = F.transform(F.slice(F.split("content", r"\."), 1, 900), lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("\n"), F.lit(" "))))
    made = F.concat(F.lit("## Key Learnings:\n"), F.array_join(lines, "\n"))
    answers = t.observations(s, d).select("id", "session_id", "project", "created_at", made.alias("content"))
    table = sv.save_batch(s.createDataFrame([], sv.TABLE), sv.passive_saves(answers))
    return table.select("project", "normalized_hash", "duplicate_count", "created_at")


@query("SELECT session_id, max(created_at) AS updated_at, max(created_at) <= TIMESTAMP '2024-01-30 11:40:00' AS due FROM tools GROUP BY session_id", "tools")
def digest_due(s, d):
    last = t.tool_usage(s, d).groupBy("session_id").agg(F.max("created_at").alias("updated_at"))
    return last.select("session_id", "updated_at", (F.col("updated_at") <= F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL '20' MINUTE")).alias("due"))


# --- search ----------------------------------------------------------------------------------------

TOKS = "list_filter(regexp_split_to_array(translate(lower({0}), 'áéíóúàèìòùâêîôûäëïöüãõñç', 'aeiouaeiouaeiouaeiouaonc'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
ALL_TOKS = TOKS.format("concat_ws(' ', title, content, type, project, topic_key)")
TOKENISED = f"tk AS (SELECT id, project, scope, deleted_at, {ALL_TOKS} AS toks FROM obs)"


def bm25_sql(terms: list[str], where: str, then: str = "SELECT id, round(rank, 6) AS rank FROM r") -> str:
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"(SELECT count(*) FROM c WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    any_tf = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"WITH {TOKENISED}, c AS (SELECT id, project, scope, deleted_at, toks, len(toks) AS dl, {tf} FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), r AS (SELECT id, -({part}) AS rank FROM c, st WHERE {any_tf} > 0 AND {where}) {then}"


def _search(s, d, text, project=None, limit=20):
    return se.search(t.observations(s, d), text, project, limit).select("id", F.round("rank", 6).alias("rank"))


def _tokenised(s, d):
    return spread(t.observations(s, d)).select("id", se.tokens("title", "content", "type", "project", "topic_key").alias("toks"))


@query(bm25_sql(["the", "worthless", "licensed"], "TRUE"), "obs")
def bm25_scores(s, d):
    return se.bm25(_tokenised(s, d), ["the", "worthless", "licensed"]).select("id", F.round("rank", 6).alias("rank"))


TOP = "SELECT id, round(rank, 6) AS rank FROM r ORDER BY round(rank, 9), id LIMIT 20"


@query(bm25_sql(["licensed", "license"], "deleted_at IS NULL AND (project = 'fr' OR scope = 'global') AND (tf0 > 0 OR tf1 > 0)", TOP), "obs")
def fts_search_project(s, d):
    return _search(s, d, "licensed OR license", "fr")


@query(bm25_sql(["idiot", "the"], "deleted_at IS NULL AND tf0 > 0 AND tf1 > 0", TOP), "obs")
def fts_search_all(s, d):
    return _search(s, d, "idiot the")


@query(f"WITH {TOKENISED} SELECT id FROM tk WHERE list_contains(toks, 'idiot') OR (list_contains(toks, 'trash') AND list_contains(toks, 'the'))", "obs")
def fts_boolean_or(s, d):
    return _tokenised(s, d).filter(se.condition(se.parse(se.sanitize("idiot OR trash the")))).select("id")


@query(f"WITH {TOKENISED} SELECT id FROM tk WHERE list_contains(toks, 'licensed') AND NOT list_contains(toks, 'apache')", "obs")
def fts_boolean_not(s, d):
    return _tokenised(s, d).filter(se.condition(se.parse(se.sanitize("licensed NOT apache")))).select("id")


@query(f"WITH {TOKENISED} SELECT id FROM tk WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' of the ')", "obs")
def fts_phrase(s, d):
    return _tokenised(s, d).filter(se.condition(se.parse('"of the"'))).select("id")


@query(f"WITH {TOKENISED} SELECT id FROM tk WHERE contains(' ' || array_to_string(toks, ' '), ' licens')", "obs")
def fts_prefix(s, d):
    return _tokenised(s, d).filter(se.condition(se.parse("licens*"))).select("id")


@query(f"WITH {TOKENISED} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tk) GROUP BY ALL", "obs")
def fts_postings(s, d):
    # texts are moved by id, so the words of each meet where they are cut
    toks = se.tokens("title", "content", "type", "project", "topic_key").alias("toks")
    rows = t.observations(s, d).select("id", "title", "content", "type", "project", "topic_key").repartition("id").select("id", toks)
    return rows.select("id", F.explode("toks").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(f"WITH tk AS (SELECT id, {TOKS.format(chr(34) + 'title' + chr(34) + " || ' ' || content")} AS toks FROM obs) SELECT id FROM tk WHERE list_contains(toks, 'idiot') AND list_contains(toks, 'clown')", "obs")
def tsquery_and_match(s, d):
    o = t.observations(s, d).select("id", se.tokens("title", "content").alias("toks"))
    return o.filter(F.array_contains("toks", "idiot") & F.array_contains("toks", "clown")).select("id")


def unit_sql(units: list[str], where: str, then: str) -> str:
    """Ranked search in which each unit is a SQL expression of its frequency in ``toks``."""
    tf = ", ".join(f"{u} AS tf{i}" for i, u in enumerate(units))
    df = ", ".join(f"(SELECT count(*) FROM c WHERE tf{i} > 0) AS df{i}" for i in range(len(units)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(units)))
    return f"WITH {TOKENISED}, c AS (SELECT id, project, scope, deleted_at, len(toks) AS dl, {tf} FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), r AS (SELECT id, -({part}) AS rank FROM c, st WHERE {where}) {then}"


PREFIX = "len(list_filter(toks, lambda x: starts_with(x, 'licens')))"
PHRASE = "len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))"
WORD = "len(list_filter(toks, lambda x: x = '{0}'))"


@query(unit_sql([PREFIX], "deleted_at IS NULL AND tf0 > 0", TOP), "obs")
def fts_search_prefix(s, d):
    return _search(s, d, "licens*")


@query(unit_sql([PHRASE, WORD.format("license")], "deleted_at IS NULL AND (project = 'en' OR scope = 'global') AND tf0 > 0 AND tf1 = 0", TOP), "obs")
def fts_search_phrase(s, d):
    return _search(s, d, '"of the" NOT "license"', "en")


@query(unit_sql(["CASE WHEN toks[1] = 'the' THEN 1 ELSE 0 END", WORD.format("license")], "deleted_at IS NULL AND (tf0 > 0 OR tf1 > 0)", TOP), "obs")
def fts_search_initial(s, d):
    return _search(s, d, "^the OR license")


@query(unit_sql([PREFIX, PHRASE], "deleted_at IS NULL AND (project = 'en' OR scope = 'global') AND (tf0 > 0 OR tf1 > 0)", TOP), "obs")
def fts_search_index(s, d):
    path = scratch(s, "index")
    se.write_index(t.observations(s, d), path)
    return se.search_index(s, path, 'licens* OR "of the"', "en").select("id", F.round("rank", 6).alias("rank"))


CHANGED = "obs2 AS (SELECT * REPLACE (CASE WHEN id % 10 = 1 THEN 'licensed licensed anew ' || id ELSE title END AS title, CASE WHEN id % 10 = 1 THEN 'of the others' ELSE content END AS content) FROM obs WHERE id % 10 <> 2)"


def _changed_index(s, d):
    """An index that took a tenth of the notes late, then lost a tenth and saw another changed, in several steps."""
    o, path = t.observations(s, d), scratch(s, "kept-index")
    se.write_index(o.filter("id % 10 <> 3"), path)
    se.update_index(path, o.filter("id % 10 = 3"))
    new = o.withColumns({"title": F.concat(F.lit("licensed licensed anew "), "id"), "content": F.lit("of the others")})
    for k in range(4):
        se.update_index(path, new.filter(f"id % 10 = 1 AND id % 4 = {k}"), o.filter(f"id % 10 = 2 AND id % 4 = {k}"))
    return path


@query(unit_sql([PREFIX, PHRASE, WORD.format("anew")], "deleted_at IS NULL AND (project = 'en' OR scope = 'global') AND (tf0 > 0 OR tf1 > 0 OR tf2 > 0)", TOP).replace("WITH tk AS", f"WITH {CHANGED}, tk AS").replace("AS toks FROM obs)", "AS toks FROM obs2)"), "obs")
def fts_index_changes(s, d):
    """Inserts, updates and deletes reach an index whose older segments stay as they are; ranks are those of a rebuild."""
    return se.search_index(s, _changed_index(s, d), 'licens* OR "of the" OR anew', "en").select("id", F.round("rank", 6).alias("rank"))


@query(f"""WITH tk AS (SELECT id, {TOKS.format("title || ' ' || content")} AS toks FROM obs WHERE deleted_at IS NULL AND (project = 'en' OR scope = 'global')),
h AS (SELECT id, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'licensed') AS a, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'the') AS b FROM tk WHERE list_contains(toks, 'licensed') AND list_contains(toks, 'the')),
p AS (SELECT id, abs(x - y) AS d FROM (SELECT id, b, unnest(a) AS x FROM h), unnest(b) AS u(y))
SELECT id, round(1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))), 6) AS rank FROM p GROUP BY id ORDER BY rank DESC, id LIMIT 20""", "obs")
def tsrank_search(s, d):
    o = spread(t.observations(s, d)).filter(se.visible_to("en")).select("id", se.tokens("title", "content").alias("toks"))
    return se.distance_rank(o, ["licensed", "the"]).select("id", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


# --- vectors ---------------------------------------------------------------------------------------

VECS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
PAIRS = f"{VECS}, p AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)"


def _vectors(s, d):
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {PAIRS} SELECT query_id, id, sim, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rk FROM p WHERE sim >= 0.2) WHERE rk <= 5")
def knn_topk(s, d):
    v = _vectors(s, d)
    return ve.knn(v, v.filter("id % 100 = 0"), 5, 0.2).withColumn("rk", F.col("rk").cast("long"))


@query(f"WITH {PAIRS} SELECT query_id, id, sim, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rk FROM p WHERE sim >= 0.2) WHERE rk <= 5")
def knn_pruned(s, d):
    """The same neighbours from blocks of vectors, without those that bounds rule out."""
    v = _vectors(s, d)
    return kn.nearest(v, v.filter("id % 100 = 0"), 5, 0.2)[0].withColumn("rk", F.col("rk").cast("long"))


@query(f"WITH {PAIRS} SELECT query_id, id, sim FROM p WHERE sim >= 0.4")
def similar_pairs(s, d):
    v = _vectors(s, d)
    return ve.similar(v, v.filter("id % 100 = 0"), 0.4)


@query(f"WITH {PAIRS} SELECT query_id, id, sim FROM p WHERE sim >= 0.85")
def related_085(s, d):
    v = _vectors(s, d)
    return ve.similar(v, v.filter("id % 100 = 0"), 0.85)


@query(bm25_sql(["the"], "deleted_at IS NULL", f"""
, lx AS (SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) AS rk FROM (SELECT * FROM r ORDER BY round(rank, 9), id LIMIT 20)), {PAIRS},
vx AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rk FROM p WHERE query_id = 100 AND sim >= 0.2 AND id IN (SELECT id FROM obs WHERE deleted_at IS NULL))
SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 10) AS score FROM (SELECT * FROM lx UNION ALL SELECT * FROM vx WHERE rk <= 20) GROUP BY id ORDER BY score DESC, id LIMIT 10"""), "obs")
def hybrid_rrf(s, d):
    v, o = _vectors(s, d), t.observations(s, d)
    near = ve.knn(ve.seen(v, o, se.visible_to(None)), v.filter("id = 100"), 20, 0.2)
    return ve.hybrid(se.search(o, "the").withColumn("rank", F.round("rank", 9)), near, 10)


CONTEXT = """, {pairs}, lx AS (SELECT id FROM r ORDER BY round(rank, 9), id LIMIT 2), shown AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0),
vx AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rk FROM p WHERE query_id = {query} AND sim >= {least} AND id IN (SELECT id FROM obs WHERE deleted_at IS NULL AND (project = 'fr' OR scope = 'global'))) WHERE rk <= 2 AND id NOT IN (SELECT id FROM shown))
SELECT id, 'vector' AS source FROM vx UNION ALL SELECT id, 'text' FROM lx WHERE id NOT IN (SELECT id FROM shown) AND NOT EXISTS (SELECT 1 FROM vx)"""


def _context(s, d, query, least):
    v, o = _vectors(s, d), t.observations(s, d)
    near = ve.knn(ve.seen(v, o, se.visible_to("fr")), v.filter(F.col("id") == query), 2, least)
    return ve.prompt_context(near, se.search(o, "licensed", "fr", 2), v.filter("id % 3 = 0").select("id"))


IN_FR = "deleted_at IS NULL AND (project = 'fr' OR scope = 'global')"


@query(bm25_sql(["licensed"], IN_FR, CONTEXT.format(pairs=PAIRS, query=100, least=0.65)), "obs")
def prompt_context(s, d):
    """No vector is near enough: the text matches."""
    return _context(s, d, 100, 0.65)


@query(bm25_sql(["licensed"], IN_FR, CONTEXT.format(pairs=PAIRS, query=0, least=0.05)), "obs")
def prompt_context_vectors(s, d):
    return _context(s, d, 0, 0.05)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 1 THEN 'new ' || vec_id ELSE 'old' END AS snippet FROM embeddings WHERE vec_id % 3 <> 2")
def vector_replace(s, d):
    v = _vectors(s, d)
    now = v.withColumn("snippet", F.lit("old"))
    texts = v.filter("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, F.col("embedding")).alias("embedding"), F.concat(F.lit("new "), "id").alias("content"), F.lit(2).alias("n"))
    first = texts.withColumn("n", F.lit(1)).withColumn("content", F.lit("older"))
    return ve.replace_vectors(now, first.unionByName(texts)).select("id", "snippet")


@query("SELECT id FROM obs WHERE deleted_at IS NULL AND id NOT IN (SELECT vec_id FROM embeddings)", "obs")
def reindex_missing(s, d):
    return ob.live(t.observations(s, d)).select("id").join(_vectors(s, d), "id", "left_anti")


@query(f"WITH {PAIRS} SELECT query_id, id FROM p WHERE sim >= 0.3 AND id % 2 = 1")
def injected_anti_join(s, d):
    v = _vectors(s, d)
    shown = v.filter("id % 2 = 0").select(F.to_json(F.array("id")).alias("ids")).select(F.explode(F.from_json("ids", "array<bigint>")).alias("id"))
    return ve.similar(v, v.filter("id % 100 = 0"), 0.3).join(shown, "id", "left_anti").select("query_id", "id")


# --- relations -------------------------------------------------------------------------------------

ENDS = "e AS (SELECT r.*, s.id AS source_obs, s.project AS source_project, x.id AS target_obs, x.project AS target_project FROM rel r LEFT JOIN obs s ON s.sync_id = r.source_id LEFT JOIN obs x ON x.sync_id = r.target_id WHERE r.deleted_at IS NULL)"


@query(f"WITH {ENDS} SELECT id, relation, coalesce(reason, '') AS reason, coalesce(confidence, 0) AS confidence, source_obs, target_obs FROM e WHERE judgment_status = 'judged' AND (source_project = 'en' OR target_project = 'en') ORDER BY created_at DESC, id DESC LIMIT 50", "rel", "obs")
def relations_list(s, d):
    e = rl.listed(t.relations(s, d), t.observations(s, d), project="en", status="judged")
    return ob.page(e, 50, 0, F.desc("created_at"), F.desc("id")).select("id", "relation", "reason", "confidence", "source_obs", "target_obs")


@query("SELECT count(*) AS total, CAST(sum((judgment_status = 'pending')::INT) AS BIGINT) AS pending, CAST(sum((judgment_status = 'judged')::INT) AS BIGINT) AS judged, CAST(sum((judgment_status = 'orphaned')::INT) AS BIGINT) AS orphaned FROM rel WHERE deleted_at IS NULL", "rel")
def relation_stats(s, d):
    return rl.stats(t.relations(s, d))


@query(f"WITH {ENDS} SELECT count(*) AS total, count(*) FILTER (WHERE judgment_status = 'pending') AS pending, count(*) FILTER (WHERE judgment_status = 'judged') AS judged, count(*) FILTER (WHERE judgment_status = 'orphaned') AS orphaned FROM e WHERE source_project = 'fr' OR target_project = 'fr'", "rel", "obs")
def relation_stats_project(s, d):
    return rl.stats(t.relations(s, d), t.observations(s, d), "fr")


@query("SELECT id FROM rel WHERE deleted_at IS NULL AND (source_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL) OR target_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL))", "rel", "obs")
def gc_dangling_relations(s, d):
    return rl.dangling(t.relations(s, d), t.observations(s, d)).select("id")


@query("SELECT id, CASE WHEN deleted_at IS NULL AND (source_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL) OR target_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL) OR (judgment_status = 'pending' AND created_at < TIMESTAMP '2024-01-06')) THEN TIMESTAMP '2024-02-05' ELSE deleted_at END AS deleted_at, CASE WHEN deleted_at IS NULL AND (source_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL) OR target_id NOT IN (SELECT sync_id FROM obs WHERE deleted_at IS NULL) OR (judgment_status = 'pending' AND created_at < TIMESTAMP '2024-01-06')) THEN TIMESTAMP '2024-02-05' ELSE updated_at END AS updated_at FROM rel", "rel", "obs")
def gc_relations(s, d):
    """The whole table after the sweep."""
    return rl.collected(t.relations(s, d), t.observations(s, d), F.expr("TIMESTAMP_NTZ '2024-02-05 00:00:00'")).select("id", "deleted_at", "updated_at")


@query("SELECT id FROM rel WHERE deleted_at IS NULL AND judgment_status = 'pending' AND created_at < TIMESTAMP '2024-01-06'", "rel")
def gc_stale_pending(s, d):
    return rl.kept(t.relations(s, d)).filter("judgment_status = 'pending' AND created_at < TIMESTAMP_NTZ '2024-02-05 00:00:00' - INTERVAL '30' DAY").select("id")


@query(f"WITH {ENDS} SELECT id, source_project, target_project FROM e WHERE source_project <> target_project", "rel", "obs")
def cross_project_relations(s, d):
    return rl.across_projects(t.relations(s, d), t.observations(s, d)).select("id", "source_project", "target_project")


@query("SELECT a.id FROM rel a WHERE EXISTS (SELECT 1 FROM rel b WHERE b.deleted_at IS NULL AND b.id % 2 = 0 AND least(b.source_id, b.target_id) = least(a.target_id, a.source_id) AND greatest(b.source_id, b.target_id) = greatest(a.target_id, a.source_id))", "rel")
def relation_pair_exists(s, d):
    r = t.relations(s, d)
    asked = r.select("id", rl.pair_key("target_id", "source_id").alias("pair"))
    return asked.join(rl.kept(r).filter("id % 2 = 0").select(rl.pair_key().alias("pair")), "pair", "left_semi").select("id")


@query(f"WITH {VECS} SELECT r.id, CASE WHEN b.id IS NULL OR sim < 0.3 THEN 'not_conflict' WHEN sim >= 0.4 THEN 'related' ELSE 'pending' END AS verdict, CASE WHEN b.id IS NULL OR sim < 0.3 THEN 0.9 WHEN sim >= 0.4 THEN sim END AS confidence FROM (SELECT r.id, a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM rel r LEFT JOIN v a ON a.id = r.id LEFT JOIN v b ON b.id = r.id + 1 WHERE judgment_status = 'pending') r LEFT JOIN v b ON b.id = r.y", "rel")
def judge_relations(s, d):
    v = t.table(s, d, "embeddings").selectExpr("md5(CAST(vec_id AS STRING)) AS sync_id", "embedding")
    return rl.judge_by_similarity(t.relations(s, d), v, 0.3, 0.4)


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'related' ELSE relation END AS relation, CASE WHEN id % 5 = 0 THEN 'judged' ELSE judgment_status END AS judgment_status FROM rel", "rel")
def judge_apply(s, d):
    r = t.relations(s, d)
    said = r.filter("id % 5 < 2").select("sync_id", F.when(F.col("id") % 5 == 0, "related").otherwise("nonsense").alias("verb"))
    return rl.apply_verdicts(r, said).select("id", "relation", "judgment_status")


@query("SELECT relation, count(*) AS n, relation IN ('related', 'compatible', 'scoped', 'conflicts_with', 'supersedes', 'not_conflict') AS valid FROM rel GROUP BY relation", "rel")
def relation_verb_validate(s, d):
    return t.relations(s, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.col("relation").isin(t.VERBS))


@query("SELECT least(source_id, target_id) || '|' || greatest(source_id, target_id) AS pair, max(id) AS id FROM (SELECT id, source_id, target_id FROM rel UNION ALL SELECT id + 10000, target_id, source_id FROM rel WHERE id % 2 = 0) GROUP BY pair", "rel")
def relation_upsert_symmetric(s, d):
    r = t.relations(s, d).select("id", "source_id", "target_id")
    back = r.filter("id % 2 = 0").select((F.col("id") + 10000).alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return rl.upsert_symmetric(r.unionByName(back), F.desc("id")).select("pair", "id")


@query("WITH q AS (SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE sync_id END AS ref FROM obs) SELECT q.ref, coalesce(a.id, b.id) AS found FROM q LEFT JOIN obs a ON a.id = try_cast(q.ref AS BIGINT) LEFT JOIN obs b ON b.sync_id = q.ref", "obs")
def resolve_obs_ref(s, d):
    o = t.observations(s, d).select("id", "sync_id")
    q = o.select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.col("sync_id")).alias("ref"))
    q = q.withColumn("n", F.expr("try_cast(ref AS BIGINT)")).join(o.select(F.col("id").alias("n"), F.col("id").alias("x")), "n", "left")
    return q.join(o.select(F.col("sync_id").alias("ref"), F.col("id").alias("y")), "ref", "left").select("ref", F.coalesce("x", "y").alias("found"))


CAND = f"""WITH tk AS (SELECT id, sync_id, {TOKS.format("title || ' ' || content")} AS toks, list_distinct(list_filter({TOKS.format('title')}, lambda x: octet_length(encode(x)) > 2)) AS terms FROM obs),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk), q AS (SELECT id AS src, unnest(terms) AS term FROM tk WHERE id % 100 = 0),
po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT src, id, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank FROM q JOIN po USING (term) JOIN dfs USING (term), st WHERE src <> id GROUP BY src, id),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank, id) AS rk FROM sc) WHERE rk <= 9)
SELECT src, id, rank, row_number() OVER (PARTITION BY src ORDER BY rank, id) AS rk FROM tp WHERE abs(src - id) <> 1 OR least(src, id) NOT IN (SELECT id FROM rel WHERE deleted_at IS NULL) QUALIFY rk <= 3"""


@query(CAND.replace("row_number() OVER (PARTITION BY src ORDER BY rank, id) AS rk FROM tp", "row_number() OVER (PARTITION BY src ORDER BY rank, id) AS rk FROM (SELECT src, id, rank FROM tp)"), "obs", "rel")
def relation_candidates(s, d):
    o = t.observations(s, d).select("id", "sync_id", se.tokens("title", "content").alias("toks"), F.filter(se.tokens("title"), lambda w: F.octet_length(w) > 2).alias("terms"))
    return rl.candidates(o.drop("terms"), o.filter("id % 100 = 0"), t.relations(s, d), floor=None).withColumn("rk", F.col("rk").cast("long"))


@query(f"WITH {ENDS} SELECT id, relation, judgment_status FROM e WHERE source_project = 'fr' OR target_project = 'fr' ORDER BY created_at DESC, id DESC LIMIT 20", "rel", "obs")
def relations_list_project(s, d):
    return rl.listed(t.relations(s, d), t.observations(s, d), project="fr").limit(20).select("id", "relation", "judgment_status")


@query("SELECT relation, count(*) AS n FROM rel WHERE deleted_at IS NULL AND relation <> 'pending' GROUP BY relation", "rel")
def relation_stats_by_verb(s, d):
    return rl.verb_counts(t.relations(s, d))


@query(f"WITH {ENDS} SELECT relation, count(*) AS n FROM e WHERE relation <> 'pending' AND (source_project = 'fr' OR target_project = 'fr') GROUP BY relation", "rel", "obs")
def relation_verbs_project(s, d):
    return rl.verb_counts(t.relations(s, d), t.observations(s, d), "fr")


CAND_SCOPED = CAND.replace("SELECT id, sync_id, ", "SELECT id, sync_id, project, scope, deleted_at, ", 1).replace("tp AS (SELECT * FROM (SELECT *,", "sd AS (SELECT sc.* FROM sc JOIN tk a ON a.id = sc.src JOIN tk b ON b.id = sc.id WHERE b.deleted_at IS NULL AND (b.project = a.project OR b.scope = 'global')), tp AS (SELECT * FROM (SELECT *,").replace("AS rk FROM sc)", "AS rk FROM sd)").replace("WHERE rk <= 9)", "WHERE rk <= 9 AND rank >= -8)")


@query(CAND_SCOPED.split("\nSELECT src, id, rank, row_number()")[0] + ", got AS (SELECT src, id, rank, row_number() OVER (PARTITION BY src ORDER BY rank, id) AS k FROM (SELECT src, id, rank FROM tp) WHERE abs(src - id) <> 1 OR least(src, id) NOT IN (SELECT id FROM rel WHERE deleted_at IS NULL)) SELECT md5(CAST(src AS VARCHAR)) AS source_id, md5(CAST(id AS VARCHAR)) AS target_id, 'pending' AS judgment_status, rank AS score FROM got WHERE k <= 3", "obs", "rel")
def relation_candidates_pending(s, d):
    o = t.observations(s, d).select("id", "sync_id", "project", "scope", "deleted_at", se.tokens("title", "content").alias("toks"), F.filter(se.tokens("title"), lambda w: F.octet_length(w) > 2).alias("terms"))
    found = rl.candidates(o.drop("terms"), o.filter("id % 100 = 0").select("id", "sync_id", "project", "terms"), t.relations(s, d), floor=-8.0)
    return rl.pending_rows(found, o, F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'")).select("source_id", "target_id", "judgment_status", "score")


JUDGED = """WITH e AS (SELECT r.*, s.project AS source_project, x.project AS target_project FROM rel r LEFT JOIN obs s ON s.sync_id = r.source_id LEFT JOIN obs x ON x.sync_id = r.target_id),
v AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'related' WHEN id % 5 = 1 THEN 'nonsense' END AS verb FROM e),
g AS (SELECT *, CASE WHEN verb = 'nonsense' THEN 'verb' WHEN verb IS NOT NULL AND deleted_at IS NOT NULL THEN 'deleted' WHEN verb IS NOT NULL AND source_project <> target_project THEN 'project' ELSE '' END AS error FROM v),
h AS (SELECT *, verb IS NOT NULL AND error = '' AS hit FROM g)
SELECT id, error, CASE WHEN hit THEN verb ELSE relation END AS relation, CASE WHEN hit THEN 'judged' ELSE judgment_status END AS judgment_status, CASE WHEN hit THEN 'me' ELSE marked_by_actor END AS marked_by_actor,
  CASE WHEN hit THEN 'line ' || id ELSE evidence END AS evidence, CASE WHEN hit THEN 's' || id ELSE session_id END AS session_id, CASE WHEN hit THEN TIMESTAMP '2024-05-01' ELSE updated_at END AS updated_at FROM h"""


@query(JUDGED, "rel", "obs")
def judge_guarded(s, d):
    """Of two verdicts on each fifth relation the last counts; rows that are not named keep their marks."""
    r = t.relations(s, d)
    verbs = F.when(F.col("id") % 5 == 0, F.array(F.struct(F.lit("scoped").alias("verb"), F.lit(1).alias("n")), F.struct(F.lit("related").alias("verb"), F.lit(2).alias("n")))).otherwise(F.array(F.struct(F.lit("nonsense").alias("verb"), F.lit(1).alias("n"))))
    said = r.filter("id % 5 < 2").select("id", F.explode(verbs).alias("v"), F.lit("as seen").alias("why"), F.concat(F.lit("line "), "id").alias("evidence"), F.lit(0.8).alias("sure"), F.lit("me").alias("actor"), F.lit("agent").alias("kind"), F.lit("").alias("model"), F.concat(F.lit("s"), "id").alias("session"))
    said = said.select("id", "v.verb", "v.n", "why", "evidence", "sure", "actor", "kind", "model", "session")
    return rl.judged(r, t.observations(s, d), said, F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'")).select("id", "error", "relation", "judgment_status", "marked_by_actor", "evidence", "session_id", "updated_at")


@query("""WITH n AS (SELECT md5(CAST(id AS VARCHAR)) AS a, md5(CAST(id + 2 AS VARCHAR)) AS b, 'related' AS verb FROM rel WHERE id % 10 = 3 UNION ALL SELECT target_id, source_id, 'scoped' FROM rel WHERE id % 4 = 0 AND deleted_at IS NOT NULL),
m AS (SELECT a, b, verb, md5(least(a, b) || '|' || greatest(a, b) || '|2024-05-01 00:00:00') AS name FROM n)
SELECT id, sync_id, source_id, target_id, CASE WHEN hit THEN 'scoped' ELSE relation END AS relation, CASE WHEN hit THEN 'system' ELSE marked_by_kind END AS marked_by_kind, CASE WHEN hit THEN 'm' ELSE marked_by_model END AS marked_by_model, evidence FROM (SELECT *, id % 4 = 0 AND deleted_at IS NULL AS hit FROM rel)
UNION ALL SELECT CAST('0x' || substr(name, 1, 15) AS BIGINT), name, a, b, verb, 'system', 'm', NULL FROM m""", "rel")
def judge_semantic(s, d):
    r = t.relations(s, d)
    back = r.filter("id % 4 = 0").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.explode(F.array(F.struct(F.lit("related").alias("verb"), F.lit(1).alias("n")), F.struct(F.lit("scoped").alias("verb"), F.lit(2).alias("n")), F.struct(F.lit("odd").alias("verb"), F.lit(3).alias("n")))).alias("v")).select("source_id", "target_id", "v.*")
    new = r.filter("id % 10 = 3").select(F.expr("md5(CAST(id AS STRING))").alias("source_id"), F.expr("md5(CAST(id + 2 AS STRING))").alias("target_id"), F.lit("related").alias("verb"), F.lit(1).alias("n"))
    said = back.unionByName(new).withColumn("sure", F.lit(0.7)).withColumn("why", F.lit("")).withColumn("model", F.lit("m"))
    return rl.judge_by_meaning(r, said, F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'")).select("id", "sync_id", "source_id", "target_id", "relation", "marked_by_kind", "marked_by_model", "evidence")


# --- sync, export, streams -------------------------------------------------------------------------


@query("SELECT id FROM obs WHERE updated_at >= TIMESTAMP '2024-01-10'", "obs")
def sync_export_since(s, d):
    return sync.changed_since(t.observations(s, d), "2024-01-10 00:00:00").select("id")


@query("SELECT id FROM obs WHERE id % 3 <> 0 AND session_id IN (SELECT id FROM sess)", "obs", "sess")
def sync_import_once(s, d):
    o = t.observations(s, d)
    return sync.import_new(o.filter("id % 3 = 0"), o, t.sessions(s, d)).select("id")


@query("SELECT id, sync_id, title, updated_at FROM obs WHERE updated_at > TIMESTAMP '2024-01-03' AND id % 3 <> 0 AND session_id IN (SELECT id FROM sess)", "obs", "sess")
def sync_roundtrip(s, d):
    """Two exports of one content make one chunk; what it has and the other side lacks comes back, once."""
    o, folder = t.observations(s, d), scratch(s, "sync")
    for _ in range(2):
        sync.export_chunk(o, folder, "a", "2024-05-01T00:00:00Z", since="2024-01-03 00:00:00")
    ledger = s.createDataFrame([], "id string")
    fresh, ledger = sync.import_chunks(o.filter("id % 3 = 0"), t.sessions(s, d), folder, ledger)
    again, _ = sync.import_chunks(o.filter("id % 3 = 0"), t.sessions(s, d), folder, ledger)
    return fresh.unionByName(again).select("id", "sync_id", "title", "updated_at")


@query("SELECT 1 AS chunks, count(*) AS memories FROM obs WHERE updated_at > TIMESTAMP '2024-01-03'", "obs")
def sync_manifest(s, d):
    o, folder = t.observations(s, d), scratch(s, "sync")
    for _ in range(2):
        sync.export_chunk(o, folder, "a", "2024-05-01T00:00:00Z", since="2024-01-03 00:00:00")
    return sync.manifest(s, folder).agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.sum("memories").alias("memories"))


@query(f"WITH n AS (SELECT id, project || '/' || type || '/' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END || '-' AS folder, {SLUG_CUT} AS old FROM (SELECT id, project, type, {SLUG.format('title')} AS s FROM obs WHERE deleted_at IS NULL)) SELECT folder || old || '.md' AS path, CASE WHEN id % 3 = 0 THEN 'remove' ELSE 'write' END AS change FROM n WHERE id % 3 = 0 OR id % 3 = 1 UNION ALL SELECT folder || 'renamed-' || id || '.md', 'write' FROM n WHERE id % 3 = 0", "obs")
def mirror_changes(s, d):
    """A third of the notes are renamed, another third are changed."""
    o = ob.live(t.observations(s, d))
    new = o.withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("renamed "), "id")).otherwise(F.col("title"))).withColumn("content", F.when(F.col("id") % 3 == 1, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return sync.mirror(o, new).select("path", "change")


@query("""WITH known AS (SELECT id FROM sess WHERE CAST(id AS BIGINT) % 2 = 0) SELECT sync_id, 1 + (id % 3 = 0 AND session_id IN (SELECT id FROM known))::INT AS duplicate_count FROM obs WHERE deleted_at IS NULL AND id % 3 <> 2
UNION ALL SELECT sync_id, 1 FROM obs WHERE deleted_at IS NULL AND id % 3 = 2 AND session_id IN (SELECT id FROM known)""", "obs", "sess")
def sync_exchange(s, d):
    """A store takes another's chunk of sessions, notes and prompts, and takes nothing when it asks again."""
    o = ob.live(t.observations(s, d)).withColumns({"content": F.concat(F.lit("note "), "id"), "topic_key": F.lit(""), "tool_name": F.lit("")})
    o = o.withColumn("normalized_hash", t.content_hash(F.col("title"), F.col("content")))
    known = t.sessions(s, d).filter("CAST(id AS BIGINT) % 2 = 0").withColumns({"directory": F.lit(""), "summary": F.lit("")})
    one, two, shared, state = (scratch(s, n) for n in ("store", "store", "shared", "imports"))
    rp.put(s, one, {"observations": o.filter("id % 3 <> 1"), "sessions": known, "prompts": ob.live(t.prompts(s, d))})
    rp.put(s, two, {"observations": o.filter("id % 3 <> 2")})
    ex.export(s, one, shared, "one", "2024-06-01 00:00:00")
    for at in ("2024-06-02 00:00:00", "2024-06-03 00:00:00"):
        ex.import_new(s, two, shared, state, at)
    return rp.table(s, two, "observations").select("sync_id", "duplicate_count")


@query(f"WITH n AS (SELECT id, project || '/' || type || '/' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END || '-' AS folder, {SLUG_CUT} AS old FROM (SELECT id, project, type, {SLUG.format('title')} AS s FROM obs WHERE deleted_at IS NULL)) SELECT folder || CASE WHEN id % 10 = 3 THEN 'renamed-' || id ELSE old END || '.md' AS path FROM n WHERE id % 10 <> 7", "obs")
def mirror_files(s, d):
    """Files that follow a store in which a tenth of the notes is renamed and another deleted, without the index."""
    o, folder, out = t.observations(s, d).withColumn("tool_name", F.lit("")), scratch(s, "store"), scratch(s, "notes")
    rp.put(s, folder, {"observations": o})
    mirror.follow(s, folder, out, "2024-06-01")
    renamed = o.filter("id % 10 = 3").withColumn("title", F.concat(F.lit("renamed "), "id"))
    gone = o.filter("id % 10 = 7").withColumn("deleted_at", F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))
    rp.put(s, folder, {"observations": renamed.unionByName(gone)})
    mirror.follow(s, folder, out, "2024-06-01")
    return mirror.files_below(s, out).filter(F.col("path") != mirror.INDEX)


@query("SELECT project, count(*) AS memories, count(DISTINCT session_id) AS sessions FROM obs GROUP BY project", "obs")
def sync_chunk_counts(s, d):
    return t.observations(s, d).groupBy("project").agg(F.count(F.lit(1)).alias("memories"), F.countDistinct("session_id").alias("sessions"))


def note_sql(title: str) -> str:
    return f"(SELECT CASE WHEN length(s) > 60 THEN regexp_replace(substr(s, 1, 60), '-+$', '') ELSE s END FROM (SELECT {SLUG.format(title)} AS s))"


@query(f"SELECT id, project || '/' || type || '/' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END || '-' || {note_sql('title')} || '.md' AS path FROM obs WHERE deleted_at IS NULL", "obs")
def export_markdown_rows(s, d):
    return sync.markdown(ob.live(t.observations(s, d))).select("id", "path")


@query("SELECT project, count(*) AS n, min(id) AS first_id, max(created_at) AS newest FROM obs WHERE deleted_at IS NULL GROUP BY project", "obs")
def export_index(s, d):
    return sync.index(ob.live(t.observations(s, d)))


@query("SELECT entity_type, count(*) AS n, round(sum(value), 4) AS total FROM que GROUP BY entity_type", "que")
def replay_dispatch(s, d):
    return streams.replay(t.queue(s, d)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query('SELECT user_id AS "user", max_by(entity_type, id) AS last_type FROM que GROUP BY user_id', "que")
def replay_final_state(s, d):
    return streams.replay(t.queue(s, d)).groupBy("user").agg(F.max_by("entity_type", "id").alias("last_type"))


def _entries(s, d):
    """Queued writes of all kinds, made from events: sessions begin at ids divisible by 7, every eleventh payload is no JSON."""
    kinds = F.element_at(F.array(*(F.lit(k) for k in streams.KINDS)), (F.col("id") % 9 + 1).cast("int"))
    e = t.tool_usage(s, d).select("id", "session_id", kinds.alias("entity_type"))
    body = F.to_json(F.struct(F.when(F.col("entity_type").isin("create_session", "end_session"), F.col("session_id")).otherwise(F.col("id").cast("string")).alias("ID"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("session_id")).alias("SessionID"), F.lit("p").alias("Project"), F.when(F.col("id") % 5 == 0, "").otherwise("text").alias("Content")))
    body = F.when(F.col("entity_type").isin("update_observation", "delete_observation"), F.to_json(F.struct(F.col("id").alias("ID")))).otherwise(body)
    return e.select("id", "entity_type", F.when(F.col("id") % 11 == 0, "broken").otherwise(body).alias("payload"))


@query("""WITH q AS (SELECT id, session_id, (['save_observation', 'update_observation', 'delete_observation', 'create_session', 'end_session', 'save_prompt', 'record_tool_use', 'increment_search_count', 'touch_session_activity'])[id % 9 + 1] AS kind FROM tools WHERE id % 11 <> 0),
k AS (SELECT session_id, min(since) AS since FROM (SELECT id AS session_id, -1 AS since FROM sess WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT session_id, id FROM q WHERE kind = 'create_session') GROUP BY session_id),
j AS (SELECT q.*, coalesce(since < q.id, FALSE) AS known, CASE WHEN kind IN ('save_observation', 'save_prompt') AND id % 4 = 0 THEN TRUE ELSE coalesce(since < q.id, FALSE) END AS linked FROM q LEFT JOIN k USING (session_id))
SELECT id AS entry, kind, CASE kind WHEN 'save_observation' THEN CASE WHEN linked THEN 'apply' ELSE 'unlink' END WHEN 'update_observation' THEN CASE WHEN id IN (SELECT id FROM obs) THEN 'apply' ELSE 'discard' END WHEN 'create_session' THEN CASE WHEN known THEN 'skip' ELSE 'apply' END WHEN 'end_session' THEN CASE WHEN known THEN 'apply' ELSE 'discard' END WHEN 'save_prompt' THEN CASE WHEN linked AND id % 5 <> 0 THEN 'apply' ELSE 'discard' END ELSE 'apply' END AS action FROM j""", "tools", "sess", "obs")
def replay_resolved(s, d):
    return streams.resolved(_entries(s, d), t.sessions(s, d).filter("CAST(id AS BIGINT) % 2 = 0"), t.observations(s, d))


def _queue(s, d):
    """Queued writes of all kinds, made from events: every eleventh payload is no JSON, texts and sessions are missing here and there."""
    kinds = F.element_at(F.array(*(F.lit(k) for k in streams.KINDS)), (F.col("id") % 9 + 1).cast("int"))
    e = t.tool_usage(s, d).select("id", "session_id", kinds.alias("entity_type"), "created_at")
    named = F.when(F.col("entity_type").isin("create_session", "end_session"), F.col("session_id")).otherwise("")
    told = F.struct(
        named.alias("ID"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("session_id")).alias("SessionID"), F.lit(" My P ").alias("Project"), F.concat(F.lit("note "), "id").alias("Title"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("text "), "id")).alias("Content"), F.concat(F.lit("sum "), "id").alias("Summary"), F.lit("tool").alias("ToolName"),
    )
    row = F.when(F.col("id") < 10_000_000, F.col("id")).otherwise(-F.col("id"))  # edits name rows of the table before, as in the SQL, none that an entry makes
    body = F.when(F.col("entity_type").isin("update_observation", "delete_observation"), F.to_json(F.struct(row.alias("ID"), F.concat(F.lit("changed "), "id").alias("Title")))).otherwise(F.to_json(told))
    return e.select((F.col("id") + 10_000_000).alias("id"), "entity_type", F.when(F.col("id") % 11 == 0, "broken").otherwise(body).alias("payload"), "created_at")


@query("""WITH q AS (SELECT id, id + 10000000 AS entry, session_id, id % 9 AS kind, CASE WHEN id % 4 = 0 THEN '' ELSE session_id END AS owner, created_at FROM tools WHERE id % 11 <> 0),
k AS (SELECT session_id, min(since) AS since FROM (SELECT id AS session_id, -1 AS since FROM sess WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT session_id, entry FROM q WHERE kind = 3) GROUP BY session_id),
start AS (SELECT id, last_activity_at, ended_at, search_count FROM sess WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT q.session_id, q.created_at, NULL, 0 FROM q JOIN k ON k.since = q.entry),
ends AS (SELECT q.session_id, max_by(q.created_at, q.id) AS at, max_by('sum ' || q.id, q.id) AS said FROM q JOIN k ON k.session_id = q.session_id AND since < entry WHERE kind = 4 GROUP BY q.session_id),
alive AS (SELECT owner, max_by(q.created_at, q.id) FILTER (WHERE kind = 8) AS at, count(*) FILTER (WHERE kind = 7) AS n FROM q JOIN k ON k.session_id = owner AND since < entry WHERE kind IN (7, 8) GROUP BY owner),
u AS (SELECT * FROM q WHERE kind = 1), x AS (SELECT * FROM q WHERE kind = 2)
SELECT 'observations' AS tbl, CAST(o.id AS VARCHAR) AS id, CASE WHEN u.id IS NOT NULL AND o.deleted_at IS NULL THEN 'changed ' || o.id ELSE o.title END AS said, CASE WHEN u.id IS NOT NULL AND o.deleted_at IS NULL THEN 2 ELSE 1 END AS n,
  coalesce(x.created_at, o.deleted_at, u.created_at, o.updated_at) AS at FROM obs o LEFT JOIN u ON u.id = o.id LEFT JOIN x ON x.id = o.id
UNION ALL SELECT 'observations', CAST(entry AS VARCHAR), 'note ' || id, 1, created_at FROM q WHERE kind = 0 AND id % 5 <> 0
UNION ALL SELECT 'sessions', start.id, coalesce(said, ''), search_count + coalesce(n, 0), coalesce(ends.at, ended_at, alive.at, last_activity_at) FROM start LEFT JOIN ends ON ends.session_id = start.id LEFT JOIN alive ON owner = start.id
UNION ALL SELECT 'prompts', CAST(entry AS VARCHAR), 'text ' || q.id, 0, created_at FROM q LEFT JOIN k ON k.session_id = owner WHERE kind = 5 AND q.id % 5 <> 0 AND (owner = '' OR since < entry)
UNION ALL SELECT 'tool_usage', CAST(entry AS VARCHAR), 'tool', 0, created_at FROM q WHERE kind = 6
UNION ALL SELECT 'ledger', CAST(id + 10000000 AS VARCHAR), CASE WHEN id % 11 = 0 THEN 'corrupt' ELSE 'done' END, 0, NULL FROM tools""", "obs", "sess", "tools")
def replay_applied(s, d):
    """The tables after a replay in two batches, the second of which fails once and comes again."""
    folder, queue, checkpoint, failed = scratch(s, "store"), scratch(s, "queue"), scratch(s, "replay"), []
    o = t.observations(s, d).withColumn("tool_name", F.lit(""))
    known = t.sessions(s, d).filter("CAST(id AS BIGINT) % 2 = 0").withColumns({"directory": F.lit(""), "summary": F.lit("")})
    rp.put(s, folder, {"observations": o, "sessions": known})
    entries = _queue(s, d)
    half = entries.agg(F.expr("(max(id) + min(id)) div 2")).first()[0] or 0
    entries.filter(F.col("id") <= half).write.parquet(queue)
    files = sum(f.startswith("part-") for f in children(s, queue))  # a batch is as many files, in the order of their times
    entries.filter(F.col("id") > half).coalesce(files).write.mode("append").parquet(queue)

    def lost(number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("the store is down")

    run = lambda: rp.replay(s.readStream.schema(entries.schema).option("maxFilesPerTrigger", files).parquet(queue), folder, checkpoint, lost)
    try:
        run()
    except Exception as e:
        if not failed or "the store is down" not in str(e):
            raise
        run()  # nothing but the loss above may fail
    drop_path(s, queue)
    rows = lambda name, said, n, at, key="id": rp.table(s, folder, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("id"), said.alias("said"), n.cast("long").alias("n"), at.cast("timestamp_ntz").alias("at"))
    none, zero = F.lit(None), F.lit(0)
    out = rows("observations", F.col("title"), F.col("revision_count"), F.coalesce("deleted_at", "updated_at"))
    out = out.unionByName(rows("sessions", F.col("summary"), F.col("search_count"), F.coalesce("ended_at", "last_activity_at")))
    out = out.unionByName(rows("prompts", F.col("content"), zero, F.col("created_at"))).unionByName(rows("tool_usage", F.col("tool_name"), zero, F.col("created_at")))
    return out.unionByName(rows("ledger", F.when(F.col("action") == "corrupt", "corrupt").otherwise("done"), zero, none, "entry"))


@query("WITH e AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM tools), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS grp FROM e) SELECT session_id, count(*) AS events, min(created_at) AS first, max(created_at) AS last FROM g GROUP BY session_id, grp", "tools")
def stream_session_windows(s, d):
    calls = t.tool_usage(s, d).select("session_id", "id", "created_at")
    out = od.through(calls, 4, lambda e: streams.session_windows(e.withColumn("created_at", F.col("created_at").cast("timestamp"))).drop("w"))
    return out.filter("session_id <> ''").select("session_id", "events", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("WITH a AS (SELECT session_id, id, 0 AS kind, created_at FROM tools UNION ALL SELECT session_id, id, 1, created_at FROM prom WHERE deleted_at IS NULL), e AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at, kind, id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM a), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS grp FROM e) SELECT session_id, count(*) AS events, min(created_at) AS first, max(created_at) AS last FROM g GROUP BY session_id, grp", "tools", "prom")
def stream_activity_windows(s, d):
    """Tool calls and prompts as two streams under one watermark."""
    two = [t.tool_usage(s, d), ob.live(t.prompts(s, d))]
    out = od.through([x.select("session_id", "id", "created_at") for x in two], 3, streams.activity_windows).filter("session_id <> ''")
    return out.select("session_id", "events", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("SELECT DISTINCT project, normalized_hash FROM obs", "obs")
def stream_dedup(s, d):
    saves = t.observations(s, d).select("id", "project", "normalized_hash", "created_at")
    return od.through(saves, 4, streams.first_of_each).filter("normalized_hash <> '' OR normalized_hash IS NULL").select("project", "normalized_hash")
