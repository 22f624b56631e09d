"""The continuous forms: activity sessions, deduplication, replay of queued writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Active spans of each session: events at most 30 minutes apart.  Batch or stream; a stream emits closed spans."""
    e = events.withWatermark("created_at", late) if events.isStreaming else events
    return e.groupBy("session_id", F.session_window("created_at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def activity_windows(*sources: DataFrame, late: str = "1 hour") -> DataFrame:
    """Active spans of each session over several streams (session_id, created_at), such as tool calls and prompts: the slowest of them holds the watermark."""
    marked = [s.select("session_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late) for s in sources]
    spans = reduce(DataFrame.unionByName, marked).groupBy("session_id", F.session_window("created_at", "30 minutes").alias("w"))
    return spans.agg(F.count(F.lit(1)).alias("events"), F.min("created_at").alias("first"), F.max("created_at").alias("last")).drop("w")


def first_of_each(saves: DataFrame) -> DataFrame:
    """The first save of each project and hash; on a stream, state is kept without end."""
    return saves.dropDuplicates(["project", "normalized_hash"])


def replay(queue: DataFrame) -> DataFrame:
    """Entries by kind with their parsed payload; corrupt payloads are dropped."""
    parsed = queue.withColumn("p", F.from_json("payload", "user bigint, value double"))
    return parsed.filter("p.user IS NOT NULL").select("id", "entity_type", F.col("p.user").alias("user"), F.col("p.value").alias("value"))


# The kinds of queued writes, and what their payloads hold.
KINDS = {
    "save_observation": "SessionID string, Project string, Title string, Content string, Type string, TopicKey string, SyncID string",
    "update_observation": "ID bigint, Title string, Content string, Type string",
    "delete_observation": "ID bigint",
    "create_session": "ID string, Project string, Directory string",
    "end_session": "ID string, Summary string",
    "save_prompt": "SessionID string, Project string, Content string",
    "record_tool_use": "SessionID string, Project string, ToolName string",
    "increment_search_count": "SessionID string",
    "touch_session_activity": "SessionID string, Project string",
}


def dispatch(queue: DataFrame, *keep: str) -> dict[str, DataFrame]:
    """Entries (id, entity_type, payload) by kind: ``entry``, what is kept of them, and the fields of their payload.

    A payload that holds no JSON object is corrupt and dropped; fields that it
    lacks are empty.  Unknown kinds are passed over.
    """
    out = {}
    for kind, fields in KINDS.items():
        own = queue.filter(F.col("entity_type") == kind).filter(F.ltrim("payload").startswith("{"))
        parsed = own.select(F.col("id").alias("entry"), *keep, F.from_json("payload", fields + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("p"))
        named = [f.split() for f in fields.split(", ")]
        out[kind] = parsed.filter("p._bad IS NULL").select("entry", *keep, *(F.coalesce(f"p.{name}", F.lit("" if of == "string" else 0).cast(of)).alias(name) for name, of in named))
    return out


def resolved(queue: DataFrame, sessions: DataFrame, observations: DataFrame) -> DataFrame:
    """(entry, kind, action): what becomes of each entry that can be read.

    Sessions (id) are those that are there and those that an earlier entry
    makes.  A save whose session is missing is kept without it ('unlink'); a
    prompt of a missing session, an update of a missing observation, the end of
    a missing session and an empty prompt are discarded; a session that is
    there already is left alone ('skip'); all else is applied ('apply').
    """
    kinds = dispatch(queue)
    made = kinds["create_session"].select(F.col("ID").alias("session"), F.col("entry").alias("since"))
    known = sessions.select(F.col("id").alias("session"), F.lit(-1).cast("bigint").alias("since")).unionByName(made).groupBy("session").agg(F.min("since").alias("since"))
    there = observations.select(F.col("id").alias("ID"), F.lit(True).alias("there")).distinct()

    def with_session(rows: DataFrame, column: str) -> DataFrame:
        j = rows.withColumnRenamed(column, "session").join(known, "session", "left")
        return j.withColumn("known", F.coalesce(F.col("since") < F.col("entry"), F.lit(False)))

    def acted(kind: str, rows: DataFrame, action: Column) -> DataFrame:
        return rows.select("entry", F.lit(kind).alias("kind"), action.alias("action"))

    linked = (F.col("session") == "") | F.col("known")
    apply = F.lit("apply")
    parts = [
        acted("save_observation", with_session(kinds["save_observation"], "SessionID"), F.when(linked, "apply").otherwise("unlink")),
        acted("update_observation", kinds["update_observation"].join(there, "ID", "left"), F.when(F.col("there"), "apply").otherwise("discard")),
        acted("create_session", with_session(kinds["create_session"], "ID"), F.when(F.col("known"), "skip").otherwise("apply")),
        acted("end_session", with_session(kinds["end_session"], "ID"), F.when(F.col("known"), "apply").otherwise("discard")),
        acted("save_prompt", with_session(kinds["save_prompt"], "SessionID"), F.when(linked & (F.col("Content") != "") & (F.col("Project") != ""), "apply").otherwise("discard")),
        *(acted(kind, kinds[kind], apply) for kind in ("delete_observation", "record_tool_use", "increment_search_count", "touch_session_activity")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drain(queue: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand a queue's stream to ``apply`` in batches (as its source cuts them), in order, until it is empty.

    A batch counts as done only after ``apply`` returns, so an error stops the
    queue there, and the next call begins with that batch again: each entry is
    applied at least once.
    """
    queue.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# Seconds between tries, and tries of each stage (the last has no end).
RETRY = [(60, 3), (300, 3), (600, 3), (1200, 3), (1800, 3), (3600, None)]


def retry_intervals() -> Iterator[int]:
    for seconds, tries in RETRY:
        n = 0
        while tries is None or n < tries:
            yield seconds
            n += 1


def retry_seconds(tries: Column) -> Column:
    """Seconds to wait after so many failed tries of one entry (0 and less: it may be tried at once)."""
    upto, out = 0, F.when(tries <= 0, F.lit(0))
    for seconds, n in RETRY:
        if n is None:
            return out.otherwise(seconds)
        upto += n
        out = out.when(tries <= upto, seconds)
    return out


def due_entries(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """(id, tries, next_at) of each queued entry (id, created_at) from the log of failed tries (id, at): when it may be tried again."""
    counted = failures.groupBy("id").agg(F.count(F.lit(1)).alias("tries"), F.max("at").alias("last"))
    j = queue.select("id", "created_at").join(counted, "id", "left").withColumn("tries", F.coalesce("tries", F.lit(0)).cast("long"))
    wait = F.make_dt_interval(secs=retry_seconds(F.col("tries")).cast("decimal(18,6)"))
    return j.select("id", "tries", (F.coalesce("last", "created_at") + wait).alias("next_at"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, into Parquet files, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
