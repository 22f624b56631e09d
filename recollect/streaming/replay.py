"""Replay of queued writes onto tables, each entry once.

The tables of a store lie in a folder: every commit names the parts that count.
Prompts, tool calls and the ledger only grow; of observations and sessions each
part has whole rows, and the last one of an id counts.  A batch of entries is
folded into new parts of all tables and its ledger, and becomes visible by one
commit, so a batch that fails in the middle leaves nothing, and one that comes
again, in whole or in part, finds its entries in the ledger and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import project_name
from ..operators import saves
from ..sources.scratch import children, mark, shuffles_dropped, spool, sweep, unspool
from ..sources.tables import content_hash
from . import streams

TABLES = {
    "observations": saves.TABLE,
    "sessions": "id string, project string, directory string, started_at timestamp_ntz, ended_at timestamp_ntz, summary string, search_count bigint, last_activity_at timestamp_ntz",
    "prompts": "id bigint, session_id string, content string, project string, created_at timestamp_ntz",
    "tool_usage": "id bigint, session_id string, project string, tool_name string, created_at timestamp_ntz",
    "ledger": "entry bigint, kind string, action string",
    "chunks": "chunk string, imported_at timestamp_ntz",
}
#: Tables of which a part replaces rows of the parts before it.
KEYED = ("observations", "sessions")
#: Parts of a table that are merged into one.
PARTS = 16


def last_commit(spark: SparkSession, folder: str) -> tuple[int, dict[str, list[str]]]:
    """The number of the last complete commit (-1 before the first), and the parts of each table in their order."""
    done = sorted(int(c) for c in children(spark, f"{folder}/commits") if "_SUCCESS" in children(spark, f"{folder}/commits/{c}"))
    if not done:
        return -1, {}
    rows = spark.read.schema("name string, parts array<string>").json(f"{folder}/commits/{done[-1]}").collect()
    return done[-1], {r.name: r.parts for r in rows}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as the last commit has it."""
    return parts_of(spark, folder, name, last_commit(spark, folder)[1].get(name, []))


def parts_of(spark: SparkSession, folder: str, name: str, parts: list[str]) -> DataFrame:
    schema = TABLES[name]
    if not parts:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/{name}/{p}" for p in parts]
    if name not in KEYED or len(parts) == 1:
        return spark.read.schema(schema).parquet(*paths)
    columns = [c.split()[0] for c in schema.split(", ")]
    first, *ordered = [spark.read.schema(schema).parquet(p).withColumn("__part", F.lit(i)) for i, p in enumerate(paths)]
    later = reduce(DataFrame.unionByName, ordered)
    newest = later.groupBy("id").agg(F.max("__part").alias("__part"))
    # only ids and part numbers are grouped; rows are not moved where later parts are small
    newest = F.broadcast(newest) if later.count() <= saves.SENT else newest
    rows = first.join(newest.select("id"), "id", "left_anti").unionByName(later.join(newest, ["id", "__part"], "left_semi"))
    return rows.select(columns)


def commit(spark: SparkSession, folder: str, number: int, tables: dict[str, list[str]]) -> None:
    if str(number) in children(spark, f"{folder}/commits"):  # half of one
        number += 1
    rows = [(name, parts) for name, parts in tables.items()]
    spark.createDataFrame(rows, "name string, parts array<string>").coalesce(1).write.mode("errorifexists").json(f"{folder}/commits/{number}")


def put(spark: SparkSession, folder: str, changes: dict[str, DataFrame]) -> None:
    """Write new parts of some tables and make them visible together; long chains of parts become one."""
    number, tables = last_commit(spark, folder)
    tables = dict(tables)
    for name, rows in changes.items():
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        part = uuid.uuid4().hex[:16]
        with shuffles_dropped(spark):
            rows.select(columns).write.parquet(f"{folder}/{name}/{part}")
        tables[name] = [*tables.get(name, []), part]
    for name, parts in tables.items():
        if len(parts) > PARTS:
            whole = uuid.uuid4().hex[:16]
            with shuffles_dropped(spark):
                parts_of(spark, folder, name, parts).write.parquet(f"{folder}/{name}/{whole}")
            tables[name] = [whole]
    commit(spark, folder, number + 1, tables)


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows that edits (entry, ID, Title, Content, Type, gone, at) change: texts that are given replace the row's, one revision each; one that is gone is marked deleted.

    Edits of a row that is deleted by then, or deleted before, change nothing but
    a further deletion, which sets the time again.
    """
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    first_end = edits.filter("gone").groupBy("ID").agg(F.min("entry").alias("first_end"), F.max_by("at", "entry").alias("end_at"))
    live = edits.filter("NOT gone").join(first_end.select("ID", "first_end"), "ID", "left").filter("first_end IS NULL OR entry < first_end")
    last = lambda c: F.max_by(said(c), F.when(said(c).isNotNull(), F.col("entry"))).alias(f"new_{c}")
    folded = live.groupBy("ID").agg(F.count(F.lit(1)).alias("times"), F.max_by("at", "entry").alias("edit_at"), last("Title"), last("Content"), last("Type"))
    j = rows.join(folded.withColumnRenamed("ID", "id"), "id", "left").join(first_end.drop("first_end").withColumnRenamed("ID", "id"), "id", "left")
    hit = F.col("times").isNotNull() & F.col("deleted_at").isNull()
    nul = lambda c: F.replace(F.col(c), F.lit("\0"), F.lit(""))
    for c, new in (("title", "new_Title"), ("content", "new_Content"), ("type", "new_Type")):
        j = j.withColumn(c, F.when(hit, F.coalesce(nul(new), c)).otherwise(F.col(c)))
    j = j.withColumns({
        "normalized_hash": F.when(hit, content_hash(F.col("title"), F.col("content"))).otherwise(F.col("normalized_hash")),
        "revision_count": F.col("revision_count") + F.when(hit, F.col("times")).otherwise(0), "updated_at": F.when(hit, F.col("edit_at")).otherwise(F.col("updated_at")),
        "last_seen_at": F.when(hit, F.col("edit_at")).otherwise(F.col("last_seen_at")), "changed": hit | F.col("end_at").isNotNull(), "deleted_at": F.coalesce("end_at", "deleted_at"),
    })
    return j.filter("changed").select(saves.COLUMNS)


def observations_after(now: DataFrame, kinds: dict[str, DataFrame], linked: DataFrame) -> DataFrame:
    """Rows of the observations that saves, updates and deletes of a batch leave changed or new.

    Saves and edits by id are taken in turns in the order of their entries: all
    saves up to an edit whose row a save of the batch makes or may find, then
    the edits up to the next such place.  Other edits have a turn of their own,
    and those of a row that one save makes and no other can find come last.
    """
    said = linked.select(
        F.col("entry").alias("id"), F.col("at").alias("created_at"), F.col("SyncID").alias("sync_id"), F.col("session").alias("session_id"), F.col("Type").alias("type"), F.col("Title").alias("title"), F.col("Content").alias("content"),
        F.lit("").alias("tool_name"), F.col("Project").alias("project"), F.lit("").alias("scope"), F.col("TopicKey").alias("topic_key"),
    )
    said = spool(said, "said")
    up = kinds["update_observation"].select("entry", "ID", "Title", "Content", "Type", F.lit(False).alias("gone"), "at")
    down = kinds["delete_observation"].select("entry", "ID", F.lit("").alias("Title"), F.lit("").alias("Content"), F.lit("").alias("Type"), F.lit(True).alias("gone"), "at")
    edits = spool(up.unionByName(down), "edits")

    good = spool(saves.prepared(said).filter("error = ''").select("id", "project", "topic_key", "normalized_hash", "title", "content"), "good")
    hashes = good.select("project", "normalized_hash")
    reached = spool(now.select("id").join(edits.select(F.col("ID").alias("id")).distinct(), "id", "left_semi"), "reached")
    target = spool(now.join(saves.sent(reached), "id", "left_semi"), "target")
    met = [target.join(good.select("project", c).distinct().filter(f"{c} <> ''"), ["project", c], "left_semi").select("id") for c in ("topic_key", "normalized_hash")]
    new_hash = hashes_after(target, edits).join(hashes.distinct(), ["project", "normalized_hash"], "left_semi").select("id")
    late = spool(undisturbed(now, good, edits), "late")
    tied = reduce(DataFrame.unionByName, [*met, new_hash, good.select("id")]).distinct().join(late, "id", "left_anti").select(F.col("id").alias("ID"))
    tied = spool(edits.join(tied, "ID", "left_semi"), "tied")
    after = edits.join(late.withColumnRenamed("id", "ID"), "ID", "left_semi").filter("entry > ID")
    free = edits.join(tied.select("entry"), "entry", "left_anti")
    changes = spool(edited(target, free), "changes")
    unspool(target)
    places = sorted(r.entry for r in tied.select("entry").collect())  # edits whose order against saves matters
    low, last = -1, late.isEmpty()
    for place in [*places, None]:
        part = said.filter(F.col("id") > low) if place is None else said.filter((F.col("id") > low) & (F.col("id") < place))
        if not part.isEmpty():
            new = saves.save_batch(over(now, changes), part)
            changes = saves.merged(changes, new)
            changes = changes if place is None and last else spool(changes, "changes")
        if place is not None:
            new = edited(over(now, changes), tied.filter(F.col("entry") == place))
            changes = spool(saves.merged(changes, new), "changes")
            low = place
    if last:
        return changes
    return saves.merged(changes, spool(edited(changes.join(late, "id", "left_semi"), after), "edited"))


def over(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with the rows of written changes in place of, or beside, its own, which stay where they lie if few change."""
    return current.join(saves.sent(changes.select("id")), "id", "left_anti").unionByName(changes)


def hashes_after(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, project, normalized_hash) of rows (id, project, title, content) after each edit that is not a deletion."""
    said = lambda c: F.last(F.when(F.col(c) != "", F.replace(F.col(c), F.lit("\0"), F.lit(""))), ignorenulls=True).over(upto)
    upto = Window.partitionBy("ID").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    given = edits.filter("NOT gone").select(F.col("ID").alias("id"), said("Title").alias("new_title"), said("Content").alias("new_content"))
    j = rows.select("id", "project", "title", "content").join(given, "id")
    return j.select("id", "project", content_hash(F.coalesce("new_title", "title"), F.coalesce("new_content", "content")).alias("normalized_hash"))


def undisturbed(now: DataFrame, good: DataFrame, edits: DataFrame) -> DataFrame:
    """(id) of saves that edits name and whose row no other save of the batch can find, before or after any edit: such edits come after all saves."""
    named = good.join(edits.select(F.col("ID").alias("id")).distinct(), "id", "left_semi").join(now.select("id"), "id", "left_anti")
    once = lambda *c: good.filter(f"{c[-1]} <> ''").groupBy(*c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    named = named.join(once("project", "normalized_hash"), ["project", "normalized_hash"], "left_anti").join(once("project", "topic_key"), ["project", "topic_key"], "left_anti")
    named = spool(named.select("id", "project", "normalized_hash", "title", "content"), "named")
    after = hashes_after(named, edits).join(named.select("id", F.col("normalized_hash").alias("own")), "id").filter("normalized_hash <> own")
    found = after.join(good.select("project", "normalized_hash").distinct(), ["project", "normalized_hash"], "left_semi").select("id")
    return named.select("id").join(found, "id", "left_anti")


def sessions_after(now: DataFrame, kinds: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """Sessions that are new, or changed by ends, searches and signs of life after they were there."""
    made = kinds["create_session"].filter("ID <> ''").groupBy("ID").agg(F.min_by(F.struct("Project", "Directory", "at"), "entry").alias("s"))
    made = made.join(now.select(F.col("id").alias("ID")), "ID", "left_anti")
    none = F.lit(None).cast("timestamp_ntz")
    made = made.select(F.col("ID").alias("id"), project_name(F.col("s.Project")).alias("project"), F.col("s.Directory").alias("directory"), F.col("s.at").alias("started_at"), none.alias("ended_at"), F.lit("").alias("summary"), F.lit(0).cast("bigint").alias("search_count"), F.col("s.at").alias("last_activity_at"))
    events = [
        kinds["end_session"].select("entry", F.col("ID").alias("id"), "at", F.lit("end").alias("what"), F.col("Summary").alias("summary")),
        *(kinds[k].select("entry", F.col("SessionID").alias("id"), "at", F.lit(w).alias("what"), F.lit("").alias("summary")) for k, w in (("increment_search_count", "search"), ("touch_session_activity", "touch"))),
    ]
    e = reduce(DataFrame.unionByName, events).join(known.withColumnRenamed("session", "id"), "id").filter("since < entry")
    of = lambda w: F.when(F.col("what") == w, F.col("entry"))
    summed = e.groupBy("id").agg(
        F.max_by("at", of("end")).alias("e_end"), F.max_by("summary", F.when((F.col("what") == "end") & (F.col("summary") != ""), F.col("entry"))).alias("e_said"), F.max_by("at", of("touch")).alias("e_touch"), F.count(of("search")).alias("e_searches"),
    )
    both = now.join(summed.select("id"), "id", "left_semi").unionByName(made).join(summed, "id", "left")
    return both.select("id", "project", "directory", "started_at", F.coalesce("e_end", "ended_at").alias("ended_at"), F.coalesce("e_said", "summary").alias("summary"), (F.col("search_count") + F.coalesce("e_searches", F.lit(0))).alias("search_count"), F.coalesce("e_touch", "last_activity_at").alias("last_activity_at"))


def apply_entries(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """Fold queued writes (id, entity_type, payload, created_at) into the tables of a folder, in the order of ids, each once.

    What becomes of each is in the ledger: ``apply``, ``unlink`` (a save whose
    session is missing is kept without it), ``skip``, ``discard``, ``refuse`` (a
    save without a title, content or project) or ``corrupt``.  A row that an
    entry makes has the entry's id.  Entries that the ledger has are passed over.
    """
    begun = mark()
    try:
        _apply(spark, folder, entries)
    finally:
        sweep(spark, begun)


def _apply(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    low, high = entries.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return
    done = table(spark, folder, "ledger").filter(F.col("entry").between(low, high)).select(F.col("entry").alias("id"))
    new = spool(entries.join(done, "id", "left_anti").dropDuplicates(["id"]), "entries")
    if new.isEmpty():
        return
    now = {name: table(spark, folder, name) for name in KEYED}
    kinds = {k: rows.withColumnRenamed("created_at", "at") for k, rows in streams.dispatch(new, "created_at").items()}
    there = now["observations"].select("id").unionByName(kinds["save_observation"].select(F.col("entry").alias("id")))  # a save of the batch may be what an edit names
    actions = spool(streams.resolved(new, now["sessions"], there), "actions")
    made = kinds["create_session"].select(F.col("ID").alias("session"), F.col("entry").alias("since"))
    known = now["sessions"].select(F.col("id").alias("session"), F.lit(-1).cast("bigint").alias("since")).unionByName(made).groupBy("session").agg(F.min("since").alias("since"))
    known = spool(known, "known")

    act = actions.select("entry", "action")
    kept = kinds["save_observation"].join(act, "entry").withColumn("session", F.when(F.col("action") == "unlink", "").otherwise(F.col("SessionID")))
    changes = {
        "observations": observations_after(now["observations"], kinds, kept),
        "sessions": sessions_after(now["sessions"], kinds, known),
        "prompts": kinds["save_prompt"].join(act.filter("action = 'apply'"), "entry").select(F.col("entry").alias("id"), F.col("SessionID").alias("session_id"), F.col("Content").alias("content"), project_name(F.col("Project")).alias("project"), F.col("at").alias("created_at")),
        "tool_usage": kinds["record_tool_use"].select(F.col("entry").alias("id"), F.col("SessionID").alias("session_id"), F.col("Project").alias("project"), F.col("ToolName").alias("tool_name"), F.col("at").alias("created_at")),
    }
    bad = kinds["save_observation"].filter("Title = '' OR Content = '' OR Project = ''").select("entry", F.lit("refuse").alias("bad"))
    ledger = new.select(F.col("id").alias("entry"), F.col("entity_type").alias("kind")).join(act, "entry", "left").join(bad, "entry", "left")
    changes["ledger"] = ledger.select("entry", "kind", F.coalesce("bad", "action", F.lit("corrupt")).alias("action")).repartitionByRange("entry").sortWithinPartitions("entry")
    put(spark, folder, changes)


def replay(queue: DataFrame, folder: str, checkpoint: str, before: Callable[[int], None] = lambda number: None) -> None:
    """Apply a queue's stream, batch after batch, until it is empty; ``before`` is called with each batch's number.

    An error stops the queue at its batch; the next call begins there.
    """
    def step(batch: DataFrame, number: int) -> None:
        before(number)
        apply_entries(batch.sparkSession, folder, batch)

    streams.drain(queue, step, checkpoint)
