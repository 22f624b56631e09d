"""Observations: upserts, lookups, lists, counts, retention; the resolution of saves is in ``saves``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import project_name
from ..sources.tables import content_hash
from .saves import fold_saves  # noqa: F401  (a fold of the log is an operator on observations)


def live(df: DataFrame) -> DataFrame:
    return df.filter("deleted_at IS NULL")


def visible(df: DataFrame, project: str) -> DataFrame:
    """Live rows of a project, and those of global scope."""
    return live(df).filter((F.col("project") == project) | (F.col("scope") == "global"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by this order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def by_topic_key(df: DataFrame) -> DataFrame:
    return latest(live(df).filter("topic_key <> ''"), ["project", "topic_key"], F.desc("created_at"), F.desc("id"))


def by_hash(df: DataFrame) -> DataFrame:
    return latest(live(df), ["project", "normalized_hash"], F.asc("id"))


def upsert_by_topic(saves: DataFrame) -> DataFrame:
    """Saves that carry a topic key: the last write of each (project, topic) under the first one's id; revision = number of saves."""
    return saves.filter("topic_key <> ''").groupBy("project", "topic_key").agg(F.min("id").alias("id"), F.max_by("title", "id").alias("title"), F.count(F.lit(1)).alias("revision_count"))


def dedup_by_hash(saves: DataFrame) -> DataFrame:
    """Saves without a topic key: the first of each (project, hash) stays and counts the others."""
    return saves.groupBy("project", "normalized_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("duplicate_count"), F.max("created_at").alias("last_seen_at"))


def mark_deleted(df: DataFrame, ids: DataFrame, at: Column, again: bool = True) -> DataFrame:
    """Rows named in ``ids`` (id) get a ``deleted_at``; where ``again`` is false, those deleted before keep theirs."""
    gone = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    stays = F.col("deleted_at").isNotNull() if not again else F.lit(False)
    return df.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("__hit") & ~stays, at).otherwise(F.col("deleted_at"))).drop("__hit")


def without_nul(x: Column) -> Column:
    """Texts as they are stored: no NUL characters."""
    return F.replace(x, F.lit("\0"), F.lit(""))


def lenient_int(x: Column, default: int) -> Column:
    """Whole part of a number or numeric string, the default for anything else."""
    return F.coalesce(F.try_cast(x, "double").cast("bigint") if hasattr(F, "try_cast") else x.try_cast("double").cast("bigint"), F.lit(default).cast("bigint"))


def insert_or_ignore(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``current`` and the first row of each new sync_id of ``incoming``."""
    fresh = latest(incoming, ["sync_id"], F.asc("id")).join(current.select("sync_id"), "sync_id", "left_anti")
    return current.unionByName(fresh)


def partial_update(df: DataFrame, patches: DataFrame) -> DataFrame:
    """Live rows with a patch (id, new_title, new_content, new_type) take its non-null values, a new hash and one revision more."""
    j = df.join(patches, "id", "left")
    hit = F.col("deleted_at").isNull() & (F.col("new_title").isNotNull() | F.col("new_content").isNotNull() | F.col("new_type").isNotNull())
    for c in ("title", "content", "type"):
        j = j.withColumn(c, F.when(hit, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)))
    j = j.withColumn("revision_count", F.col("revision_count") + hit.cast("int")).withColumn("normalized_hash", F.when(hit, content_hash(F.col("title"), F.col("content"))).otherwise(F.col("normalized_hash")))
    return j.drop("new_title", "new_content", "new_type")


def rename_project(df: DataFrame, old: str, new: str) -> DataFrame:
    """Live rows of one project move to another, whose name is normalised."""
    return df.withColumn("project", F.when(F.col("deleted_at").isNull() & (F.col("project") == old), project_name(F.lit(new))).otherwise(F.col("project")))


def touch(df: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Rows named in ``ids`` (id) get a new last_seen_at."""
    seen = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return df.join(seen, "id", "left").withColumn("last_seen_at", F.when(F.col("__hit"), at).otherwise(F.col("last_seen_at"))).drop("__hit")


def stale(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Live rows not seen for so many days."""
    return live(df).filter(F.col("last_seen_at") < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{days}' DAY"))


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page; bad limits fall back to 50 and 0."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit if limit > 0 else 50)


def newest_n(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def prefer_primary(primary: DataFrame, buffer: DataFrame) -> DataFrame:
    """Rows of both stores by id; the primary's where both have one."""
    both = primary.withColumn("src", F.lit(0)).unionByName(buffer.withColumn("src", F.lit(1)))
    return latest(both, ["id"], F.asc("src"))
