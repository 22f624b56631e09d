"""Exchange of what two stores have learned: chunks of sessions, observations and prompts in a folder that both reach.

An export writes what came after the last chunk of the manifest as a new one,
named by its content.  An import is a stream over the manifest whose checkpoint
is the ledger of the manifests it has read; the store's own table of chunks is
committed with the rows, so a chunk that a failed import comes to again is not
applied twice, and a store never imports its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import saves
from ..sources.scratch import has_path, spool
from ..sources.sync import chunk_id
from . import replay as store

MANIFEST = "id string, created_by string, created_at timestamp_ntz, sessions bigint, memories bigint, prompts bigint"
#: What a chunk has, and the column that tells what is new.
PARTS = {"sessions": "started_at", "observations": "created_at", "prompts": "created_at"}
#: What a chunk leaves out of a session: it is the other side's to count.
OWN = {"sessions": ["search_count", "last_activity_at"]}


def schema_of(name: str) -> str:
    return ", ".join(c for c in store.TABLES[name].split(", ") if c.split()[0] not in OWN.get(name, []))


def manifest(spark: SparkSession, shared: str) -> DataFrame:
    """Chunks that a folder has, each once."""
    path = f"{shared}/manifest"
    return spark.read.schema(MANIFEST).json(path).dropDuplicates(["id"]) if has_path(spark, path) else spark.createDataFrame([], MANIFEST)


def collected(spark: SparkSession, folder: str, since, project: str | None) -> dict[str, DataFrame]:
    """What the tables of a store have that began after a time; deleted observations stay out."""
    out = {}
    for name, when in PARTS.items():
        rows = store.table(spark, folder, name).drop(*OWN.get(name, []))
        rows = rows.filter("deleted_at IS NULL") if name == "observations" else rows
        rows = rows.filter(F.col(when) > F.lit(since).cast("timestamp_ntz")) if since is not None else rows
        out[name] = rows.filter(F.col("project") == project) if project else rows
    return out


def export(spark: SparkSession, folder: str, shared: str, created_by: str, at, project: str | None = None) -> str | None:
    """Write what a store has since the newest chunk of the manifest as a chunk; its name, or None where nothing is new.

    The chunk is complete before the manifest lists it, and a store marks what
    it exported as its own.
    """
    listed = manifest(spark, shared)
    since = listed.agg(F.max("created_at")).first()[0]
    parts = {name: spool(rows, name) for name, rows in collected(spark, folder, since, project).items()}
    counts = {name: rows.count() for name, rows in parts.items()}
    if not any(counts.values()):
        return None
    tagged = None
    for name, rows in parts.items():  # one digest over the rows of all tables
        row = rows.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(rows.columns))).alias("row"))
        tagged = row if tagged is None else tagged.unionByName(row)
    name = chunk_id(tagged)
    if not listed.filter(F.col("id") == name).isEmpty():
        return None
    for part, rows in parts.items():
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{shared}/chunks/{name}/{part}")
    moment = F.lit(at).cast("timestamp_ntz")
    spark.range(1).select(F.lit(name).alias("id"), F.lit(created_by).alias("created_by"), moment.alias("created_at"), F.lit(counts["sessions"]).alias("sessions"), F.lit(counts["observations"]).alias("memories"), F.lit(counts["prompts"]).alias("prompts")).coalesce(1).write.mode("append").json(f"{shared}/manifest")
    store.put(spark, folder, {"chunks": spark.range(1).select(F.lit(name).alias("chunk"), moment.alias("imported_at"))})
    return name


def numbered(rows: DataFrame, base: int, *order: str) -> DataFrame:
    """Rows with new ids above ``base`` in an order, given where they lie."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id() + F.lit(base + 1))


def apply_chunk(spark: SparkSession, folder: str, shared: str, name: str, at) -> None:
    """Put the rows of a chunk into a store that has not seen it, in one commit: sessions, then observations, then prompts.

    Sessions that are there stay as they are.  Observations are saved like any
    others, so topics and texts that are known become revisions and duplicates
    and a sync id that is known adds nothing; those of an unknown session, and
    rows that lack a type, title, content or project, are passed over.
    """
    read = lambda part: spark.read.schema(schema_of(part)).json(f"{shared}/chunks/{name}/{part}")
    moment = F.lit(at).cast("timestamp_ntz")
    known = store.table(spark, folder, "sessions")
    new = read("sessions").filter("id <> '' AND project <> ''").dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    new = spool(new.withColumns({"summary": F.coalesce("summary", F.lit("")), "search_count": F.lit(0).cast("bigint"), "last_activity_at": F.col("started_at")}), "sessions")
    there = known.select(F.col("id").alias("session_id")).unionByName(new.select(F.col("id").alias("session_id"))).distinct().withColumn("there", F.lit(True))

    current = store.table(spark, folder, "observations")
    rows = read("observations").filter("type <> ''").withColumn("session_id", F.coalesce("session_id", F.lit(""))).join(there, "session_id", "left").filter("session_id = '' OR there").drop("there")
    top = current.agg(F.max("id")).first()[0] or 0
    rows = spool(numbered(rows.withColumnRenamed("created_at", "made_at").drop("id"), top, "made_at", "sync_id"), "incoming").withColumn("created_at", moment)
    changes = saves.save_batch(current, rows)

    prompts = read("prompts").filter("content <> '' AND project <> ''").drop("id")
    top = store.table(spark, folder, "prompts").agg(F.max("id")).first()[0] or 0
    prompts = numbered(prompts, top, "created_at", "session_id", "content")
    store.put(spark, folder, {"sessions": new, "observations": changes, "prompts": prompts, "chunks": spark.range(1).select(F.lit(name).alias("chunk"), moment.alias("imported_at"))})


def import_new(spark: SparkSession, folder: str, shared: str, checkpoint: str, at) -> list[str]:
    """Apply the chunks that the manifest lists and a store has not, in the order of their times; their names."""
    done: list[str] = []
    if not has_path(spark, f"{shared}/manifest"):
        return done

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        seen = store.table(own, folder, "chunks")
        fresh = batch.join(seen.select(F.col("chunk").alias("id")), "id", "left_anti").select("id", "created_at").distinct()
        for r in sorted(fresh.collect(), key=lambda r: (r.created_at, r.id)):  # names of chunks
            apply_chunk(own, folder, shared, r.id, at)
            done.append(r.id)

    stream = spark.readStream.schema(MANIFEST).json(f"{shared}/manifest")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done
