"""Chunks for other machines, imports of them, and notes as Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import note_name, slug
from .scratch import has_path


def changed_since(df: DataFrame, since: str) -> DataFrame:
    return df.filter(F.col("updated_at") >= F.expr(f"TIMESTAMP_NTZ '{since}'"))


def write_chunk(df: DataFrame, path: str) -> None:
    """Compressed JSON lines; one chunk is one folder."""
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def read_chunk(spark, path: str | list[str], schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def chunk_id(df: DataFrame) -> str:
    """Sixteen hex digits from the rows, whatever their order or files: equal contents have equal ids."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    again = F.xxhash64(F.lit(1), F.to_json(F.struct(*sorted(df.columns))))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.sum(again.cast("decimal(38,0)")).alias("b"))
    return one.select(F.substring(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), 1, 16).alias("id")).first().id


MANIFEST = "id string, created_by string, created_at string, memories bigint"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a folder has; empty where nothing was exported yet."""
    path = f"{folder}/manifest"
    return spark.read.schema(MANIFEST).json(path) if has_path(spark, path) else spark.createDataFrame([], MANIFEST)


def export_chunk(df: DataFrame, folder: str, created_by: str, created_at: str, since: str | None = None) -> str | None:
    """Write the rows changed after ``since`` as a chunk named by its content, and list it; None where nothing is new.

    A chunk that the manifest lists is not written again.  The chunk is complete
    before it is listed, so a reader never meets half of one.
    """
    spark = df.sparkSession
    new = df.filter(F.col("updated_at") > F.expr(f"TIMESTAMP_NTZ '{since}'")) if since else df
    n = new.count()
    if not n:
        return None
    name = chunk_id(new)
    if manifest(spark, folder).filter(F.col("id") == name).isEmpty():
        new.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/chunks/{name}")
        spark.createDataFrame([(name, created_by, created_at, n)], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return name


def import_chunks(current: DataFrame, sessions: DataFrame, folder: str, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the chunks that the ledger (id) lacks and ``current`` does not have, and the ledger after them."""
    spark = current.sparkSession
    new = [r.id for r in manifest(spark, folder).join(ledger, "id", "left_anti").select("id").distinct().orderBy("id").collect()]  # names of chunks
    if not new:
        return current.limit(0), ledger
    rows = read_chunk(spark, [f"{folder}/chunks/{name}" for name in new], current.schema).dropDuplicates(["sync_id"])
    return import_new(current, rows, sessions).select(current.columns), ledger.unionByName(spark.createDataFrame([(name,) for name in new], "id string"))


def import_new(current: DataFrame, incoming: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of a chunk that are not here yet; a session that is unknown is cut off where there is one."""
    known = sessions.select(F.col("id").alias("session_id")).distinct().withColumn("known", F.lit(True))
    fresh = incoming.join(current.select("sync_id"), "sync_id", "left_anti")
    return fresh.join(known, "session_id", "left").filter("session_id = '' OR known").drop("known")


def split_valid(rows: DataFrame) -> DataFrame:
    """Rows of a bulk import with the first required field that is empty, '' where none is."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return rows.withColumn("error", F.when(empty("title"), "title").when(empty("content"), "content").when(empty("project"), "project").otherwise(""))


def file_name() -> Column:
    """Path of a note's file."""
    return F.concat(slug(F.col("project")), F.lit("/"), "type", F.lit("/"), note_name(F.col("id"), F.col("title")), F.lit(".md"))


def file_top() -> Column:
    """What a note's file has above its content."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    topic = F.when(F.col("topic_key") != "", F.concat(F.lit("topic_key: "), "topic_key", F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("---\nid: "), F.col("id"), F.lit('\ntitle: "'), F.replace(F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"\ntype: '), "type", F.lit("\nproject: "), "project",
        F.lit("\nscope: "), "scope", F.lit("\n"), topic, F.lit("created_at: "), day, F.lit("\nrevision: "), "revision_count", F.lit("\n---\n\n# "), "title", F.lit("\n\n"),
    )


def markdown(df: DataFrame) -> DataFrame:
    """(path, body) of each note."""
    return df.select("id", file_name().alias("path"), F.concat(file_top(), "content", F.lit("\n")).alias("body"))


def write_markdown(df: DataFrame, out: str) -> None:
    """One text file for each note, in the folder of its path, by Spark's own writer: any file system that it knows."""
    notes = markdown(df).select(F.col("path").alias("note"), F.regexp_replace("body", r"\n\z", "").alias("value"))  # the writer ends each row's line
    notes.repartition("note").write.mode("overwrite").partitionBy("note").text(out)


def digest(text: str) -> Column:
    return F.sha2(text, 256)


def mirror(before: DataFrame, after: DataFrame, digested: bool = False) -> DataFrame:
    """(path, body, change) that brings the notes of ``before`` to ``after`` (live rows): 'write', or 'remove' for old paths.

    Contents are compared by digests, so those of ``before`` are not moved; its
    rows may come with digests in their place (``digested``).
    """
    old = before.select(file_name().alias("path"), F.concat(file_top(), F.col("content") if digested else digest("content")).alias("was"))
    new = after.select(file_name().alias("path"), F.concat(file_top(), digest("content")).alias("now"), F.concat(file_top(), "content", F.lit("\n")).alias("body"))
    both = old.join(new, "path", "full")
    change = F.when(F.col("now").isNull(), "remove").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "write")
    return both.select("path", "body", change.alias("change")).filter("change IS NOT NULL")


def index(df: DataFrame) -> DataFrame:
    return df.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("created_at").alias("newest"))
